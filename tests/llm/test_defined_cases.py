"""Odd input and brute force: extra columns of clashing names, nulls, empty and very long texts, ties, repeated rows, empty tables."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

import corpus_pipeline
from lernwerk.llm import language_id, mixing, packing, pii, topk, toxicity
from lernwerk.llm.common import mix64, ranked

SF = "/root/testdata/sf0.001"
CLASH = ["_text", "_n", "_source", "_share", "_email", "_body", "_bucket", "_number", "_gone", "_score", "runs", "row", "run", "_first"]


@pytest.fixture(scope="module")
def odd(spark):
    own = random.Random(4)
    words = [a + b for a in "ka lo mi nu".split() for b in "ba do fe gi".split()]
    prose = lambda n: " ".join(own.choice(words) for _ in range(n))
    base = prose(80)
    rows = [(1, base), (2, base), (3, None), (4, ""), (5, " \n "), (None, prose(50)), (None, None), (7, prose(400_000)), (8, prose(9)), (8, prose(9)), (9, "mail a.b@example.com now"), (9, "mail a.b@example.com now")]
    full = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None if t is None else len(t), *(f"{c}{k}" for c in CLASH)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3).cache()


def kept_columns(df):
    return Counter(tuple(r[c] for c in ("doc_id", *CLASH)) for r in df.select("doc_id", *CLASH).collect())


def test_extra_columns_pass_through(odd):
    want = kept_columns(odd)
    model = toxicity.train(["good words", "bad words"], np.array([0, 1]))
    assert kept_columns(toxicity.score(odd, model)) == want
    assert kept_columns(language_id.identify(odd, language_id.fit(["abc def"] * 5, ["x"] * 5))) == want
    assert kept_columns(mixing.mix(odd, block_rows=1, period=10)) == want
    assert kept_columns(pii.find(odd)) == want and kept_columns(pii.redact(odd)) == want
    cut = odd.withColumn("length", F.lit(3).cast("long")).withColumn("piece", F.col("row"))
    assert kept_columns(packing.place(cut, ["piece"], packing.best_fit, 8)) == want
    assert kept_columns(packing.place_runs(cut.withColumn("part", F.lit(1)), "part", ["piece"], packing.best_fit, 8)) == want
    assert kept_columns(ranked(odd, ["lang"], ["doc_id"], "at", 12).filter("lang IS NOT NULL")) == kept_columns(odd.filter("lang IS NOT NULL"))


def test_stages_take_odd_input(spark, odd):
    docs, texts = odd, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == odd.columns and after.dtypes == odd.dtypes, name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
        texts, docs = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), after
        if name in ("mixing", "pii"):
            assert docs.count() == sum(texts.values())
    rows = Counter((r.doc_id, r.n_chars, r.text and len(r.text)) for r in docs.collect())
    assert sum(n for (i, _, _), n in rows.items() if i is None) == 2 and all(a == b for _, a, b in rows)
    assert {r.text for r in docs.filter("doc_id = 9").collect()} == {"mail [EMAIL] now"} and docs.filter("doc_id IN (1, 2)").count() == 1
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert packed.filter("piece = 0").count() == docs.count() and packed.filter("doc_id = 7").count() > 90
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), SF).count() == 0


def test_scores_equal_a_plain_convolution():
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 1, (3 * 64, 5)).astype(np.float32), {w: rng.normal(0, 1, (w, 5, 4)).astype(np.float32) for w in toxicity.WIDTHS}, rng.normal(0, 1, 12).astype(np.float32), rng.normal(0, 1, 12).astype(np.float32), 0.3)
    model.table[-1] = 0
    texts = ["One two, THREE four. one", "é ¡x! --", "", "solo", "a b", " ".join(f"w{i % 7}" for i in range(50))]

    def embedded(word):
        bare = word.lower().strip(toxicity.PUNCTUATION)
        if not bare:
            return np.zeros(5)
        h = xxh3_64_intdigest(bare)
        marked = b"\2" + bare.encode() + b"\3"
        found = [int.from_bytes(marked[i : i + 4], "big") for i in range(len(marked) - 3)]
        out = model.table[h % 64] + model.table[64 + (h >> 32) % 64]
        for g in found:
            out = out + model.table[128 + int(mix64(np.array([g], np.uint64))[0]) % 63] / len(found) ** 0.5
        return out

    want = []
    for t in texts:
        e = [embedded(w) for w in t.split()]
        best = [max([0.0, *(sum(float(e[p + j] @ model.filters[w][j][:, f]) for j in range(w) if p + j < len(e)) for p in range(len(e)))]) for w in toxicity.WIDTHS for f in range(4)]
        want.append(1 / (1 + np.exp(-(model.out @ np.maximum(np.array(best) + model.bias, 0) + 0.3))))
    assert np.allclose(toxicity.score_texts(model, pa.array(texts)), want, atol=1e-4)


def test_mix_is_within_one_block_at_every_slot(spark):
    n = {"a": 700, "b": 220, None: 90}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, k in n.items() for _ in range(k))], "doc_id long, source string")
    weights = {"a": 5.0, "b": 3.0, "\0null": 2.0}
    rows = mixing.mix(docs, weights, block_rows=2, period=50).filter("in_mix").collect()
    at = {r.slot: r.source for r in rows}
    assert len(at) > 200 and sorted(at) == list(range(len(at)))
    seen = Counter()
    for slot in range(len(at)):
        seen[at[slot]] += 1
        assert all(abs(seen[k] - w / 10 * (slot + 1)) < 1 for k, w in (("a", 5), ("b", 3), (None, 2))), slot


def test_language_is_that_of_the_smallest_compressed_size():
    own = random.Random(6)
    tongues = {"xx": ["foru", "belin", "dasko"], "yy": ["quen", "rovil", "foru"], "zz": ["astap", "jume", "belin"]}
    made = [(" ".join(own.choice(w) for _ in range(30)), k) for _ in range(30) for k, w in tongues.items()]
    model = language_id.fit([t for t, _ in made], [k for _, k in made])
    for text in ["foru belin", "quen quen jume", " ".join(own.choice(tongues["zz"]) for _ in range(3000)), "x"]:
        raw = f" {language_id.plain(text)} ".encode()
        size = {}
        for k, d in model.dictionaries.items():
            c = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            size[k] = sum(len(c.compress(raw[i : i + language_id.CHUNK])) for i in range(0, len(raw), language_id.CHUNK))
        found, _ = language_id.classify(text, model.compressors(), model.scale)
        assert size[found] == min(size.values())
    tied = language_id.Model({"b": b"same words here", "a": b"same words here"})
    assert language_id.classify("other", tied.compressors(), 1.0) == ("b", 0.5)


def test_every_finite_vector_takes_part(spark):
    x = {0: [1e13, 1.0], 1: [4e6, 4e6], 2: [3e38, -3e38], 3: [0.5, -0.25], 4: [-1e30, 1e30], 5: [0.0, 0.0], 6: [1.0, float("inf")], 7: None}
    rows = [*x.items(), (1, [4e6, 4e6]), (None, [1.0, 1.0]), (0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", topk.quantized("embedding"))
    got = {}
    for r in topk.search(df, F.col("vec_id").isin(1, 2, 3), 10, shard_rows=3, query_rows=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = [(i, [int(np.floor(1024 * np.float64(np.float32(c)))) if abs(c) < 1e12 else int(np.float32(c)) * 1024 for c in v]) for i, v in rows if i is not None and v is not None and i < 6]
    for q in (2, 3):
        own = dict(whole)[q]
        want = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(own, v)))), i) for i, v in whole if i != q)[:10]
        assert got[q] == [(i, -s) for s, i in want]
    assert len(got[1]) == 10 and all(i != 1 for i, _ in got[1])  # two rows of id 1 ask; neither meets the other
