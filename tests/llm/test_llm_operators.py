"""The training-data operators against brute force, round trips and held-out rows, with nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lernwerk.llm import fingerprint, language_id, mixing, ngram_join, packing, pii, repeats, token_output, tokens, topk, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, component string, length string"
rng = random.Random(3)
WORDS = [a + b for a in "ka lo mi nu re sa ti".split() for b in "ba do fe gi ho".split()]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = prose(60)
TEXTS = [BASE, BASE, BASE + " end", None, "", " \n ", "x", prose(3000), "aaaa" * 500, "Is " * 300, BASE.replace(" ", "\n"), *(prose(rng.randint(5, 80)) for _ in range(25)), "mail bob@example.com card 4111 1111 1111 1111 ip 10.0.0.256 10.0.0.1 tel +49 (30) 123-4567 890 IBAN DE89 3704 0044 0532 0130 00"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "clash", None, "1") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def without_repeats(texts):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 99):
            if b[a : a + 100] in seen:
                gone[a : a + 100] = b"\1" * 100
            seen.add(b[a : a + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[i] = (len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), kept)
    return want


def test_repeats_equal_brute_force(docs, empty, monkeypatch):
    want = without_repeats(TEXTS)
    for hot in (256, 1):
        monkeypatch.setattr(repeats, "HOT", hot)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove(docs, bucket_bytes=4000).collect()}
        assert got == want
    assert repeats.remove(empty).count() == 0
    twice = repeats.remove(docs.filter("doc_id in (0, 7)").unionAll(docs.filter("doc_id = 7"))).collect()
    assert len(twice) == 3 and all(r.n_removed == 0 for r in twice if r.doc_id == 7)


@pytest.mark.parametrize("held", [1 << 20, 5])
def test_triggers_with_many_phrases_are_dealt_by_phrase(spark, monkeypatch, held):
    line = " " + prose(40) + " "
    texts = [prose(rng.randint(0, 20)) + line + prose(rng.randint(0, 20)) for _ in range(60)]
    texts += texts[:5] + [line * 3, line[:150]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    merge, hot = repeats.merge_hot, []
    monkeypatch.setattr(repeats, "merge_hot", lambda found, *n: hot.append(len(found)) or merge(found, *n, held))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove(df, bucket_bytes=2000, most_phrases=24).collect()}
    assert got == without_repeats(texts)
    assert hot and hot[0] > 0


def test_ngram_join_equals_brute_force(docs, empty):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for t in TEXTS]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    links = Counter()
    reps = sorted(first.values())
    for a in reps:
        for b in reps:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
    got = {r.doc_id: r for r in ngram_join.join(docs).collect()}
    assert {i: (r.rep_id, r.n_links) for i, r in got.items()} == {i: (first[frozenset(s)], links[first[frozenset(s)]]) for i, s in enumerate(sets)}
    assert got[0].class_id == got[1].class_id == got[2].class_id == 0 and got[0].n_copies == 3
    assert ngram_join.join(empty).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (1, 2)").count() == 0
    assert ngram_join.join(docs.unionAll(docs.filter("doc_id = 2"))).filter("doc_id = 0").first().n_links == 1


def five_grams(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(texts):
    """The number of other sets at 0.8 or more, and the smallest index that a chain of links or equal sets leads to, for each text."""
    sets = [five_grams(t) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    holders, near = {}, {i: set() for i in first.values()}
    for s, i in first.items():
        met = Counter(j for g in s for j in holders.setdefault(g, []))
        for j, both in met.items():
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                near[i].add(j), near[j].add(i)
        for g in s:
            holders[g].append(i)
    label = {i: i for i in near}
    changed = True
    while changed:
        changed = False
        for i, others in near.items():
            low = min([label[i], *(label[j] for j in others)])
            changed |= low != label[i]
            label[i] = low
    return [(len(near[first[s]]), label[first[s]]) for s in sets]


@pytest.mark.parametrize("block", [4, 7])
def test_large_components_are_verified_in_blocks_or_buckets(spark, monkeypatch, block):
    """A star of near copies, and a chain of texts that are near their neighbours only."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    own = random.Random(block)
    chain = [[own.choice(WORDS) + own.choice(WORDS) for _ in range(50)]]
    while len(chain) < 40:
        chain.append([*chain[-1][2:], own.choice(WORDS) + own.choice(WORDS), own.choice(WORDS) + own.choice(WORDS)])
    texts = [BASE + f" tail{i}" for i in range(30)] + [" ".join(x) for x in chain]
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = linked(texts)
    assert [got[i] for i in range(len(texts))] == want and want[0][0] == 29 and max(x for x, _ in want[30:]) < 10


@pytest.mark.parametrize("by_bucket", [True, False])
def test_blocks_and_buckets_count_alike(spark, monkeypatch, by_bucket):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 3)
    texts = [BASE + f" tail{i}" for i in range(10)] + [" ".join([*BASE.split()[: 60 - i], *(f"w{i}x{j}" for j in range(i))]) for i in range(1, 12)]
    rows = spark.createDataFrame([(i, 0, 4, t) for i, t in enumerate(texts)], "node long, component long, n_blocks int, text string")
    sets = ngram_join.hashed_sets(rows, ["node", "component", "n_blocks"], 5)
    if by_bucket:  # one bucket of the second band holds all; half of them met in the first
        own = [(i, b, 0, len(texts) if b else 10, [i % 2 * 1000 + (i if i % 2 else 0), 0]) for i in range(len(texts)) for b in (0, 1) if b or i % 2 == 0]
        checked = ngram_join.check_buckets(sets, spark.createDataFrame(own, "node long, band int, h long, c long, bands array<long>"), 0.8)
    else:
        checked = ngram_join.check_blocks(sets, 0.8)
    got = Counter()
    for r in checked.collect():
        got[r.node] += r.n_links
    assert [got[i] for i in range(len(texts))] == [n for n, _ in linked(texts)]


def test_recall_against_brute_force_on_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    want = linked([texts[i] for i in ids])
    got = {r.doc_id: r.n_links for r in ngram_join.join(docs).collect()}
    assert sum(n for n, _ in want) > 10 and all(got[i] <= n for i, (n, _) in zip(ids, want))
    assert sum(got[i] for i in ids) >= 0.99 * sum(n for n, _ in want)


def test_bands_reach_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999, 72)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 72


def test_pieces_are_the_tokenizers_ids(docs, empty):
    tok = Tokenizer.from_file(PATH)
    got = {}
    for r in tokens.pieces(docs, PATH, capacity=100, id_bytes=4).orderBy("doc_id", "piece").collect():
        assert r.start == len(got.setdefault(r.doc_id, b"")) // 4 and r.length == len(r.ids) // 4 <= 100 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        got[r.doc_id] += bytes(r.ids)
    assert got == {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in enumerate(TEXTS)}
    assert tokens.pieces(empty, PATH).count() == 0


def test_odd_texts_encode_alike():
    tok, own = Tokenizer.from_file(PATH), tokens.RunEncoder(PATH)
    odd = ["Don't we'll <|endoftext|>x <|ENDOFTEXT|>", "foo'. bar'! ß É é́ Ǆ", "1,234.50 ab12!! ...x", "a　b\x85c\x1cd", "ΑΣ İ"]
    ids, at = own.encode(pa.array(odd))
    assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in odd]


@pytest.mark.parametrize("planner", [packing.best_fit, packing.best_fit_decreasing])
def test_packing_is_gapless_and_within_capacity(spark, docs, planner):
    cut = tokens.pieces(docs, PATH, capacity=256).cache()
    rows = packing.place(cut, ["doc_id", "piece"], planner, 256).collect()
    assert len(rows) == cut.count()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.place(cut.filter("false"), ["doc_id", "piece"], planner, 256).count() == 0


def test_reduction_keeps_the_optimum():
    def optimum(items, cap):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= cap:
                    go(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1 :])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    own = random.Random(5)
    for _ in range(150):
        items = sorted((own.randint(1, 12) for _ in range(own.randint(1, 8))), reverse=True)
        h = dict(Counter(items))
        _, placed, fixed = packing.reduce(h, 12)
        rest = sorted((x for k, n in h.items() for x in [k] * (n - placed.get(k, 0))), reverse=True)
        assert fixed + (optimum(rest, 12) if rest else 0) == optimum(items, 12)


def test_capacity_tree():
    tree = packing.CapacityTree(10)
    for room in (3, 7, 7, 10):
        tree.add(room, 1)
    assert [tree.first(x) for x in (0, 3, 4, 8, 10)] == [3, 3, 7, 10, 10]
    tree.add(10, -1)
    assert tree.first(8) == -1


def test_packed_matrices_round_trip(docs, empty, tmp_path):
    rows = token_output.pack(docs, PATH, capacity=128).collect()
    got = {}
    for r in rows:
        ids, at = np.frombuffer(bytes(r.ids), "<u2"), np.frombuffer(bytes(r.positions), "<u2")
        assert len(ids) == 128 and r.cu_seqlens[-1] == r.n_tokens
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            got[d, p] = list(ids[a:b])
            assert list(at[a:b]) == list(range(b - a))
    tok = Tokenizer.from_file(PATH)
    for i, t in enumerate(TEXTS):
        assert [x for p in sorted(k[1] for k in got if k[0] == i) for x in got[i, p]] == [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    assert token_output.pack(empty, PATH).count() == 0


def test_mixing_is_within_one_block(docs, empty):
    share = mixing.shares({"a": 0.5, **{f"b{i}": 0.05 for i in range(10)}}, 1000)
    for k, slots in mixing.schedule(share).items():
        for i, s in enumerate(slots):
            assert abs(i + 1 - share[k] * (s + 1) / 1000) < 1 and abs(i - share[k] * s / 1000) < 1
    mixed = mixing.mix(docs, {"s0": 2.0, "s1": 1.0}, block_rows=2, period=8)
    rows = mixed.collect()
    assert len(rows) == len(TEXTS) and len({(r.slot, r.place) for r in rows}) == len(rows)
    assert set(docs.columns) <= set(mixed.columns) and mixing.mix(empty).count() == 0


def test_topk_equals_brute_force(spark):
    own = np.random.default_rng(1)
    x = own.normal(0, 0.2, (300, 6)).tolist()
    x[5] = x[0]
    x[7], x[8], x[9], x[11] = None, [float("nan")] * 6, [None] * 6, [0.0] * 6
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumn("vector", topk.quantized("embedding"))
    got = {}
    for r in topk.search(df, F.col("vec_id") % 10 == 0, 10, shard_rows=40, query_rows=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    q = {i: np.floor(1024 * np.float32(v).astype(float)).astype(int) for i, v in enumerate(x) if i not in (7, 8, 9)}
    for i in range(0, 300, 10):
        want = sorted(((int(q[i] @ v), -j) for j, v in q.items() if j != i), reverse=True)[:10]
        assert got[i] == [(-j, s) for s, j in want]
    assert topk.search(df.filter("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.search(df.limit(3), F.col("vec_id") == 0).count() == 2


def test_pii_equals_python(docs, empty):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fine(kind, m):
        d = [int(c) for c in m if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    odd = ["a@b.c@d.e", "x_" * 3000 + "@", "1.2.3.4.5.6.7.8 001.2.3.4 " + "9" * 20000, "é +1 (2) 345-678-9012. ä@b.c é@é.é", "4111-1111 1111-1111 4111111111111112", "a@b.c_foo@x.y"]
    df = docs.select("doc_id", "text").unionAll(docs.sparkSession.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = dict(enumerate(TEXTS)) | {100 + i: t for i, t in enumerate(odd)}
    for r in pii.find(df).select("doc_id", pii.joined(F.filter("spans", lambda s: s["rank"] < 4)).alias("s")).collect():
        t = texts[r.doc_id] or ""
        want = sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, t) if fine(k, m[0]))
        assert r.s == ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
    last = pii.find(docs).filter(F.col("doc_id") == len(TEXTS) - 1).first()
    assert [s["kind"] for s in last.spans] == ["email", "card", "ip", "phone", "iban"] and last.spans[4]["score"] > pii.SCORES["iban"]
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[len(TEXTS) - 1] == "mail [EMAIL] card [CARD] ip 10.0.0.256 [IP] tel [PHONE] IBAN [IBAN]"
    assert all(clean[i] == t for i, t in enumerate(TEXTS[:-1])) and pii.find(empty).count() == 0


def test_fingerprints(docs, empty, spark):
    rows = {r.doc_id: r for r in fingerprint.compare_edited(docs).collect()}
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        edited = t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
        assert (rows[i].fingerprint == rows[i].edited_fingerprint) == (edited == t)
    assert rows[0].fingerprint == rows[1].fingerprint != rows[2].fingerprint and rows[0].near_next == 1
    assert abs(rows[7].near_edited - 0.5) < 0.35 and rows[7].near_next < 0.3
    assert fingerprint.compare_edited(empty).count() == 0
    few = spark.createDataFrame([(0, "a\nb\nc"), (1, "c\na\nb"), (2, "a\nb"), (3, "c")], "k long, text string")
    v = {r.k: r.fingerprint for r in fingerprint.fingerprints(few, ["k"]).collect()}
    assert v[0] == v[1] != v[2]
    got = few.limit(1).select(fingerprint.combine(F.array(*map(F.lit, v[2])), F.array(*map(F.lit, v[3]))).alias("s"), fingerprint.combine(F.array(*map(F.lit, v[0])), F.array(*map(F.lit, v[3])), -1).alias("d")).first()
    assert got.s == v[0] and got.d == v[2]


def test_toxicity_learns(docs, empty):
    own = random.Random(9)
    made = [(" ".join([*(own.choice(WORDS) for _ in range(40)), *(["grumbolt"] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(500)]
    model = toxicity.train([t for t, _ in made[:400]], np.array([y for _, y in made[:400]]), ["en"] * 400)
    s = toxicity.score_texts(model, pa.array([t for t, _ in made[400:]]))
    assert ((s >= 0.5) == np.array([y for _, y in made[400:]])).mean() > 0.95
    scored = toxicity.score(docs, model)
    rows = scored.collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows) and scored.columns.count("score") == 1
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.score(empty, model).count() == 0
    flat = toxicity.train([], np.array([]))
    assert toxicity.score_texts(flat, pa.array(["a", ""])).tolist() == [0.5, 0.5]


def test_language_id(docs, empty):
    own = random.Random(2)
    tongues = {"xx": ["foru", "belin", "dasko", "mirt"], "yy": ["quen", "rovil", "astap", "jume"]}
    made = [(" ".join(own.choice(w) for _ in range(30)), k) for _ in range(60) for k, w in tongues.items()]
    model = language_id.fit([t for t, _ in made[:80]], [k for _, k in made[:80]])
    used = model.compressors()
    assert all(language_id.classify(t, used, model.scale)[0] == k for t, k in made[80:])
    for nothing in (None, "", "123 !!"):
        assert language_id.classify(nothing, used, model.scale) == ("und", 0.0)
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(r.lang_pred in ("xx", "yy", "und") and 0 <= r.score <= 1 for r in rows)
    assert language_id.identify(empty, model).count() == 0
    assert language_id.fit_from(empty).dictionaries == {} and language_id.classify("abc", [], 1.0) == ("und", 0.0)


def test_next_rows_over_many_ranges(spark):
    keys = [3 * i % 1009 - 200 for i in range(700)]
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "k long, t string")
    got = {r.k: r.next_t for r in fingerprint.with_next(df, "k", ["t"], F.lit(1000), range_bytes=5000).collect()}
    order = sorted(keys)
    assert got == {k: f"t{n}" for k, n in zip(order, order[1:] + order[:1], strict=True)}
    one = fingerprint.with_next(df.limit(1), "k", ["t"], F.lit(1000)).first()
    assert one.next_t == one.t
