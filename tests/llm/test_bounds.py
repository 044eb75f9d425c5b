"""Keys that repeat with unlike texts, null keys, numbers that do not fit, samples that are never prefixes."""

import random
import re
from collections import Counter

import public_tokenizers
import pytest

from lernwerk.llm import language_id, repeats, token_output, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(6)


def prose(n):
    return " ".join(rng.choice(["kalo", "mi", "nuresa", "ti", "bado", "fegi", "hopu"]) for _ in range(n))


SHARED = prose(60)
ROWS = [(1, prose(20)), (5, SHARED + " a " + prose(90)), (5, prose(700) + SHARED), (5, SHARED), (5, SHARED), (None, prose(30) + SHARED), (None, SHARED + prose(200)), (None, None), (3, prose(50)), (2, "")]
ROWS += [(10 + i, "ab" * 30 + SHARED[i : i + 130] + "xyz" * 40 + prose(i)) for i in range(40)]


def test_unlike_texts_of_one_key_and_null_keys(spark):
    """The documents are the distinct pairs; ties of a key, whose order is that of a hash, are tried in the order that the operator took."""
    table = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    got = repeats.remove(table).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS)
    whole, _ = repeats.numbered(table.selectExpr("doc_id AS own", "CAST(coalesce(text, '') AS BINARY) AS body"))
    order = {(r.own, bytes(r.body)): r.doc_id for r in whole.collect()}
    assert len(set(order.values())) == len(set(ROWS)) and [k for k, _ in sorted(order, key=order.get)] == sorted([i for i, _ in set(ROWS)], key=lambda i: (i is None, i))
    seen, want = set(), Counter()
    times = Counter((i, (t or "").encode()) for i, t in ROWS)
    for own, b in sorted(order, key=order.get):
        gone = bytearray(len(b))
        for a in range(len(b) - 99):
            if b[a : a + 100] in seen:
                gone[a : a + 100] = b"\1" * 100
            seen.add(b[a : a + 100])
        want[own, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(b, gone, strict=True) if not g)] += times[own, b]
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def test_ids_and_positions_that_do_not_fit_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for options in ({"capacity": 70_000}, {"end_id": 70_000}, {"pad_id": -1}, {"id_bytes": 1}, {"id_bytes": 3}):
        with pytest.raises(ValueError):
            token_output.pack(docs, PATH, **options)
    assert token_output.pack(docs, PATH, capacity=70_000, id_bytes=4).count() == 1


def test_language_samples_come_from_all_over_a_text():
    raw = b"".join(b"%05d " % i for i in range(20_000))
    found = [int(x) for x in language_id.pieces_of_text(raw, 4096).split() if len(x) == 5]
    assert min(found) < 100 and max(found) > 19_900 and any(8_000 < x < 12_000 for x in found)
    assert len(language_id.pieces_of_text(raw, 4096)) <= 4096 and language_id.pieces_of_text(b"short", 4096) == b"short"
    model = language_id.fit(["abc def " * 3000 + "xyz uvw " * 3000] * 200, ["l"] * 200)  # both halves of each text are in the dictionary, which no text overfills
    found = model.dictionaries["l"]
    assert 120_000 < len(found) <= 1 << 17 and min(found.count(b"abc"), found.count(b"xyz")) > 8_000


def test_toxicity_learns_from_long_texts_while_all_fit(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, langs: taught.append((list(texts), labels.tolist(), langs)))
    texts = {1: "a" * 30_000, 2: "b" * 40_000, 3: "c" * 10, 4: None, 5: "", 6: "d" * 10, None: "e"}
    docs = spark.createDataFrame([(k, t, "en") for k, t in texts.items()] + [(3, "c" * 20, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 4, 5)] + [(6, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    toxicity.train_from(docs, labels)
    toxicity.train_from(docs, labels, most_chars=45_000)
    toxicity.train_from(docs.limit(0), labels)
    assert sorted(zip(*taught[0][:2])) == sorted([("a" * 30_000, 1), ("b" * 40_000, 0), ("", 1)] + [("c" * n, 1) for n in (10, 10, 20, 20)])
    lengths = sorted(map(len, taught[1][0]))
    assert lengths[:5] == [0, 10, 10, 20, 20] and lengths[5:] in ([30_000], [40_000])
    assert taught[2][0] == []
