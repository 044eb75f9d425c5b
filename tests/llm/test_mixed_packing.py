from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from lernwerk.llm import mixing, packing
from lernwerk.llm.common import settle, stored


def test_sequences_follow_the_mix(spark, monkeypatch):
    """A source with two thirds of the rows has its target share all along the sequences up to where another runs out."""
    monkeypatch.setattr(corpus_pipeline, "RUN_ROWS", 800)
    n = {"a": 10000, "b": 4000, None: 1000}
    rows = [(i, f"word {i} " * (1 + i % 40), s) for i, s in enumerate(s for s, k in n.items() for _ in range(k))]
    rows += [(None, "no id", "a")] * 2 + [(7, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs.select("doc_id", "source"))
    written = settle(corpus_pipeline.mix_sources(spark, docs, ""), "mixed")
    packed = corpus_pipeline.pack_sequences(spark, written, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in rows)
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length, r.doc_id))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _, _ in pieces] == [sum(x for _, x, _ in pieces[:i]) for i in range(len(pieces))] and sum(x for _, x, _ in pieces) <= 4096
    source = {r[0]: r[2] for r in rows}
    along = [d for s in sorted(sequences) for _, _, d in sequences[s]]
    weights = {k: c**0.5 for k, c in n.items()}
    full = mixed.filter("in_mix").count() // 800
    assert full >= 6
    for i in range(full):  # a run of 100 slots of 8 rows; a source is less than a block from its share at either end
        found = Counter(source[d] for d in along[800 * i : 800 * (i + 1)])
        assert all(abs(found[k] - 800 * w / sum(weights.values())) < 18 for k, w in weights.items()), found
    stretch = {r.doc_id: r.slot // 100 for r in mixed.filter("doc_id IS NOT NULL AND doc_id <> 7").collect()}
    seen = [stretch[d] for d in along[: 800 * full] if d in stretch]
    assert seen == sorted(seen)


def test_rows_are_found_in_stored_order(spark):
    """Files by their numbers, rows as they lie in them, whatever the partitions they are read in; a column called _metadata is no hindrance."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("_metadata")).repartitionByRange(13, "doc_id").sortWithinPartitions("doc_id")
    written = settle(docs, "ordered")
    at = written.select("doc_id", *stored(written))
    assert [r.doc_id for r in sorted(at.collect(), key=lambda r: (r.part, r.file, r.row))] == list(range(5000))
    runs = packing.in_runs(at, ["part", "file"], "row", 700).collect()
    assert {r.doc_id: r.run for r in runs} == {i: min(i // 700, 6) for i in range(5000)}
    assert {r.run for r in packing.in_runs(at, ["part", "file"], "row", 700, most=3).collect()} == {0, 1}
    assert packing.in_runs(at.limit(0), ["part", "file"], "row", 700).collect() == []


def test_rows_of_no_file_keep_their_order(spark):
    at = spark.range(0, 1000, 1, 7).select("id", *stored(spark.range(0, 1000, 1, 7)))
    assert [r.id for r in sorted(at.collect(), key=lambda r: (r.part, r.file, r.row))] == list(range(1000))
