"""Self join on the Jaccard similarity of word n-gram sets, by MinHash banding.

Bands and rows are chosen so that a pair at the threshold meets in some band with the target recall. Documents with equal sets are
one class from the start, and only one of a class goes on. The members of a band bucket are tied to its smallest member, so a bucket
of m costs m edges, not m**2 pairs. Links lie within the components of these ties and are verified on the full n-gram sets, by products of incidence
matrices, in tasks of bounded size:

* a component that one task can hold is checked as a whole;
* a larger one goes to the tasks in blocks, every two of which meet. What travels is not the documents but how their sets differ from that of the component's
  first member, which for near copies is little;
* where the buckets are small though the component is not (chance meetings that form a chain), buckets go to the tasks instead, and a pair counts in the first
  bucket that it shares. Whichever of the two copies fewer sets is taken, with the same result.

The result has one row for each document; pairs are never listed.

Words are lower-cased runs between white space; n-grams are hashed to 64 bits. A text of fewer words than n has one n-gram, all its
words. Defined cases: texts without words (null included) form one class and are linked to nothing; equal texts share a class; repeated rows with
equal keys count as copies of each other; rows with a null key are a class by themselves in ``keep_one``, which keeps them, and copies of each other in ``join``; a text
of any length counts whole; an empty table gives no rows. Columns besides key and text are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fresh, mix64, settle, small, split_words, word_hashes
from .graph import components
from .tokens import spread

#: What one task holds of a component, at most: documents, and bytes of hashes.
BLOCK_DOCS, BLOCK_BYTES = 1024, 32 << 20
COLUMNS, SALTS = 4096, 64


def choose_bands(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance meetings, for which a pair at the threshold meets with the target recall."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no bands reach this recall")


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    codes, offsets, words = split_words(texts)
    count = np.diff(offsets)
    h = np.zeros(len(codes) + n * len(count), np.uint64)
    starts = offsets[:-1] + n * np.arange(len(count))
    h[np.arange(len(codes)) + n * np.repeat(np.arange(len(count)), count)] = word_hashes(words)[codes] if len(codes) else 0
    m = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    at = spread(starts, m)
    acc = np.zeros(len(at), np.uint64)
    for j in range(n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[at + j]
    ends = np.cumsum(m)
    acc = mix64(acc)
    return [np.unique(acc[a:b]) for a, b in zip((ends - m).tolist(), ends.tolist(), strict=True)]


def sketch(docs: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_grams, set_a, set_b (hashes of the whole set), bands (one hash for each band; none for an empty set)."""
    rng = np.random.default_rng(5)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            sets = shingles(block.column(1), n)
            size = np.array([len(s) for s in sets])
            full = np.flatnonzero(size)
            both = np.zeros((2, len(sets)), np.uint64)
            hashes = np.zeros((len(full), bands), np.uint64)
            if len(full):
                every = np.concatenate(sets)
                starts = (np.cumsum(size) - size)[full]
                both[0, full] = np.add.reduceat(every, starts)
                both[1, full] = np.add.reduceat(mix64(every ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                for i in range(bands):
                    acc = np.full(len(full), i, np.uint64)
                    for j in range(i * rows, (i + 1) * rows):
                        acc = mix64(acc ^ np.minimum.reduceat(every * a[j] + b[j], starts))
                    hashes[:, i] = acc
            ends = np.zeros(len(sets) + 1, np.int32)
            ends[1:] = np.cumsum(np.where(size > 0, bands, 0))
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(size, pa.int64()), pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64)), lists], names=["doc_id", "n_grams", "set_a", "set_b", "bands"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, "doc_id long, n_grams long, set_a long, set_b long, bands array<long>")


def incidence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(vocabulary)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(vocabulary, s)
        at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == s)]
        out[i, at] = 1
    return out


def meetings(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets share. left is right: within one list."""
    if left is right:
        hashes, count = np.unique(np.concatenate(left), return_counts=True)
        shared = hashes[count > 1]
    else:
        shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    both = np.zeros((len(left), len(right)), np.int32)
    for c in range(0, len(shared), COLUMNS):
        some = shared[c : c + COLUMNS]
        x = incidence(left, some)
        y = x if left is right else incidence(right, some)
        both += np.rint(x @ y.T).astype(np.int32)
    return both


class Sets:
    """Documents of one task: ids, sizes of their sets, and the sets as differences from one of ``hub`` hashes, of which they lack ``lacks`` (0 and 0: whole sets)."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, differs: list[np.ndarray], lacks: np.ndarray | int = 0, hub: int = 0, bands: np.ndarray | None = None):
        self.ids, self.size, self.differs, self.lacks, self.hub, self.bands = ids, size, differs, lacks + np.zeros(len(ids), np.int64), hub, bands

    def some(self, at: np.ndarray) -> Sets:
        return Sets(self.ids[at], self.size[at], [self.differs[i] for i in at], self.lacks[at], self.hub, None if self.bands is None else self.bands[at])


def links(a: Sets, b: Sets, threshold: float, band: int | None = None) -> np.ndarray:
    """Which pairs reach the threshold, exactly, in whole numbers of n-grams. band: only pairs that share no bucket of a band before."""
    both = meetings(a.differs, b.differs if b is not a else a.differs) + (a.hub - a.lacks[:, None] - b.lacks)
    total = a.size[:, None] + b.size - both
    met = (both > 0) & (both >= np.ceil(threshold * total - 1e-9))
    for j in range(band or 0):
        met &= a.bands[:, j][:, None] != b.bands[:, j]
    return met


def verify(docs: Sets, threshold: float, sides: np.ndarray | None = None, band: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each document, and the smallest id it is tied to within this task. sides: 0 or 1, where only pairs of unlike sides count."""
    n = len(docs.ids)
    if sides is None:
        met = links(docs, docs, threshold, band)
        np.fill_diagonal(met, False)
    else:
        left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        met = np.zeros((n, n), bool)
        if len(left) and len(right):
            met[np.ix_(left, right)] = links(docs.some(left), docs.some(right), threshold, band)
            met |= met.T
    label, nothing = docs.ids.copy(), np.iinfo(np.int64).max
    while True:
        smaller = np.minimum(label, np.where(met, label[None, :], nothing).min(axis=1, initial=nothing))
        if (smaller == label).all():
            return met.sum(axis=1), label
        label = smaller


def grouped(part: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each value."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    yield from np.split(order, cuts) if len(order) else []


CHECKED = "node long, n_links long, label long"


def as_checked(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    columns = zip(*found, strict=True) if found else ([], [], [])
    return pa.table({k: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for k, x in zip(("node", "n_links", "label"), columns, strict=True)})


def check_whole(with_text: DataFrame, n: int, threshold: float, groups: int) -> DataFrame:
    """Components that a task can hold, many to a task. with_text: component, node, text."""

    def run(table: pa.Table) -> pa.Table:
        found = []
        for at in grouped(table.column("component").to_numpy()):
            some = table.take(pa.array(at))
            sets, ids = shingles(some.column("text").combine_chunks(), n), some.column("node").to_numpy()
            docs = Sets(ids, np.array([len(x) for x in sets]), sets)
            found.append((ids, *verify(docs, threshold)))
        return as_checked(found)

    return with_text.groupBy(F.pmod(F.xxhash64("component"), F.lit(groups)).alias("task")).applyInArrow(run, CHECKED)


def hashed_sets(with_text: DataFrame, names: list[str], n: int) -> DataFrame:
    """``names`` and the sorted n-gram hashes as bytes, ``grams``. with_text: names, then text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            grams = pa.array([x.tobytes() for x in shingles(block.column("text"), n)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), grams], names=[*names, "grams"])

    fields = [f"`{c}` {with_text.schema[c].dataType.simpleString()}" for c in names]
    return with_text.select(*names, "text").mapInArrow(run, ", ".join([*fields, "grams binary"]))


def hashes(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def differences(paired: DataFrame, names: list[str]) -> DataFrame:
    """names, size, hub, lacks, differs. paired: names, grams, first (the hashes of the component's first member)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, first in zip(batch.column("grams").to_pylist(), batch.column("first").to_pylist(), strict=True):
                a, h = hashes(own), hashes(first)
                lacks = np.setdiff1d(h, a, assume_unique=True)
                rows.append((len(a), len(h), len(lacks), np.concatenate([lacks, np.setdiff1d(a, h, assume_unique=True)]).tobytes()))
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "size", "hub", "lacks", "differs"])

    fields = [f"`{c}` {paired.schema[c].dataType.simpleString()}" for c in names]
    return paired.select(*names, "grams", "first").mapInArrow(run, ", ".join([*fields, "size long, hub long, lacks long, differs binary"]))


def paired_blocks(rows: DataFrame, n_blocks: str, block: str) -> DataFrame:
    """Every row once for each block that its own meets: ``low``, ``high`` and ``side`` (all 0 within one block)."""
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(n_blocks) - 1)))
    return met.withColumn("low", F.least(block, "other")).withColumn("high", F.greatest(block, "other")).withColumn("side", (F.col(block) > F.col("other")).cast("int"))


def sides_of(table: pa.Table) -> np.ndarray | None:
    return None if table.column("low")[0] == table.column("high")[0] else table.column("side").to_numpy()


def check_blocks(sets: DataFrame, threshold: float) -> DataFrame:
    """Components in blocks. sets: node, component, n_blocks, grams."""
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    first = sets.filter("node = component").select("component", F.col("grams").alias("first"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    apart = settle(differences(dealt.join(first.hint("merge"), ["component", "block"]), ["node", "component", "n_blocks", "block"]), "differences")

    def run(table: pa.Table) -> pa.Table:
        ids, size, lacks = (table.column(c).to_numpy() for c in ("node", "size", "lacks"))
        docs = Sets(ids, size, [hashes(x) for x in table.column("differs").to_pylist()], lacks, int(table.column("hub")[0].as_py()))
        return as_checked([(ids, *verify(docs, threshold, sides_of(table)))])

    return paired_blocks(apart, "n_blocks", "block").groupBy("component", "low", "high").applyInArrow(run, CHECKED)


def check_buckets(sets: DataFrame, in_buckets: DataFrame, threshold: float) -> DataFrame:
    """Documents of wide components, bucket by bucket. sets: node, grams; in_buckets: node, band, h, c (rows of the bucket), bands."""
    rows = sets.select("node", "grams").join(in_buckets.hint("merge"), "node").withColumn("parts", F.ceil(F.col("c") / BLOCK_DOCS).cast("int"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        ids, bands = table.column("node").to_numpy(), table.column("bands").combine_chunks()
        sets = [hashes(x) for x in table.column("grams").to_pylist()]
        docs = Sets(ids, np.array([len(x) for x in sets]), sets, bands=bands.flatten().to_numpy().reshape(len(ids), -1))
        return as_checked([(ids, *verify(docs, threshold, sides_of(table), int(table.column("band")[0].as_py())))])

    return paired_blocks(dealt, "parts", "part").groupBy("band", "h", "low", "high").applyInArrow(run, CHECKED)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999, most_hashes: int = 72) -> DataFrame:
    """doc_id, class_id, rep_id, n_grams, n_copies, n_links for each document.

    rep_id: the smallest id with the same n-gram set; n_copies: how many documents have it; n_links: how many other sets are similar at least
    ``threshold``; class_id: the smallest id that a chain of links leads to.
    """
    bands, rows = choose_bands(threshold, recall, most_hashes)
    made = settle(sketch(docs, key, text, n, bands, rows), "sketch")
    # written out, so that the join reads two plain shuffles and Spark may split the rows of a set with very many copies
    same = settle(made.groupBy("set_a", "set_b", "n_grams").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("n_copies")), "same")
    members = settle(made.drop("bands").join(same.hint("merge"), ["set_a", "set_b", "n_grams"]).select("doc_id", "rep_id", "n_grams", "n_copies"), "members")
    reps = made.join(members.filter("doc_id = rep_id").select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    banded = settle(reps.select(F.col("doc_id").alias("node"), "n_grams", F.posexplode("bands").alias("band", "h")), "bands")
    buckets = settle(banded.groupBy("band", "h").agg(F.min("node").alias("hub"), F.count("*").alias("c")).filter("c > 1"), "buckets")
    ties = banded.join(buckets.hint("merge"), ["band", "h"])
    tied = components(ties.filter("node <> hub"), "node", "hub")
    members_of = settle(tied.join(banded.filter("band = 0").select("node", "n_grams").hint("merge"), "node"), "tied")
    sizes = members_of.groupBy("component").agg(F.count("*").alias("m"), F.sum("n_grams").alias("hashes"))
    sizes = settle(sizes.withColumn("n_blocks", F.greatest(F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("hashes") * 8 / BLOCK_BYTES)).cast("int")), "sizes")
    total, n_wide = sizes.agg(F.sum(F.when(F.col("n_blocks") == 1, F.col("hashes"))), F.count_if(F.col("n_blocks") > 1)).first()
    placed = members_of.drop("n_grams").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    if n_wide:
        copies = buckets.join(members_of.select(F.col("node").alias("hub"), "component").hint("merge"), "hub")
        copies = copies.groupBy("component").agg(F.sum(F.col("c") * F.ceil(F.col("c") / BLOCK_DOCS)).alias("copies"))
        wide = sizes.filter("n_blocks > 1").join(copies.hint("merge"), "component")
        wide = settle(wide.select("component", "n_blocks", (F.col("copies") < F.col("m") * F.col("n_blocks")).alias("by_bucket")), "wide")
        # salted, as the members of one component may be a third of all
        placed = placed.join(wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["component", "salt"], "left")
    else:
        placed = placed.withColumn("n_blocks", F.lit(None).cast("int")).withColumn("by_bucket", F.lit(None).cast("boolean"))
    whole = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("node"), F.col(text).alias("text"))
    with_text = whole.join(placed.drop("salt").hint("merge"), "node").dropDuplicates(["node"])
    with_text = settle(with_text, "texts") if n_wide else with_text
    checked = settle(check_whole(with_text.filter("n_blocks IS NULL"), n, threshold, max(1, math.ceil((total or 0) * 8 / (BLOCK_BYTES // 4)))), "checked")
    if n_wide:
        sets = settle(hashed_sets(with_text.filter("n_blocks > 1"), ["node", "component", "n_blocks", "by_bucket"], n), "sets")
        own = ties.join(reps.select(F.col("doc_id").alias("node"), "bands").hint("merge"), "node").select("node", "band", "h", "c", "bands")
        parts = [check_blocks(sets.filter("NOT by_bucket"), threshold)]
        if sets.filter("by_bucket").limit(1).count():
            parts.append(check_buckets(sets.filter("by_bucket"), own, threshold))
        for i, part in enumerate(parts):
            checked = checked.unionByName(settle(part, f"wide-{i}"))
    linked = checked.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    classes = components(checked.filter("label <> node").select(F.col("node").alias("a"), F.col("label").alias("b")))
    by_rep = settle(linked.join(classes.hint("merge"), "node", "left").select(F.col("node").alias("rep_id"), "n_links", F.col("component").alias("class_id")), "by-rep")
    out = members.join(by_rep.hint("merge"), "rep_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "rep_id").alias("class_id"), "rep_id", "n_grams", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without those that are not the first of their class. Columns stay as they are; rows with a null key stay, as do all rows that repeat the key of the first."""
    mark = fresh(docs, "gone")
    gone = join(docs.filter(F.col(key).isNotNull()), key, text, **options).filter("doc_id <> class_id").select(F.col("doc_id").alias(mark))
    gone = settle(gone, "gone")
    return docs.join(small(gone, gone.count(), 500_000), docs[key] == F.col(mark), "left_anti")
