"""Exact top-k by inner product: the threshold algorithm over sorted lists, one list for each dimension.

Vectors are dealt to shards of bounded size by a hash; each shard sorts each dimension once. A query walks the lists
in step, from the end that its component favours; each vector met for the first time is scored in full, and the walk stops when
the sum of what the lists can still offer is under the k-th score so far. Queries come in groups of bounded size and every
group meets every shard; the k best of the shards are ranked again for each query.

Defined cases: rows whose vector is null, or holds a null or non-finite component, take no part; nor do empty vectors, nor those with a component of which the scaled
value is no finite double. Ties go to the smaller id. A query never meets its own id, so rows that repeat an id are candidates of other queries only, each by itself.
Fewer than k candidates: all of them. Vectors of another dimension than the query's are not comparable with it and are left out. An empty table, or one without
queries, gives no rows. Scores are exact: products that doubles cannot hold are taken in whole numbers of any size, and a score beyond a long counts
as the largest or smallest long, before ties are looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantized(vector: str | Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as array<double>, which holds it exactly if ``scale`` is a power of two; null if the vector takes no part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    scaled = lambda x: x.cast("double") * scale
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < float("inf")))
    return F.when(fine, F.transform(v, lambda x: whole(scaled(x))))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


def clamped(scores):
    return np.minimum(np.maximum(scores, LEAST), MOST) if isinstance(scores, np.ndarray) and scores.dtype == object else scores


def walk(rows: np.ndarray, lists: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of one shard. lists: for each dimension the row numbers by rising component. rows, query: doubles if these hold all sums, else whole numbers as objects."""
    n = len(rows)
    used = np.flatnonzero(query != 0)
    if not len(used):
        return [(0, int(i)) for i in np.sort(ids[ids != own])[:k]]
    up = (query[used] > 0).astype(bool)
    met = np.zeros(n, dtype=bool)
    met[ids == own] = True
    scores, found = np.zeros(0, rows.dtype), np.zeros(0, np.int64)
    depth, step = 0, STEP
    while depth < n:
        until = min(n, depth + step)
        at = np.concatenate([lists[used[up], n - until : n - depth].ravel(), lists[used[~up], depth:until].ravel()])
        fresh = np.unique(at[~met[at]])
        met[fresh] = True
        scores, found = np.concatenate([scores, clamped(rows[fresh] @ query)]), np.concatenate([found, fresh])
        depth, step = until, 2 * step
        if len(scores) > k:
            order = best(scores, ids[found], k)
            scores, found = scores[order], found[order]
            last = np.where(up, rows[lists[used, n - depth], used], rows[lists[used, depth - 1], used])
            if scores[-1] > max(LEAST, min(MOST, int(last @ query[used]))):  # what was not met scores no more than this
                break
    order = best(scores, ids[found], k)
    return [(int(s), int(i)) for s, i in zip(scores[order], ids[found[order]], strict=True)]


def as_objects(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def by_dimension(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors, for each number of dimensions."""
    vectors, ids = t.column("v").combine_chunks(), t.column("id").to_numpy()
    dims = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    return {int(d): (ids[dims == d], vectors.filter(pa.array(dims == d)).flatten().to_numpy().reshape(-1, int(d))) for d in np.unique(dims)}


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "vector", shard_rows: int = 8192, query_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), ``key``, score. ``vector`` is an array<double> column as ``quantized`` makes it; keys are longs, rows with null ones are left out.

    A task holds one shard and one group of queries: ``shard_rows`` and ``query_rows`` vectors, about. Every vector is copied once for each group of queries, and every
    query once for each shard.
    """
    live = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q")).filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    total, asked = live.agg(F.count("*"), F.count_if("q")).first()
    shards, groups = max(1, math.ceil(total / shard_rows)), max(1, math.ceil(asked / query_rows))
    count = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    dealt = live.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("s"), F.explode(count(groups)).alias("g"))
    queries = live.filter("q").select("id", "v", F.explode(count(shards)).alias("s"), F.pmod(F.xxhash64(F.lit(1), "id", "v"), F.lit(groups)).cast("int").alias("g"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        asked_here = by_dimension(b)
        for dims, (ids, rows) in by_dimension(a).items():
            lists = np.argsort(rows, axis=0, kind="stable").T
            most, objects = np.abs(rows).max(), None
            for own, q in zip(*asked_here.get(dims, ([], [])), strict=True):
                if most * np.abs(q).max() * dims < 2.0**53:
                    found = walk(rows, lists, ids, q, own, k)
                else:
                    objects = as_objects(rows) if objects is None else objects
                    found = walk(objects, lists, ids, as_objects(q), own, k)
                out += [(int(own), i, s) for s, i in found]
        return pa.table({name: pa.array([x[i] for x in out], pa.int64()) for i, name in enumerate(("query_id", "vec", "score"))})

    found = dealt.groupBy("s", "g").cogroup(queries.groupBy("s", "g")).applyInArrow(run, "query_id long, vec long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec").alias(key), "score")
