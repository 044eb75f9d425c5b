"""Packing pieces into sequences of a fixed capacity.

What is planned is the histogram of lengths, which has no more rows than the capacity, however many pieces
there are. A plan says, for the pieces of one length numbered from 0, which runs of numbers go to which
runs of sequences at which offset; the pieces, numbered in Spark, then look up their place.

``best_fit`` (op6): Martello-Toth reduction first. Taking the longest piece left, it fixes a set with that
piece that provably dominates every other set with it: the piece alone if nothing fits beside it; a
partner that fills the sequence exactly; the longest partner, if no two pieces fit beside the piece or if that
partner is at least as long as any two that fit together, where no three fit. What it cannot fix goes to best-fit decreasing.

``best_fit_decreasing`` (op4): the fullest sequence that still has room is found in a segment tree over capacities.

Defined cases: an empty table gives no rows; repeated pieces (equal in ``order``) each get a place of their own, in any order among them; nulls in ``order`` are
values like others. Lengths are 1 to the capacity and never null: a text, null or empty ones included, has its end id, and longer ones have been cut.
Ties between sequences of equal room go to the one opened last. Columns of the input pass through, whatever their names; ``sequence_id`` and ``offset`` are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, ranked, settle, small

RESULTS = ("sequence_id", "offset")
#: (length, first number, numbers, first sequence, offset)
Plan = list[tuple[int, int, int, int, int]]


class CapacityTree:
    """Segment tree over residual capacities 0..capacity: how many open sequences have each; finds the smallest one of at least some room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = self.size + room
        while i:
            self.count[i] += n
            i >>= 1

    def first(self, least: int) -> int:
        """The smallest room of at least ``least`` that a sequence has; -1 if none has."""
        i = self.size + least
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(histogram: dict[int, int], capacity: int, placed: dict[int, int] | None = None, first: int = 0) -> tuple[Plan, int]:
    """Lengths in falling order, each to the fullest sequence with room, whole runs of equal sequences at once.

    placed: numbers of each length that are taken already; first: the first free sequence. Returns the plan and the next free sequence.
    """
    tree, runs, plan = CapacityTree(capacity), defaultdict(list), []
    placed = dict(placed or {})
    for length in sorted(histogram, reverse=True):
        left = histogram[length] - placed.get(length, 0)
        while left > 0:
            room = tree.first(length)
            if room < 0:
                each = capacity // length
                full, rest = divmod(left, each)
                for n, k in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        for j in range(k):
                            plan.append((length, placed.get(length, 0), n, first, j * length))
                            placed[length] = placed.get(length, 0) + n
                        if spare := capacity - k * length:
                            runs[spare].append((first, n))
                            tree.add(spare, n)
                        first += n
                break
            start, n = runs[room].pop()
            took = min(n, left)
            tree.add(room, -took)
            if took < n:
                runs[room].append((start + took, n - took))
            plan.append((length, placed.get(length, 0), took, start, capacity - room))
            placed[length] = placed.get(length, 0) + took
            if spare := room - length:
                runs[spare].append((start, took))
                tree.add(spare, took)
            left -= took
    return plan, first


def reduce(histogram: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int], int]:
    """Fix the sets that dominate. Returns their plan, how many of each length are fixed, and the next free sequence."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    placed: dict[int, int] = defaultdict(int)
    plan: Plan = []
    first = 0

    def fix(lengths: list[int], n: int) -> None:
        nonlocal first
        offset = 0
        for x in lengths:
            plan.append((x, placed[x], n, first, offset))
            placed[x] += n
            left[x] -= n
            offset += x
        first += n

    for length in range(capacity, 0, -1):
        while left[length]:
            room = capacity - length
            there = left[: room + 1].copy()
            if length <= room:
                there[length] -= 1
            fits = np.flatnonzero(there)
            if not len(fits):
                fix([length], int(left[length]) if length > room else 1)
                continue
            partner = int(fits[-1])
            least = np.repeat(fits[:3], np.minimum(there[fits[:3]], 3))[:3]
            dominates = partner == room or len(least) < 2 or least[:2].sum() > room
            if not dominates and (len(least) < 3 or least.sum() > room):  # at most two fit beside it
                dominates = partner >= best_pair(there, fits, room)
            if not dominates:
                break
            n = int(left[length]) // 2 if partner == length else int(min(left[length], left[partner]))
            if n == 0 or not (partner == room or len(least) < 2 or least[:2].sum() > room):
                n = 1  # the proof holds for this set only: look again after it
            fix([length, partner], n)
    return plan, dict(placed), first


def best_pair(there: np.ndarray, fits: np.ndarray, room: int) -> int:
    """The longest sum of two pieces that fit into ``room`` together."""
    i, j, best = 0, len(fits) - 1, 0
    while i <= j:
        total = int(fits[i] + fits[j])
        if total > room or (i == j and there[fits[i]] < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[Plan, int]:
    plan, placed, first = reduce(histogram, capacity)
    rest, first = best_fit_decreasing(histogram, capacity, placed, first)
    return plan + rest, first


PLAN = "first long, last long, shift long, offset long"
#: Numbers that meet a run of the plan in one group of a join.
NUMBERS = 4096


def rows_of(plan: Plan) -> list[tuple[int, ...]]:
    """The plan as rows of (length, first number, last number, what is added to a number to make a sequence, offset)."""
    return [tuple(map(int, (length, first, first + n - 1, sequence - first, offset))) for length, first, n, sequence, offset in plan]


def looked_up(numbered: DataFrame, plan: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``numbered`` with ``sequence_id`` and ``offset``. A run of the plan meets the pieces of its keys by blocks of ``NUMBERS`` numbers, so no key is a group of its own."""
    block, first, last, shift, offset = (fresh(numbered, x) for x in ("block", "first", "last", "shift", "offset"))
    named = plan.select(*keys, F.col("first").alias(first), F.col("last").alias(last), F.col("shift").alias(shift), F.col("offset").alias(offset))
    laid = named.withColumn(block, F.explode(F.sequence(F.floor(F.col(first) / NUMBERS), F.floor(F.col(last) / NUMBERS))))
    met = numbered.withColumn(block, F.floor(F.col(number) / NUMBERS)).join(laid.hint("merge"), [*keys, block])
    found = met.filter((F.col(number) >= F.col(first)) & (F.col(number) <= F.col(last)))
    return found.withColumn("sequence_id", F.col(number) + F.col(shift)).withColumn("offset", F.col(offset)).drop(block, first, last, shift, offset, number)


def place(pieces: DataFrame, order: list[str], planner, capacity: int = 4096, length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to each piece. ``order`` names columns that tell the pieces apart; lengths are 1 to ``capacity``.

    The driver holds the histogram (at most ``capacity`` rows) and the plan. A length's turn opens one run of sequences more than it
    uses up, so the plan has a few rows for each pair of lengths that meet, whatever the number of pieces. It is written, and the pieces find
    their runs in a merge join by length and block of numbers.
    """
    pieces = pieces.drop(*RESULTS)
    spark: SparkSession = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    plan, _ = planner(histogram, capacity)
    table = settle(spark.createDataFrame(rows_of(plan), f"`{length}` long, {PLAN}"), "plan")
    number = fresh(pieces, "number")
    return looked_up(ranked(pieces, [length], order, number, sum(histogram.values())), table, [length], number)


def in_runs(pieces: DataFrame, stored: list[str], row: str, least: int, most: int = 50_000) -> DataFrame:
    """Add ``run``: the number of a stretch of ``least`` rows in stored order (more, so that there are ``most`` runs at most); a rest that has fewer joins the run before it.

    ``stored`` and ``row`` tell where a piece's document is stored (``common.stored``). What is ordered as a whole is one row for each file.
    """
    first, length = fresh(pieces, "first"), fresh(pieces, "length")
    before = Window.orderBy(*stored).rowsBetween(Window.unboundedPreceding, -1)
    lengths = settle(pieces.groupBy(*stored).agg((F.max(row) + 1).alias(length)), "files")
    files, rows = lengths.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
    begins = settle(lengths.withColumn(first, F.coalesce(F.sum(length).over(before), F.lit(0))).drop(length), "begins")
    least = max(least, math.ceil(rows / most))
    run = F.least(F.floor((F.col(first) + F.col(row)) / least), F.lit(max(0, rows // least - 1)))
    return pieces.join(small(begins, files), stored).withColumn("run", run.cast("long")).drop(first)


def place_runs(pieces: DataFrame, run: str, order: list[str], planner, capacity: int = 4096, length: str = "length") -> DataFrame:
    """As ``place``, for each run by itself: no sequence holds pieces of two runs, and sequences of a run come before those of the next.

    Each run's histogram is planned in a task; a run has so few pieces that those of one length in it are numbered at once (``in_runs`` bounds
    the number of runs, and so what the driver holds: a number for each).
    """
    pieces = pieces.drop(*RESULTS)
    spark: SparkSession = pieces.sparkSession

    def plan(t: pa.Table) -> pa.Table:
        made, n = planner(dict(zip(t.column("length").to_pylist(), t.column("count").to_pylist(), strict=True)), capacity)
        rows = [(t.column("run")[0].as_py(), *row, int(n)) for row in rows_of(made)]
        return pa.table({name: pa.array([row[i] for row in rows], pa.int64()) for i, name in enumerate(("run", "length", "first", "last", "shift", "offset", "used"))})

    counts = pieces.groupBy(F.col(run).cast("long").alias("run"), F.col(length).cast("long").alias("length")).agg(F.count("*").alias("count"))
    plans = settle(counts.groupBy("run").applyInArrow(plan, f"run long, length long, {PLAN}, used long"), "plans")
    used, first = [], 0
    for r, n in sorted(map(tuple, plans.select("run", "used").distinct().collect())):
        used.append((r, first))
        first += n
    begins = settle(spark.createDataFrame(used, "run long, begin long"), "begins")
    whole = plans.join(small(begins, len(used)), "run").withColumn("shift", F.col("shift") + F.col("begin"))
    own = [fresh(pieces, x) for x in ("run", "length")]
    number = fresh(pieces, "number")
    keyed = pieces.withColumn(own[0], F.col(run).cast("long")).withColumn(own[1], F.col(length).cast("long"))
    numbered = keyed.withColumn(number, F.row_number().over(Window.partitionBy(*own).orderBy(*order)) - 1)
    return looked_up(numbered, whole.withColumnsRenamed({"run": own[0], "length": own[1]}), own, number).drop(*own)
