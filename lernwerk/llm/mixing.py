"""Mixing sources to target weights by Pfair scheduling.

Weights are rounded to whole shares of a period of ``period`` slots. Block i of a source with share n gets the release time i * period / n
and the deadline (i + 1) * period / n; in each slot, earliest deadline first runs among the released blocks. That is a Pfair schedule: at every
slot, each source is less than one block away from its share. As shares are whole, the schedule repeats after one period, so only one
period is planned on the driver (``period`` slots, whatever the number of rows); block j of a source then finds its slot by
arithmetic. Rows of a source are numbered in Spark by a hash order, without sorting a source in one task.

A source that runs out leaves its slots empty; the others keep theirs, and so their proportions to each other. ``in_mix`` is true up to the slot where the first
source runs out, where the target weights hold for all. No row is dropped.

Defined cases: a null source is a source of its own; repeated keys are ordered arbitrarily but stay; an empty table gives an empty result. Columns
of the input pass through, whatever their names; ones named like a result are replaced. Ties in the schedule go to the name first in order. Texts are not looked at.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, ranked, settle, small

RESULTS = ("block", "slot", "place", "in_mix")


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares, at least 1, that add up to the period: largest remainders first, ties by name."""
    if not weights:
        return {}
    period = max(period, len(weights))
    total = sum(weights.values())
    exact = {k: w / total * (period - len(weights)) for k, w in weights.items()}
    out = {k: 1 + math.floor(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], k))[: period - sum(out.values())]:
        out[k] += 1
    return out


def schedule(share: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source within one period, by earliest deadline first among released blocks; ties by name."""
    period = sum(share.values())
    slots: dict[str, list[int]] = {k: [] for k in share}
    waiting = [(0, k) for k in sorted(share)]  # (release, source)
    ready: list[tuple[int, str]] = []  # (deadline, source)
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[k]) + 1) * period // share[k]), k))
        _, k = heapq.heappop(ready)
        slots[k].append(slot)
        if len(slots[k]) < share[k]:
            heapq.heappush(waiting, (len(slots[k]) * period // share[k], k))
    return slots


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", key: str = "doc_id", block_rows: int = 8, period: int = 1000, power: float = 0.5) -> DataFrame:
    """Add ``block`` (within the source), ``slot`` (of the whole mix), ``place`` (of the row in its block) and ``in_mix``.

    weights: by source; missing ones count as the smallest given. None: rows of the source to the ``power``, which draws large sources down.
    """
    docs = docs.drop(*RESULTS)
    name, number, share_of, turn, at = (fresh(docs, x) for x in ("source", "number", "share", "turn", "at"))
    named = docs.withColumn(name, F.coalesce(F.col(source).cast("string"), F.lit("\u0000null")))
    n = {r[0]: r[1] for r in named.groupBy(name).count().collect()}
    if weights is None:
        wanted = {k: c**power for k, c in n.items()}
    else:
        least = min(weights.values(), default=1.0)
        wanted = {k: weights.get(k, least) for k in n}
    share = shares(wanted, period)
    length = max(1, sum(share.values()))
    slots = schedule(share)
    runs_out = min((math.ceil(c / block_rows) // share[k] * length + (slots[k] + [length])[math.ceil(c / block_rows) % share[k]] for k, c in n.items()), default=0)
    spark: SparkSession = docs.sparkSession
    of_source = settle(spark.createDataFrame(sorted(share.items()), f"{name} string, {share_of} long"), "shares")
    turns = [(k, i, s) for k, v in slots.items() for i, s in enumerate(v)]
    table = settle(spark.createDataFrame(turns, f"{name} string, {turn} long, {at} long"), "schedule")
    numbered = ranked(named, [name], [key], number, sum(n.values())).withColumn("block", F.floor(F.col(number) / block_rows).cast("long")).withColumn("place", (F.col(number) % block_rows).cast("int"))
    # one row for each source, and one for each slot of a period
    with_share = numbered.join(small(of_source, len(share)), name).withColumn(turn, F.col("block") % F.col(share_of))
    met = with_share.join(small(table, len(turns)), [name, turn])
    slot = F.floor(F.col("block") / F.col(share_of)).cast("long") * length + F.col(at)
    return met.withColumn("slot", slot).withColumn("in_mix", F.col("slot") < F.lit(runs_out)).drop(name, turn, share_of, at, number)
