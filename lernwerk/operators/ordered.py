"""Sums and last values along an ordered key, without one task for a whole group.

A group is cut into ranges of its order, a whole number. Each range is worked out by itself and completed by what the ranges before it give; only one row for each
range is ordered in one task. Null groups are a group, a null order comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the order in a range.
RANGE = 4096


def along(rows: DataFrame, group: str, order: str, name: str, of_range: Column, of_ranges, within, width: int) -> DataFrame:
    """Rows with ``name`` from two parts: over the earlier rows of the range, and over the earlier ranges."""
    cut = rows.withColumn("_range", F.floor(F.col(order) / width))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = cut.groupBy(group, "_range").agg(of_range.alias("_v")).select(F.col(group).alias("_g"), F.col("_range").alias("_r"), of_ranges(F.col("_v"), before).alias("_before"))
    own = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = cut.join(earlier.hint("merge"), F.col(group).eqNullSafe(F.col("_g")) & F.col("_range").eqNullSafe(F.col("_r")))
    return met.withColumn(name, within(F.col("_before"), own)).drop("_range", "_g", "_r", "_before")


def sum_before(rows: DataFrame, group: str, order: str, value: str, name: str, width: int = RANGE) -> DataFrame:
    """``name``: the sum of ``value`` over the earlier rows of the group, 0 for the first. Null values count as 0."""
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    return along(rows, group, order, name, F.sum(value), total, lambda before, own: before + total(F.col(value), own), width)


def last_before(rows: DataFrame, group: str, order: str, value: str, name: str, width: int = RANGE) -> DataFrame:
    """``name``: the last ``value`` that is not null in the earlier rows of the group."""
    at = F.when(F.col(value).isNotNull(), F.struct(F.lit(1).alias("is_there"), F.col(order).alias("at")))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    return along(rows, group, order, name, F.max_by(value, at), last, lambda before, own: F.coalesce(last(F.col(value), own), before), width)


def carried(rows: DataFrame, group: str, order: list[str], lasts: dict[str, Column], sums: dict[str, Column] | None = None, width: int = RANGE) -> DataFrame:
    """Rows with, up to and with each, the last value that is not null (``lasts``) and the sum (``sums``) along a composite order.

    The first column of ``order`` is a whole number, which ranges are cut by; the others order the rows of one number. Each range is worked out by itself; of earlier ranges one row each is carried on.
    """
    sums = sums or {}
    cut = rows.withColumns({"_range": F.floor(F.col(order[0]) / width), **{f"_l{i}": c for i, c in enumerate(lasts.values())}, **{f"_s{i}": c for i, c in enumerate(sums.values())}})
    at = F.struct(*(F.struct(F.col(o).isNotNull().alias("there"), F.col(o).alias("at")) for o in order))
    last_of = [F.max_by(f"_l{i}", F.when(F.col(f"_l{i}").isNotNull(), at)).alias(f"_l{i}") for i in range(len(lasts))]
    sum_of = [F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(sums))]
    before = Window.partitionBy(group).orderBy(F.asc_nulls_first("_range")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = cut.groupBy(group, "_range").agg(*last_of, *sum_of).select(F.col(group).alias("_g"), F.col("_range").alias("_r"), *(F.last(f"_l{i}", ignorenulls=True).over(before).alias(f"_bl{i}") for i in range(len(lasts))), *(F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_bs{i}") for i in range(len(sums))))
    own = Window.partitionBy(group, "_range").orderBy(*(F.asc_nulls_first(o) for o in order)).rowsBetween(Window.unboundedPreceding, 0)
    met = cut.join(earlier.hint("merge"), F.col(group).eqNullSafe(F.col("_g")) & F.col("_range").eqNullSafe(F.col("_r")))
    out = {name: F.coalesce(F.last(f"_l{i}", ignorenulls=True).over(own), f"_bl{i}") for i, name in enumerate(lasts)}
    out |= {name: F.coalesce(F.sum(f"_s{i}").over(own), F.lit(0)) + F.col(f"_bs{i}") for i, name in enumerate(sums)}
    return met.withColumns(out).drop("_range", "_g", "_r", *(f"{x}{i}" for x in ("_l", "_bl") for i in range(len(lasts))), *(f"{x}{i}" for x in ("_s", "_bs") for i in range(len(sums))))
