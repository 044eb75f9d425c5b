"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector, and the fingerprint is the sum of
these vectors, each lane modulo a power of two: equal whatever the order of the paragraphs, and changed by one addition or
subtraction when a paragraph is inserted or deleted. The vector has

* ``EXACT`` lanes modulo 2**32, for equality: halves of hashes of whole paragraphs with different seeds;
* one lane that counts blocks, and ``COUNTERS`` counters modulo 2**31, two to a number, of the blocks of up to ``BLOCK`` characters
  that a paragraph is cut into: each block adds one random bit to each counter. Twice a counter less the count of blocks is a sum of random
  signs, so the squared distance of two fingerprints estimates how many blocks the texts do not share.

Likeness of two fingerprints: 1 - distance**2 / (norm**2 + norm**2), at least 0; 1 for equal ones. It estimates the shared
part of the blocks, with a standard error near 0.1.

Defined cases: null counts as empty, which is one empty paragraph without blocks; two empty texts have likeness 1, an empty and another
one 0. ``fingerprints`` sums repeated keys together, so keys must tell the rows apart; ``compare_edited`` takes any keys: null ones come
first, rows of one key follow each other by text, and each row, repeated ones too, keeps its own fingerprint and gives a row. A counter has room for the blocks of
any text that a row can hold. An empty table gives no rows; columns besides key and text are not used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

EXACT, COUNTERS, BLOCK = 8, 120, 48
LOW = (1 << 32) - 1
#: Counters of ``WIDE`` bits in one number, and the lowest bit of each.
EACH, WIDE = 2, 31
COMB = sum(1 << (WIDE * i) for i in range(EACH))
PACKED = COUNTERS // EACH
#: Bits of a hash that a counter takes: one at each shift and those ``WIDE`` further on.
SHIFTS = 30


def fingerprints(df: DataFrame, keys: list[str], text: str = "text", name: str = "fingerprint") -> DataFrame:
    """keys and the fingerprint of each whole text as array<bigint>: exact lanes, count of blocks, packed counters. ``hexed`` writes it as a string.

    Paragraphs and blocks become rows and are summed again at once, before anything is shuffled.
    """
    lines = df.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_line"))
    rows = lines.select("*", F.posexplode_outer(F.regexp_extract_all("_line", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("_pos", "_block"))
    hashes = [F.xxhash64(F.lit(1000 + i), "_block").alias(f"_h{i}") for i in range(PACKED // SHIFTS)]
    lanes = [F.when(F.coalesce("_pos", F.lit(0)) == 0, F.xxhash64(F.lit(i), "_line")).otherwise(F.lit(0)).alias(f"_e{i}") for i in range(EXACT // 2)]
    rows = rows.select(*keys, F.col("_block").isNotNull().alias("_has"), *hashes, *lanes)
    sums = [F.sum(half.bitwiseAND(F.lit(LOW))) for i in range(EXACT // 2) for half in (F.col(f"_e{i}"), F.shiftrightunsigned(f"_e{i}", 32))]
    counters = [F.sum(F.when(F.col("_has"), F.shiftrightunsigned(f"_h{i // SHIFTS}", i % SHIFTS).bitwiseAND(F.lit(COMB))).otherwise(F.lit(0))) for i in range(PACKED)]
    parts = [*sums, F.count_if("_has"), *counters]
    summed = rows.groupBy(*keys).agg(*(x.alias(f"_s{i}") for i, x in enumerate(parts)))
    vector = F.array(*(F.col(f"_s{i}").bitwiseAND(F.lit(LOW)) if i < EXACT else F.col(f"_s{i}") for i in range(len(parts))))
    return summed.select(*keys, vector.alias(name))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the union of two multisets; with sign -1, of ``a`` without its part ``b``."""
    both = F.zip_with(a, b, lambda x, y: x + y if sign > 0 else x - y)
    return F.transform(both, lambda x, i: F.when(i < EXACT, x.bitwiseAND(F.lit(LOW))).otherwise(x))


def signs(v: Column) -> Column:
    """Sums of random signs, one for each counter."""
    n = F.element_at(v, EXACT + 1)
    one = lambda x, j: (F.shiftright(x, WIDE * j).bitwiseAND(F.lit((1 << WIDE) - 1)) * 2 - n).cast("double")
    return F.flatten(F.transform(F.slice(v, EXACT + 2, PACKED), lambda x: F.array(*(one(x, j) for j in range(EACH)))))


def likeness(a: Column, b: Column, signs_a: Column, signs_b: Column) -> Column:
    square = lambda s: F.aggregate(s, F.lit(0.0), lambda t, x: t + x * x)
    apart = square(F.zip_with(signs_a, signs_b, lambda x, y: x - y))
    norms = square(signs_a) + square(signs_b)
    return F.when(a == b, F.lit(1.0)).when(norms == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - apart / norms))


def hexed(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(df: DataFrame, key: str, columns: list[str], row_bytes: Column, also: list[str] | None = None, range_bytes: int = 128 << 20, least: int = 64, ties: list[str] | None = None, number: str | None = None) -> DataFrame:
    """key, columns, also, and ``next_<column>`` of the row with the next larger key; the last row gets those of the first.

    Keys are dealt to ranges, whose bounds come from approximate percentiles, so many that each has about ``range_bytes`` by the sum of ``row_bytes``
    (``least`` at least). Each range also gets a copy of the row that follows it (a row for each range in all), so that one shuffle by range is enough.
    Null keys come first. Equal keys follow each other by ``ties``, or the columns; rows that are equal in these can change places without any effect.
    ``number``: a column to add that numbers the rows, each with a number of its own, in this order.
    """
    ties = ties or columns
    kept = df.select(key, *dict.fromkeys([*columns, *(also or []), *ties]))
    size, low, nulls = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)), F.min(key), F.count_if(F.col(key).isNull())).first()
    low = None if nulls else low  # the first key of all
    ranges = max(least, -(-int(size) // range_bytes))
    marks = kept.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges)).alias("p")).first()["p"] or []
    marks = sorted(set(marks))
    step = math.isqrt(len(marks)) + 1
    # every step-th mark first, then the marks after the one found; each list is one literal
    coarse, fine = (F.split(F.lit(",".join(map(str, m))), ",").cast("array<bigint>") for m in (marks[::step] or [low or 0], marks or [low or 0]))
    under = lambda a: F.size(F.filter(a, lambda m: m <= F.col(key)))
    block = under(coarse) - 1
    of = F.when(block < 0, 0).otherwise(block * step + under(F.slice(fine, F.greatest(block, F.lit(0)) * step + 1, F.lit(step)))) if marks else F.lit(0)
    dealt = kept.withColumn("_range", of)
    # a mark is a key, the first one of its range
    first = F.col(key).eqNullSafe(F.lit(low)) | (F.col(key) == F.get(fine, F.col("_range") - 1))
    others = [c for c in kept.columns if c not in (key, *ties)]
    edge = dealt.filter(first).groupBy(key, "_range").agg(F.min(F.struct(*ties, *others)).alias("_first")).select(key, "_range", "_first.*")
    to = F.when(F.col(key).eqNullSafe(F.lit(low)), len(marks)).otherwise(F.col("_range") - 1)
    both = dealt.withColumn("_edge", F.lit(0)).unionByName(edge.withColumn("_range", to).withColumn("_edge", F.lit(1)))
    w = Window.partitionBy("_range").orderBy("_edge", key, *ties)
    for c in columns:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    if number:
        both = both.withColumn(number, F.shiftleft(F.col("_range").cast("long"), 40) + F.row_number().over(w))
    return both.filter("_edge = 0").drop("_range", "_edge")


def edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``_row`` (a number of the row's own), ``n_chars``, the text, and ``edited``: the last half of the text replaced by as much of the beginning of the next one."""
    both = with_next(df.select(key, F.coalesce(text, F.lit("")).alias(text)), key, [text], F.octet_length(text) + 32, number="_row")
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    changed = F.concat(F.substring(F.col(text), F.lit(1), n - half), F.substring(F.col(f"next_{text}"), F.lit(1), half))
    return both.select(key, "_row", n.cast("long").alias("n_chars"), text, changed.alias("edited"))


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint each text and its edited form; likeness of the text to that form and to the next text, by ascending key."""
    both = edited(df, key, text).select(key, "_row", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col(text).alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("_f"))
    made = fingerprints(both.select(key, "_row", "n_chars", "edited_sha256", "_f.which", "_f.t"), [key, "_row", "n_chars", "edited_sha256", "which"], "t", "v")
    pick = lambda w: F.max(F.when(F.col("which") == w, F.col("v")))
    wide = settle(made.groupBy(key, "_row", "n_chars", "edited_sha256").agg(pick(0).alias("v"), pick(1).alias("edited_v")), "fingerprints")
    wide = with_next(wide, key, ["v"], F.lit(1024), also=["n_chars", "edited_sha256", "edited_v"], ties=["_row"])
    wide = wide.withColumn("_a", signs(F.col("v"))).withColumn("_b", signs(F.col("edited_v"))).withColumn("_c", signs(F.col("next_v")))
    near = lambda x, s: likeness(F.col("v"), F.col(x), F.col("_a"), F.col(s))
    return wide.select(key, "n_chars", "edited_sha256", hexed(F.col("v")).alias("fingerprint"), hexed(F.col("edited_v")).alias("edited_fingerprint"), near("edited_v", "_b").alias("near_edited"), near("next_v", "_c").alias("near_next"))
