"""Which pages hold the beginning of a question.

A fingerprint is the first characters of a question without white space and private-use characters. Pages are never joined as texts: a Bloom filter of the hashes of all distinct
fingerprints goes to the tasks, each page slides a window over its own text there, and only windows that pass become rows, of 128 bits of hash and a page number. These meet the
fingerprints by hash. Fingerprints of full length are tried at each character; shorter ones, beginnings of short questions, only where their first ``least`` characters pass a filter of their own.

The filter takes 12 to 24 bits a fingerprint, in one pass over the pages, up to ``MOST_BITS`` (so up to 22 million fingerprints; about one window in 300 passes in vain). Beyond that there are more passes, each with the fingerprints and pages
of some of the sources; a source with more than a filter holds lets more windows pass, and nothing else changes. What comes to the driver is the filter, 32 MB at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..functions import text as T
from ..sources.shared import written

MOST_BITS, PROBES = 1 << 28, 3
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
#: Characters of page text that are hashed at once.
PIECE = 1 << 19
ANYWHERE = np.uint64(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``; no two values fall together."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def scope(source: str | None) -> np.uint64:
    """Fingerprints of a source are sought in its pages, those without one in all."""
    return ANYWHERE if source is None else np.uint64(xxh3_64_intdigest(source) | 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


# The characters that Unicode calls white space.
BLANKS = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
DROPPED = np.zeros(0x110000, bool)
DROPPED[BLANKS] = DROPPED[0xE000:0xF900] = True


def normal(text: str) -> np.ndarray:
    """As ``pua_normalize``: the characters that are neither white space nor private."""
    c = code_points(text)
    return c[~DROPPED[c]]


def windows(chars: np.ndarray, width: int, at: np.ndarray | None = None, base: np.uint64 = BASES[0]) -> np.ndarray:
    """A polynomial hash of ``width`` characters from each place on, or from some places: of halves that double."""
    if at is not None:
        out = np.zeros(len(at), np.uint64)
        for i in range(width):
            out = out * base + chars[at + i] + np.uint64(1)
        return out
    power, have, out, done = chars + np.uint64(1), 1, None, 0
    n = len(chars) - width + 1
    while done < width:
        if width & have:
            piece = power[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(int(base), have, 1 << 64)) + piece
            done += have
        if 2 * have <= width:
            power = power[: len(power) - have] * np.uint64(pow(int(base), have, 1 << 64)) + power[have:]
        have *= 2
    return out


def positions(key: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for i in range(PROBES):
        yield (key >> np.uint64(20 * i)) % np.uint64(bits)


class Filter:
    """Bits of a Bloom filter, in words of 64."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def passes(self, key: np.ndarray) -> np.ndarray:
        """The indices of the keys that may be among the sought ones."""
        left = np.arange(len(key))
        for probe in positions(key, 64 * len(self.words)):
            p = probe[left]
            left = left[(self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
        return left


def filter_of(keys: DataFrame, n: int) -> Filter:
    """The filter of the column ``key``, of about ``n`` distinct values: bits are set by words where they fall."""
    bits = min(MOST_BITS, max(1024, 1 << math.ceil(math.log2(12 * max(1, n)))))
    probes = F.array(*(F.pmod(F.shiftrightunsigned("key", 20 * i), F.lit(bits)) for i in range(PROBES)))  # bits is a power of two, so the sign does not matter
    placed = keys.select(F.explode(probes).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("mask"))
    got = placed.toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return Filter(words)


def keyed(questions: DataFrame, least: int, chars: int) -> DataFrame:
    """id, source, size and hashes of each fingerprint of at least ``least`` characters; ``start``: the hash of its first ones, if it is shorter than ``chars``."""
    fp = questions.select("id", "source", T.fingerprint("question_text", chars).alias("fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater_equal(pc.utf8_length(batch["fp"]), least))
            if not batch.num_rows:
                continue
            size = pc.utf8_length(batch["fp"]).to_numpy().astype(np.int64)
            c, s = code_points("".join(batch["fp"].to_pylist())).astype(np.uint64), np.array([scope(x) for x in batch["source"].to_pylist()], np.uint64)
            begin = np.cumsum(size) - size
            start = np.where(size < chars, mixed(windows(c, least, begin) ^ s), np.uint64(0))
            key, check = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            for n in np.unique(size).tolist():
                of = size == n
                key[of], check[of] = windows(c, n, begin[of]), windows(c, n, begin[of], BASES[1])
            longs = [pa.array(x.view(np.int64)) for x in (mixed(key ^ s), mixed(check ^ s), start)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["source"], pa.array(size, pa.int32()), *longs], names=["id", "source", "size", "key", "check", "start"])

    return fp.mapInArrow(run, f"id {fp.schema['id'].dataType.simpleString()}, source string, size int, key long, check long, start long")


def found_windows(pages: DataFrame, long: Filter | None, short: tuple[Filter, Filter, list[int]] | None, anywhere: bool, least: int, chars: int) -> DataFrame:
    """key, check, source, page_no of the windows that pass, each once for a page."""
    body = pages.select(F.col("source").cast("string"), "page_no", F.col("text").alias("body"))
    shared = pages.sparkSession.sparkContext.broadcast((long, short))

    def hits(c: np.ndarray, s: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places, keys and checks of what passes. s, end: for each character what is mixed in and where its text ends."""
        long, short = shared.value
        if long is not None and len(c) >= chars:
            k = mixed(windows(c, chars) ^ s[: len(c) - chars + 1])
            at = long.passes(k)
            at = at[at + chars <= end[at]]
            yield at, k[at], mixed(windows(c, chars, at, BASES[1]) ^ s[at])
        if short is not None and len(c) >= least:
            starts, ends, sizes = short
            h = windows(c, least)
            at = starts.passes(mixed(h ^ s[: len(h)]))
            at = at[at + least <= end[at]]
            h, done = h[at], least
            for n in sizes:
                left = at + n <= end[at]
                at, h = at[left], h[left]
                for i in range(done, n):
                    h = h * BASES[0] + c[at + i] + np.uint64(1)
                done = n
                k = mixed(h ^ s[at])
                some = ends.passes(k)
                yield at[some], k[some], mixed(windows(c, n, at[some], BASES[1]) ^ s[at[some]])

    def passed(some: list[tuple[int, np.uint64, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pages, keys and checks of texts (page, what is mixed in, text), each key once for a page."""
        c = np.concatenate([t for _, _, t in some]).astype(np.uint64)
        size = np.array([len(t) for _, _, t in some])
        page, s, end = (np.repeat(x, size) for x in (np.array([i for i, _, _ in some]), np.array([x for _, x, _ in some], np.uint64), np.cumsum(size)))
        found = [(page[at], k, v) for at, k, v in hits(c, s, end) if len(at)]
        if not found:
            return []
        at, k, v = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((v, k, at))
        at, k, v = at[order], k[order], v[order]
        new = np.append(True, (at[1:] != at[:-1]) | (k[1:] != k[:-1]) | (v[1:] != v[:-1]))
        return [(at[new], k[new], v[new])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held, size = [], [], 0
            for i, (source, text) in enumerate(zip(batch["source"].to_pylist(), pc.fill_null(batch["body"], "").to_pylist(), strict=True)):
                scopes = ([] if source is None else [scope(source)]) + ([ANYWHERE] if anywhere else [])
                body = normal(text)
                for a in range(0, len(body), PIECE):
                    part = body[a : a + PIECE + chars - 1]
                    held += [(i, s, part) for s in scopes]
                    size += len(part) * len(scopes)
                    if size >= PIECE:
                        found += passed(held)
                        held, size = [], 0
            found += passed(held) if held else []
            at, k, v = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(v.view(np.int64)), batch["source"].take(at), batch["page_no"].take(at)], names=["key", "check", "source", "page_no"])

    return body.mapInArrow(run, f"key long, check long, source string, page_no {body.schema['page_no'].dataType.simpleString()}")


def fingerprint_pages(questions: DataFrame, pages: DataFrame, first_only: bool = True, least: int = 5, chars: int = 40, most: int = MOST_BITS // 12) -> DataFrame:
    """id, source, page_no: questions whose fingerprint stands in a page of their source; questions without a source are sought in all pages.

    questions: id, source, question_text; pages: source, page_no, text. The first page only (of the least source, then number), or all. Fingerprints under ``least`` characters and null texts
    meet nothing; pages without a source meet questions without one only. most: fingerprints of a pass.
    """
    asked = written(keyed(questions, least, chars))
    counts = {(r.is_short, r.anywhere): r for r in asked.groupBy((F.col("size") < chars).alias("is_short"), F.col("source").isNull().alias("anywhere")).agg(F.approx_count_distinct("key").alias("n"), F.collect_set("size").alias("sizes")).collect()}
    total = sum(r.n for r in counts.values())
    passes, anywhere = max(1, math.ceil(total / most)), any(a for _, a in counts)

    def part(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(passes))

    met = []
    for p in range(passes if counts else 0):
        here = asked if passes == 1 else asked.filter(F.col("source").isNull() | (part("source") == p))
        some = pages if passes == 1 else pages.filter(part("source") == p)
        n = {s: sum(r.n for (k, _), r in counts.items() if k is s) / passes for s in (False, True)}
        long = filter_of(here.filter(F.col("size") == chars).select("key"), math.ceil(n[False])) if n[False] else None
        short = None
        if n[True]:
            few, sizes = here.filter(F.col("size") < chars), sorted({x for (k, _), r in counts.items() if k for x in r.sizes})
            short = filter_of(few.select(F.col("start").alias("key")), math.ceil(n[True])), filter_of(few.select("key"), math.ceil(n[True])), sizes
        met.append(found_windows(some, long, short, anywhere, least, chars))
    if not met:
        return asked.select("id", "source").join(pages.select("page_no").limit(0), F.lit(False)).select("id", "source", "page_no")
    found = reduce(DataFrame.unionByName, met)
    first = found.groupBy("key", "check").agg(F.min(F.struct("source", "page_no")).alias("page")).select("key", "check", "page.*") if first_only else found.distinct()
    return asked.select("id", "key", "check").join(first.hint("merge"), ["key", "check"]).select("id", "source", "page_no")
