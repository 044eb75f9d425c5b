"""Removal of repeated passages by prefix-free parsing.

A window is ``length`` bytes of one document. A rolling hash of ``GRAM`` bytes sets triggers: the trigger of a window is its gram of least hash, the
leftmost of equals. So every window has one, windows of equal content have the same one at the same place, and the windows of one trigger
form a run. The bytes under such a run are a phrase; phrases overlap by length - 1 bytes, and every window lies in just one.

1. Parse: each document becomes phrases. Of equal phrases in one block of documents, all but the first (smallest document id, then place) are repeats,
   and only the first goes on, as two hashes and a place.
2. Dictionary: phrases meet by trigger. Of equal ones, all but the first in parse order are repeats. A trigger with one distinct phrase is done.
   Triggers with more phrases than a task should hold, as at the edges of a line that is in most documents, are looked for in the buckets that are too full,
   and there alone; their phrases are merged where they lie and meet by trigger and phrase.
3. Only where a trigger has several distinct phrases, at the edges of repeats, bytes are fetched, and the suffixes of these dictionary phrases, as far as
   ``length`` bytes, are sorted, trigger by trigger; in each run of equal suffixes, all but the first in parse order are repeats. Triggers with more than ``HOT``
   distinct phrases are dealt by the hash of the window instead, after equal windows of a task have been merged, so no trigger is too large for a task.
4. The repeats of a document, from all steps, are cut from its text.

Where bytes are not compared, two hashes of 64 bits decide, that of the trigger and that of the phrase or window: of n distinct windows two unlike ones fall together with a probability of about n * n / 2**129 (1 in 5 * 10**10 for the 10**14 bytes of 100 TB). A window is 100 bytes, so no suffix has to be followed into the next phrase
and the parse needs no suffix array of its own: its order of phrases is what tells which of equal ones is the first.

Defined cases: a null text is empty; rows of one key and unlike texts are documents of their own, one after the other by the hash of the text, and those with a null key come last, likewise; texts under ``length`` bytes keep all; a row that comes twice with one key and text is
one document, cut twice alike. Bytes are those of UTF-8, and a cut may
fall within a character, so the kept text is binary. Columns besides key and text are not used.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, pieces_of, settle
from .tokens import spread

GRAM, HOT = 32, 256
#: Phrases of a bucket beyond which its triggers are counted. One of them with an eighth of that is dealt by phrase.
MOST_PHRASES = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LETTER = mix64(np.arange(1, 257, dtype=np.uint64))


def rolling(raw: np.ndarray, gram: int) -> np.ndarray:
    """A scrambled hash of the ``gram`` bytes (a power of two) from each place on; shorter than ``raw`` by gram - 1."""
    h, size = LETTER[raw], 1
    while size < gram:
        step = np.uint64(pow(int(BASE), size, 1 << 64))
        h = h[:-size] * step + h[size:]
        size *= 2
    return mix64(h)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Hashes:
    """Hash of any stretch of bytes, by sums of powers modulo 2**64."""

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        powers = np.full(n, BASE, np.uint64)
        powers[0] = 1
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(LETTER[raw] * np.multiply.accumulate(powers)[:-1], out=self.sums[1:])
        powers = np.full(n, INVERSE, np.uint64)
        powers[0] = 1
        self.back = np.multiply.accumulate(powers)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start])


def parse(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Phrases of texts that lie in a row: trigger hash, trigger place, first and last window (places in ``raw``)."""
    n_windows = np.maximum(sizes - length + 1, 0)
    windows = spread(starts, n_windows)
    if not len(windows):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    width = length - GRAM + 1
    h = rolling(raw, GRAM)
    least = sliding_least(h, width)
    of = least[windows]
    new_text = np.zeros(len(windows), bool)
    new_text[(np.cumsum(n_windows) - n_windows)[n_windows > 0]] = True
    change = new_text.copy()
    change[1:] |= of[1:] != of[:-1]
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(windows)) - 1
    value, lo, hi = of[first], windows[first], windows[last]
    place = lo + width - 1
    old = new_text[first] | (h[np.minimum(place, len(h) - 1)] != value)
    old[1:] |= value[1:] > of[first[1:] - 1]
    seek = np.flatnonzero(old)
    for a in range(0, len(seek), 1 << 14):
        some = seek[a : a + (1 << 14)]
        place[some] = lo[some] + np.argmin(h[lo[some][:, None] + np.arange(width)], axis=1)
    again = np.flatnonzero(hi > place)  # the gram comes more than once: in repetitive text
    if len(again):
        more = []
        for r in again.tolist():
            at = lo[r] + np.flatnonzero(h[lo[r] : hi[r] + width] == value[r])
            at = at[: np.searchsorted(at, hi[r]) + 1]
            begin = np.concatenate([[lo[r]], at[:-1] + 1])
            more.append(np.stack([np.full(len(at), r), at, begin, np.minimum(at, hi[r])]))
        m = np.concatenate(more, axis=1)
        rest = np.setdiff1d(np.arange(len(lo)), again, assume_unique=True)
        value = np.concatenate([value[rest], value[m[0]]])
        place, lo, hi = (np.concatenate([x[rest], y]) for x, y in zip((place, lo, hi), m[1:], strict=True))
    return value, place, lo, hi


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length as one compressed string: bytes of equal rank side by side."""
    n = len(columns[0])
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns))


def unpack(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    parts = []
    for blob in blobs:
        n, raw, at, out = int.from_bytes(blob[:8], "little"), zstandard.ZstdDecompressor().decompress(blob[8:]), 0, []
        for kind in kinds:
            k = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * k, at).reshape(k, n).T).view(kind).ravel())
            at += n * k
        parts.append(out)
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kinds[i]) for i in range(len(kinds))]


def dealt(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each bucket, in their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        yield int(bucket[order[a]]), [c[order[a:b]] for c in columns]


def doc_buckets(doc: np.ndarray, n: int) -> np.ndarray:
    distinct, at = np.unique(doc, return_inverse=True)
    return np.fromiter((zlib.crc32(str(x).encode()) % n for x in distinct.tolist()), np.int64, len(distinct))[at]


# What the packed columns hold.
PHRASE = ["<u8", "<u8", "<i8", "<i4", "u1", "u1"]  # trigger, phrase, document, first window, windows - 1, place of the trigger
REPEAT = ["<i8", "<i4", "<i4"]  # document, first and last window
UNSURE = ["<u8", "<i8", "<i4", "u1", "u1"]  # trigger, document, first window, windows - 1, hot
WINDOW = ["<u8", "<u8", "<i8", "<i4"]  # trigger, window, document, place


def rows(kind: str, found: Iterator[tuple[int, list[np.ndarray]]]) -> list[tuple[str, int, bytes]]:
    return [(kind, b, pack(c)) for b, c in found]


def table(out: list[tuple[str, int, bytes]]) -> pa.Table:
    size = [int.from_bytes(x[2][:8], "little") for x in out]
    return pa.table({"kind": pa.array([x[0] for x in out], pa.string()), "bucket": pa.array([x[1] for x in out], pa.int64()), "n": pa.array(size, pa.int64()), "blob": pa.array([x[2] for x in out], pa.binary())})


SCHEMA = "kind string, bucket long, n long, blob binary"  # n: rows of the packed columns, for phrases


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Runs of windows of a document, by place, that touch become one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return [doc, lo, hi]
    new = np.append(True, (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1))
    first = np.flatnonzero(new)
    return [doc[first], lo[first], np.maximum.reduceat(hi, first)]


def repeated(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_docs: int) -> list[tuple[str, int, bytes]]:
    doc, lo, hi = merged(doc.astype(np.int64), lo.astype(np.int32), hi.astype(np.int32))
    return rows("repeat", dealt(doc_buckets(doc, n_docs), [doc, lo, hi]))


def not_first(keys: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys and then by parse order; whether the row in that order follows one of equal keys elsewhere."""
    order = np.lexsort((place, doc, *keys[::-1]))
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    return order, elsewhere(np.append(False, same)[: len(order)], doc[order], place[order])


def elsewhere(same: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """same: whether a row equals the one before. Whether it stands at another place than the first of its run; the same place comes twice if a row of the table does."""
    first = np.flatnonzero(~same)
    head = np.repeat(first, np.diff(np.append(first, len(same))))
    return same & ((doc != doc[head]) | (place != place[head]))


def first_step(length: int, n_buckets: int, n_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces_of(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), 4 << 20):
                texts, ids = batch.column(1).slice(a, b - a), batch.column(0).slice(a, b - a).to_numpy()
                sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                raw = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
                trigger, place, lo, hi = parse(raw, starts, sizes, length)
                if not len(lo):
                    continue
                phrase = Hashes(raw).of(lo, hi + length)
                text = np.searchsorted(starts, lo, side="right") - 1
                doc, lo, hi, place = ids[text], lo - starts[text], hi - starts[text], place - starts[text]
                order, later = not_first([trigger, phrase, place - lo], doc, lo)
                kept, gone = order[~later], order[later]
                kept = kept[np.lexsort((lo[kept], doc[kept]))]
                columns = [trigger[kept], phrase[kept], doc[kept], lo[kept].astype(np.int32), (hi - lo)[kept].astype(np.uint8), (place - lo)[kept].astype(np.uint8)]
                out = rows("phrase", dealt((columns[0] % np.uint64(n_buckets)).astype(np.int64), columns)) + repeated(doc[gone], lo[gone], hi[gone], n_docs)
                yield from table(out).to_batches()

    return run


def count_triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            trigger, n = np.unique(unpack([blob], PHRASE)[0], return_counts=True)
            yield pa.record_batch({"trigger": pa.array(trigger.view(np.int64)), "n": pa.array(n, pa.int64())})


def merge_hot(hot: np.ndarray, n_buckets: int, n_docs: int, most: int = 1 << 20):
    """Phrases of hot triggers, merged up to ``most`` at a time and dealt by trigger and phrase, to buckets beyond the others; the rest as it is."""

    def emit(held: list[list[np.ndarray]]) -> list[tuple[str, int, bytes]]:
        trigger, phrase, doc, lo, more, at = columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        order, later = not_first([trigger, phrase, at], doc, lo)
        gone, kept = order[later], np.sort(order[~later])
        bucket = n_buckets + (mix64(trigger[kept] ^ phrase[kept]) % np.uint64(n_buckets)).astype(np.int64)
        return rows("phrase", dealt(bucket, [c[kept] for c in columns])) + repeated(doc[gone], lo[gone], lo[gone] + more[gone], n_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = unpack([blob], PHRASE)
                is_hot = np.isin(columns[0], hot)
                if not is_hot.all():
                    yield from table([("phrase", bucket, pack([c[~is_hot] for c in columns]))]).to_batches()
                if is_hot.any():
                    held.append([c[is_hot] for c in columns])
                    n += int(is_hot.sum())
                if n >= most:
                    yield from table(emit(held)).to_batches()
                    held, n = [], 0
        if held:
            yield from table(emit(held)).to_batches()

    return run


def spread_hot(parsed: DataFrame, n: int, most: int) -> DataFrame:
    """Parsed rows with the phrases of hot triggers dealt by phrase. The driver holds the numbers of the full buckets, at most one for
    ``most`` phrases, and the hot triggers, at most one for an eighth of them."""
    phrases = parsed.filter("kind = 'phrase'")
    full = [r.bucket for r in phrases.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("bucket").collect()]
    if not full:
        return parsed
    is_full = (F.col("kind") == "phrase") & F.col("bucket").isin(full)
    counted = parsed.filter(is_full).select("blob").mapInArrow(count_triggers, "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n"))
    hot = np.array([r.trigger for r in counted.filter(F.col("n") > most // 8).select("trigger").collect()], np.int64).view(np.uint64)
    if not len(hot):
        return parsed
    return settle(parsed.filter(~is_full).unionByName(parsed.filter(is_full).select("bucket", "blob").mapInArrow(merge_hot(hot, n, n), SCHEMA)), "spread")


def second_step(n_docs: int, n_buckets: int):
    """Buckets from ``n_buckets`` on hold phrases of hot triggers, which have others elsewhere."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        trigger, phrase, doc, lo, more, at = unpack(t.column("blob").to_pylist(), PHRASE)
        order, later = not_first([trigger, phrase, at], doc, lo)
        gone, kept = order[later], order[~later]
        new = np.flatnonzero(np.append(True, trigger[kept][1:] != trigger[kept][:-1]))
        count = np.repeat(np.diff(np.append(new, len(kept))), np.diff(np.append(new, len(kept))))
        if key[0].as_py() >= n_buckets:
            count = np.full(len(kept), HOT + 1)
        kept, count = kept[count > 1], count[count > 1]
        unsure = [trigger[kept], doc[kept], lo[kept], more[kept], (count > HOT).astype(np.uint8)]
        return table(repeated(doc[gone], lo[gone], lo[gone] + more[gone], n_docs) + rows("unsure", dealt(doc_buckets(doc[kept], n_docs), unsure)))

    return run


def third_step(length: int, n_buckets: int):
    """From texts and unsure phrases: phrases with their bytes, to be sorted by trigger; windows of hot triggers."""

    def run(texts: pa.Table, t: pa.Table) -> pa.Table:
        trigger, doc, lo, more, hot = unpack(t.column("blob").to_pylist(), UNSURE)
        if not len(doc) or not texts.num_rows:
            return table([])
        ids = texts.column("doc_id").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        body = texts.column("body").to_pylist()
        out: list[tuple[str, int, bytes]] = []
        at = by_id[np.searchsorted(ids[by_id], doc)]
        size = more.astype(np.int64) + length
        cold = np.flatnonzero(hot == 0)
        for b, (g, d, p, m, i, n) in dealt((trigger[cold] % np.uint64(n_buckets)).astype(np.int64), [x[cold] for x in (trigger, doc, lo, more, at, size)]):
            raw = b"".join(body[j][s : s + k] for j, s, k in zip(i.tolist(), p.tolist(), n.tolist(), strict=True))
            blob = pack([g, d, p, m])
            out.append(("bytes", b, len(blob).to_bytes(8, "little") + blob + zstandard.ZstdCompressor(level=1).compress(raw)))
        warm = np.flatnonzero(hot)
        for a in range(0, len(warm), 1 << 15):
            some = warm[a : a + (1 << 15)]
            raw = np.frombuffer(b"".join(body[j][s : s + k] for j, s, k in zip(at[some].tolist(), lo[some].tolist(), size[some].tolist(), strict=True)), np.uint8)
            n = more[some].astype(np.int64) + 1
            start = spread(np.cumsum(size[some]) - size[some], n)
            window = Hashes(raw).of(start, start + length)
            place, d, g = spread(lo[some].astype(np.int64), n), np.repeat(doc[some], n), np.repeat(trigger[some], n)
            order, later = not_first([g, window], d, place)
            kept, gone = order[~later], order[later]
            out += rows("window", dealt((window[kept] % np.uint64(n_buckets)).astype(np.int64), [g[kept], window[kept], d[kept], place[kept].astype(np.int32)]))
            out += repeated(d[gone], place[gone], place[gone], n_buckets)
        return table(out)

    return run


def fourth_step(length: int, n_docs: int):
    """The suffixes of the dictionary phrases of one bucket of triggers, sorted; or windows of hot triggers, by hash."""

    def run(t: pa.Table) -> pa.Table:
        kinds = np.array(t.column("kind").to_pylist(), dtype=object)
        blobs = t.column("blob").to_pylist()
        out: list[tuple[str, int, bytes]] = []
        if len(hot := [b for b, k in zip(blobs, kinds, strict=True) if k == "window"]):
            trigger, window, doc, place = unpack(hot, WINDOW)
            order, later = not_first([trigger, window], doc, place)
            gone = order[later]
            out += repeated(doc[gone], place[gone], place[gone], n_docs)
        cold = [b for b, k in zip(blobs, kinds, strict=True) if k == "bytes"]
        if cold:
            n = [int.from_bytes(b[:8], "little") for b in cold]
            trigger, doc, lo, more = unpack([b[8 : 8 + k] for b, k in zip(cold, n, strict=True)], UNSURE[:4])
            raw = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(b[8 + k :]) for b, k in zip(cold, n, strict=True)), np.uint8)
            size = more.astype(np.int64) + length
            begin = np.cumsum(size) - size
            by_trigger = np.argsort(trigger, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(trigger[by_trigger], prepend=trigger[by_trigger[0]] + np.uint64(1))), len(by_trigger))
            a = 0
            while a < len(cuts) - 1:  # whole triggers, about 200,000 suffixes at a time
                b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + 4000, side="right")) - 1)
                some = by_trigger[cuts[a] : cuts[b]]
                a = b
                count = more[some].astype(np.int64) + 1
                start = spread(begin[some], count)
                d, place = np.repeat(doc[some], count), spread(lo[some].astype(np.int64), count)
                suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, length)[start])
                order = np.lexsort((place, d))
                order = order[np.argsort(suffixes[order].view(f"S{length}").ravel(), kind="stable")]
                same = np.append(False, (suffixes[order[1:]] == suffixes[order[:-1]]).all(axis=1))
                gone = order[elsewhere(same, d[order], place[order])]
                out += repeated(d[gone], place[gone], place[gone], n_docs)
        return table(out)

    return run


def last_step(length: int):
    def run(texts: pa.Table, t: pa.Table) -> pa.Table:
        doc, lo, hi = merged(*unpack(t.column("blob").to_pylist(), REPEAT))
        ids = texts.column("doc_id").to_numpy()
        first, end = np.searchsorted(doc, ids, side="left"), np.searchsorted(doc, ids, side="right")
        size, removed, spans, kept = [], [], [], []
        for body, a, b in zip(texts.column("body").to_pylist(), first.tolist(), end.tolist(), strict=True):
            rest, at, n = [], 0, 0
            for s, e in zip(lo[a:b].tolist(), (hi[a:b] + length).tolist(), strict=True):
                if s > at or n == 0:
                    rest.append(body[at:s])
                    n += 1
                at = max(at, e)
            rest.append(body[at:])
            kept.append(b"".join(rest))
            size.append(len(body)), removed.append(len(body) - len(kept[-1])), spans.append(n)
        return pa.table({"doc_id": texts.column("own"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return run


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, bucket_bytes: int = 8 << 20, most_phrases: int = MOST_PHRASES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes). length: at least 64 and at most 280 bytes.

    bucket_bytes: about how much text a bucket of documents holds, and the phrases of how much text a bucket of triggers.
    """
    whole = docs.select(F.col(key).cast("long").alias("own"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    whole, total = numbered(whole)
    n = max(8, math.ceil(total / bucket_bytes))
    texts = whole.select("doc_id", "body")
    parsed = spread_hot(settle(texts.mapInArrow(first_step(length, n, n), SCHEMA), "parsed"), n, most_phrases)
    looked_up = settle(parsed.filter("kind = 'phrase'").groupBy("bucket").applyInArrow(second_step(n, n), SCHEMA), "dictionary")
    bucket = F.crc32(F.col("doc_id").cast("string").cast("binary")) % n
    fetched = settle(texts.withColumn("bucket", bucket).groupBy("bucket").cogroup(looked_up.filter("kind = 'unsure'").groupBy("bucket")).applyInArrow(third_step(length, n), SCHEMA), "fetched")
    ordered = fetched.filter("kind <> 'repeat'").groupBy("bucket").applyInArrow(fourth_step(length, n), SCHEMA)
    repeats = settle(parsed.unionByName(looked_up).unionByName(fetched).unionByName(ordered).filter("kind = 'repeat'"), "repeats")
    return whole.withColumn("bucket", bucket).groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(last_step(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def numbered(whole: DataFrame) -> tuple[DataFrame, int]:
    """Rows with ``doc_id``, a number for each document in the order of keys, and the bytes of all texts.

    Where no key is null or stands for unlike texts, the key is the number, and no text moves. Else documents are the distinct pairs of key and hash of the text, in this order, null keys last; pairs are numbered by ranges and
    meet the texts again.
    """
    h = F.xxhash64("body", F.octet_length("body"))
    by_key = whole.groupBy("own").agg(F.min(h).alias("a"), F.max(h).alias("b"), F.sum(F.octet_length("body")).alias("n"))
    odd = F.col("own").isNull() | (F.col("a") != F.col("b"))
    total, any_odd = by_key.agg(F.sum("n"), F.max(odd)).first()
    if not any_odd:
        return whole.withColumn("doc_id", F.col("own")), total or 0
    pairs = whole.select(F.col("own").alias("k"), h.alias("h")).distinct().repartitionByRange(F.asc_nulls_last("k"), "h").sortWithinPartitions(F.asc_nulls_last("k"), "h")
    pairs = settle(pairs.withColumn("doc_id", F.monotonically_increasing_id()), "numbers")
    return whole.join(pairs.hint("merge"), F.col("own").eqNullSafe(F.col("k")) & (h == F.col("h"))).select("own", "doc_id", "body"), total or 0
