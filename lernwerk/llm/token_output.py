"""Token ids of documents as packed matrices.

Documents become pieces of at most ``capacity`` ids without losing one; best-fit-decreasing places them; each sequence is one
row of a matrix: its ids padded to the capacity, the cumulative lengths of its segments, and position numbers that begin anew in every
segment. Matrices of ``ROWS`` sequences are put together in a task each; ids are stored as 16-bit numbers where the vocabulary allows.

Defined cases: a null or empty text is one piece, the end id; null and repeated keys stay, as each row has a number of its own,
written with its pieces before they are planned; a text longer than a sequence is cut into pieces, and none is shortened; an empty table gives no sequence.
Columns besides key and text are not used. Ids or positions that ``id_bytes`` cannot hold are an error, as is a capacity of more than positions can count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .packing import best_fit_decreasing, place
from .tokens import pieces, vocabulary_size

ROWS = 128


def check_fit(path: str, capacity: int, end_id: int, id_bytes: int, pad_id: int) -> None:
    """Every id of the vocabulary and every position must be a number of ``id_bytes`` bytes; nothing ever wraps."""
    if id_bytes not in (2, 4):
        raise ValueError("id_bytes must be 2 or 4")
    most = max(vocabulary_size(path) - 1, end_id, pad_id, capacity - 1)
    if most >= 1 << 8 * id_bytes or min(end_id, pad_id) < 0 or capacity < 1:
        raise ValueError(f"{most} does not fit into {id_bytes} bytes, or a number is negative")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, id_bytes: int = 2, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, doc_ids, pieces, cu_seqlens, ids (capacity ids of ``id_bytes`` bytes), positions (capacity 16- or 32-bit numbers) for each sequence."""
    check_fit(path, capacity, end_id, id_bytes, pad_id)
    own = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id")).alias("_id"), F.col(text).alias("text"))
    cut = settle(pieces(own, path, key="_id", capacity=capacity, end_id=end_id, id_bytes=id_bytes).select("_id.row", "_id.doc_id", "piece", "length", "ids"), "ids")
    # rows of one key are placed in any order; what is written holds
    where = settle(place(cut.select("row", "doc_id", "piece", "length"), ["doc_id", "piece"], best_fit_decreasing, capacity).drop("doc_id"), "places")
    # the places are the side that is hashed: rows of ids are not sorted for the join
    both = cut.drop("length").join(where.hint("shuffle_hash"), ["row", "piece"]).drop("row").withColumn("part", F.floor(F.col("sequence_id") / ROWS))
    kind = f"<u{id_bytes}"

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        sequence = t.column("sequence_id").to_numpy()
        length = t.column("length").to_numpy()
        ids, doc, piece = t.column("ids").to_pylist(), t.column("doc_id").to_pylist(), t.column("piece").to_pylist()
        cuts = np.flatnonzero(np.diff(sequence, prepend=-1)).tolist()
        out: list[tuple] = []
        for a, b in zip(cuts, [*cuts[1:], len(sequence)], strict=True):
            row = np.full(capacity, pad_id, kind)
            flat = np.frombuffer(b"".join(ids[a:b]), kind)
            row[: len(flat)] = flat
            positions = np.zeros(capacity, kind)
            positions[: len(flat)] = np.concatenate([np.arange(n) for n in length[a:b]])
            out.append((int(sequence[a]), len(flat), doc[a:b], piece[a:b], [0, *np.cumsum(length[a:b]).tolist()], row.tobytes(), positions.tobytes()))
        names = ["sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "ids", "positions"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.table({n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return both.groupBy("part").applyInArrow(run, "sequence_id long, n_tokens long, doc_ids array<long>, pieces array<int>, cu_seqlens array<long>, ids binary, positions binary")


def write(docs: DataFrame, path: str, out: str, **options) -> None:
    """Write the packed matrices as Parquet, a row for each sequence."""
    pack(docs, path, **options).write.mode("overwrite").parquet(out)


def digest(packed: DataFrame) -> DataFrame:
    """The sequences with checksums for their matrices."""
    return packed.select("sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
