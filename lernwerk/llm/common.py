"""Helpers that several operators share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

_OWN_DIR: list[tempfile.TemporaryDirectory] = []
#: Text that one Arrow batch takes to Python: the JVM and the worker hold some batches each.
BATCH_BYTES = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset and all run in one process, a folder of our own, which goes with it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.TemporaryDirectory(prefix="spark-lernwerk-"))
    return _OWN_DIR[0].name


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, has a true size."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def lean(spark: SparkSession) -> None:
    """From now on texts go to Python in Arrow batches of ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """``df``, known to have ``rows`` rows, as a side of a join: broadcast up to ``most`` of them, a merge join beyond."""
    return F.broadcast(df) if rows <= most else df.hint("merge")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``_name`` that ``df`` does not have, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame) -> list[Column]:
    """Where a row is stored, in the order of a written table: ``part`` and ``file`` of its Parquet file, ``row`` in it from 0.

    Of what is no plain read of Parquet, the partition and the row in it.
    """
    try:
        at = df.metadataColumn("_metadata")
        path = at["file_path"]
        own = [F.coalesce(F.regexp_extract(path, r"part-([0-9]{1,9})[^/]*$", 1).try_cast("long"), F.lit(-1)).alias("part"), path.alias("file"), at["row_index"].alias("row")]
        _ = df.select(*own).schema
    except AnalysisException:
        row = F.monotonically_increasing_id()
        own = [F.shiftright(row, 33).alias("part"), F.lit("").alias("file"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")]
    return own


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % mod


def pieces_of(n_bytes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(n_bytes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(n_bytes):
        yield start, len(n_bytes)


def cut(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of Arrow batches with about ``most`` bytes of text, as they came, and their texts, null ones as empty."""
    for batch in batches:
        filled = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
        for a, b in pieces_of(pc.binary_length(filled).to_numpy(zero_copy_only=False), most):
            yield batch.slice(a, b - a), filled.slice(a, b - a)


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The slices of ``cut`` with null texts as empty ones."""
    for rows, texts in cut(batches, text, most):
        yield rows.set_column(rows.schema.get_field_index(text), text, texts)


def with_text(df: DataFrame, names: list[str], text: str) -> tuple[DataFrame, str]:
    """The columns ``names`` and the text, which travels once; what the text is called there."""
    if text in names:
        return df.select(*names), text
    body = fresh(df, "text")
    return df.select(*names, F.col(text).alias(body)), body


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: a code per word, each text's offsets into the codes, the distinct words. No word is empty."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts) if lower else texts)
    words = lists.flatten()
    ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(full)])
    offsets = np.concatenate([[0], kept[ends]])
    coded = words.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets.astype(np.int64), coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits for each word, equal on every machine."""
    return np.fromiter(map(xxh3_64_intdigest, words.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(words))


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int, bucket_rows: int = 1 << 18, least: int = 64) -> DataFrame:
    """Number the rows of each key from 0, without ever sorting a whole key in one task.

    Rows of a key are dealt to buckets by a hash of ``order``; each bucket is numbered for itself
    and shifted by the counts of the buckets before it. ``rows``: how many ``df`` has, so that a bucket has about ``bucket_rows`` even if
    one key has all of them. ``keys`` hold no nulls.
    """
    bucket, inside, shift = (fresh(df, x) for x in ("bucket", "inside", "shift"))
    buckets = max(least, math.ceil(rows / bucket_rows))
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy(*keys, bucket).agg(F.count("*").alias(inside)).withColumn(shift, F.coalesce(F.sum(inside).over(before), F.lit(0))).drop(inside)
    numbered = dealt.withColumn(inside, F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1)
    return numbered.join(shifts.hint("merge"), [*keys, bucket]).withColumn(name, F.col(inside) + F.col(shift)).drop(bucket, inside, shift)
