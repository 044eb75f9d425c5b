"""Running streams and keeping what they write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream, whether it is one file or a folder of files. As a pattern the path may name either: a stream's plain path must be a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def run(stream: DataFrame, root: str, mode: str) -> None:
    """Run a stream over all that is there, from where the checkpoint below ``root`` stands. State is kept in RocksDB.

    Each batch writes the rows it gives, and no others, to a folder of its own number, whole or not at all: a batch that runs again after a failure replaces what it wrote.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def changes(spark: SparkSession, root: str, like: DataFrame) -> DataFrame:
    """All rows that were written, with ``batch``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
    return spark.read.schema(f"{fields}, batch long").parquet(f"{root}/changes")


def current(spark: SparkSession, root: str, like: DataFrame, keys: list[str]) -> DataFrame:
    """The table that batches of changed rows amount to: of each key the row of the highest batch. A batch has a key once, so what is merged is one row for each key and batch."""
    whole = F.struct(*like.columns)
    return changes(spark, root, like).groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.max_by(whole, "batch").alias("row")).select("row.*")


def compact(spark: SparkSession, root: str, like: DataFrame, keys: list[str], into: str) -> None:
    """Write the current table to another root as its first batch of changes, so that later readers merge less; the checkpoint stays with the old one until the stream moves."""
    current(spark, root, like, keys).write.mode("overwrite").parquet(f"{into}/changes/batch=-1")


def arriving(events: DataFrame, order: str, parts: int, root: str) -> list[Callable[[], None]]:
    """Steps that lay the rows of a table, in ranges of ``order``, into the folder ``root``, one range a step; rows without it come first."""
    marks = events.agg(F.percentile_approx(F.col(order).cast("timestamp").cast("double"), [i / parts for i in range(1, parts)])).first()[0] if parts > 1 else []
    place = sum((F.coalesce((F.col(order).cast("timestamp").cast("double") > m).cast("int"), F.lit(0)) for m in marks or []), F.lit(0))
    return [lambda i=i: events.filter(place == i).write.mode("overwrite").parquet(f"{root}/{i}") for i in range(parts)]
