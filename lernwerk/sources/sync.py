"""A stored table whose rows are pushed elsewhere and marked then, so that each is pushed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

PARTS = 64


def write_store(rows: DataFrame, path: str, key: str, parts: int = PARTS) -> None:
    """Rows with ``synced`` false, in folders by a hash of the key."""
    dealt = rows.withColumn("synced", F.lit(False)).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    dealt.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def unsynced(store: DataFrame) -> DataFrame:
    return store.filter(~F.coalesce("synced", F.lit(False)))


def mark_synced(spark: SparkSession, path: str, pushed: DataFrame, key: str, parts: int = PARTS) -> None:
    """Mark the rows of the pushed keys. Only the folders that hold one of them are written again, to a new place first, then over the old ones; a run that ends between leaves the old ones."""
    store = read_store(spark, path)
    keys = pushed.select(F.col(key).alias("_key")).distinct()
    touched = keys.select(F.pmod(F.xxhash64("_key"), F.lit(parts)).cast("int").alias("part")).distinct().hint("merge")
    marked = store.join(touched, "part", "left_semi").join(keys.withColumn("_now", F.lit(True)).hint("merge"), F.col(key) == F.col("_key"), "left")
    changed = written(marked.withColumn("synced", F.coalesce("_now", "synced")).select(store.columns))
    changed.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def counts(store: DataFrame) -> DataFrame:
    """total and synced, one row."""
    return store.agg(F.count("*").alias("total"), F.count_if("synced").alias("synced"))
