"""Question rows that arrive on a stream, kept once for each text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import questions as S
from ..sources.projection import TEXT_COLUMNS
from .tables import read_table


def read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question texts of the table of documents as a stream; the table is a file or a folder of files."""
    stream = read_table(spark, sf_dir, "documents")
    return spark.sql(f"SELECT {TEXT_COLUMNS} FROM {{t}}", t=stream)


def ingest(stream: DataFrame, seed: DataFrame, root: str) -> DataFrame:
    """Run a stream over all that is there; of each text_hash the first row of the first batch stays, unless the store ``seed`` has it.

    Both have id and text_hash. A batch looks at the other batches only and writes its own folder anew, so it may run twice. Rows without a hash all stay.
    """
    spark, store = stream.sparkSession, f"{root}/store"
    seed.select("id", "text_hash").write.mode("overwrite").parquet(f"{store}/batch=-1")

    def stored() -> DataFrame:
        return spark.read.schema("id long, text_hash string, batch long").parquet(store)

    def take(batch: DataFrame, batch_id: int) -> None:
        known = stored().filter(F.col("batch") < batch_id)
        S.dedup_against(S.first_by_hash(batch.select("id", "text_hash")), known).select("id", "text_hash").write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stored().filter("batch >= 0").select("id", "text_hash")
