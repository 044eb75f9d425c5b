"""Tables written to the folder that driver and executors share, and read again: short lineage, true sizes, and what is read twice is made once."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, whose owner clears it, or one of our own where all run in one process, which goes with it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spark-lernwerk-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        named = _OWN[0]
    return f"{named.rstrip('/')}/lernwerk-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    path, schema = folder(df.sparkSession), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
