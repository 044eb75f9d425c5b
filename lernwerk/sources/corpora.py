"""Reading and writing corpora, question packages, manifests, reports and notes."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.banks import package_metadata
from ..operators.links import hash_key

QUESTION_SCHEMA = "id long, subject string, chapter string, knowledge_tag string, question_type string, question_text string, option_a string, option_b string, option_c string, option_d string, answer string, analysis string, source_pdf string, page_number int, text_hash string"


def scan_markdown(spark: SparkSession, folder: str, names: str = "*.md") -> DataFrame:
    """file, text of every Markdown file below a folder."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(folder, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each bank of a manifest."""
    schema = "banks array<struct<id:string,name:string,subject:string,count:long,question_count:long,version:string,path:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("banks").alias("b")).select("b.*")


PACKAGE_TABLES = ("question_assets", "answer_candidates")
POINTER = "version string, published_at timestamp, metadata string"


def package_facts(questions: DataFrame, assets: DataFrame, candidates: DataFrame, **facts: str) -> DataFrame:
    """One row, ``metadata``: the JSON that describes a package. facts: id, name, subject, description, version, qc_status."""
    n = package_metadata(questions, assets, candidates)
    named = {"id": "", "name": "", "subject": "", "version": "1.0.0", "description": "", "qc_status": "passed_with_warnings"} | facts
    fields = [*(F.lit(named[k]).alias(k) for k in ("id", "name", "subject")), F.col("questions").alias("count"), F.col("questions").alias("question_count"), *(F.lit(named[k]).alias(k) for k in ("version", "description")), "has_media", "has_partial_answers", F.col("assets").alias("asset_count"), F.col("candidates").alias("answer_candidate_count"), F.lit(named["qc_status"]).alias("qc_status"), F.current_timestamp().cast("string").alias("exported_at")]
    return n.select(F.to_json(F.struct(*fields)).alias("metadata"))


def write_package(questions: DataFrame, assets: DataFrame, candidates: DataFrame, path: str, **facts: str) -> None:
    """Three Parquet tables and their metadata; assets and candidates are keyed by text hash, those of questions without one stay out.

    A package is written as a new version beside those that are there, and becomes the current one by a last row of pointers, which appears as a whole or not at all. So readers never see half of one, whenever a run ends.
    """
    spark, version = questions.sparkSession, uuid.uuid4().hex
    at = f"{path}/versions/{version}"
    keys = questions.filter("text_hash IS NOT NULL").select(F.col("id").alias("question_id"), F.col("text_hash").alias("question_text_hash"))
    questions.write.partitionBy("subject").parquet(f"{at}/questions")
    for name, rows in zip(PACKAGE_TABLES, (assets, candidates), strict=True):
        rows.join(keys.hint("merge"), "question_id").drop("question_id").write.parquet(f"{at}/{name}")
    tables = [spark.read.schema(questions.schema).parquet(f"{at}/questions"), *(spark.read.parquet(f"{at}/{name}") for name in PACKAGE_TABLES)]
    pointer = package_facts(*tables, **facts).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"), "metadata")
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/published")


def published(spark: SparkSession, path: str) -> DataFrame:
    """version, published_at, metadata of the current package, one row; of equal times the greater version."""
    return spark.read.schema(POINTER).parquet(f"{path}/published").orderBy(F.desc("published_at"), F.desc("version")).limit(1)


def package_path(spark: SparkSession, path: str) -> str:
    return f"{path}/versions/{published(spark, path).first()['version']}"


def read_package(spark: SparkSession, path: str) -> DataFrame:
    """The questions of the current package, missing columns null."""
    return spark.createDataFrame([], QUESTION_SCHEMA).unionByName(spark.read.parquet(f"{package_path(spark, path)}/questions"), allowMissingColumns=True)


def read_attached(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Assets or candidates of the current package, named by ``question_text_hash``, whatever the hash is called there; a package without the table has none."""
    rows = read_optional(spark, f"{package_path(spark, path)}/{name}")
    return rows.withColumn("question_text_hash", hash_key(rows)).filter("question_text_hash IS NOT NULL")


def read_optional(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table, or no rows where there is none."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema or "question_text_hash string")


def upsert(manifest: DataFrame, entry: DataFrame, key: str = "id") -> DataFrame:
    """Entries of equal id are replaced, others appended."""
    return manifest.join(entry.select(key).hint("merge"), key, "left_anti").unionByName(entry, allowMissingColumns=True)


def write_notes(notes: DataFrame, path: str) -> None:
    """One Markdown note for each row (subject, chapter, content), in folders by subject and chapter."""
    notes.select("subject", "chapter", F.col("content").alias("value")).write.mode("overwrite").partitionBy("subject", "chapter").text(path)
