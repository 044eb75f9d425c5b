"""Selections and counts over the question table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .attempts import complete_choice


def search(questions: DataFrame, subject: str | None = None, chapter: str | None = None, tag: str | None = None) -> DataFrame:
    """Equality on subject and chapter, case-blind containment on the tag list; None: any."""
    out = questions
    if subject is not None:
        out = out.filter(F.col("subject") == subject)
    if chapter is not None:
        out = out.filter(F.col("chapter") == chapter)
    if tag is not None:
        out = out.filter(F.contains(F.lower("knowledge_tag"), F.lower(F.lit(tag))))
    return out


def page(rows: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    return rows.orderBy("id").offset(skip).limit(limit)


def chapter_counts(questions: DataFrame, subject: str | None = None, question_type: str | None = None) -> DataFrame:
    out = search(questions, subject).filter(complete_choice() & F.col("chapter").isNotNull())
    if question_type is not None:
        out = out.filter(F.col("question_type") == question_type)
    return out.groupBy("chapter").agg(F.count("*").alias("n"))


def by_subject(questions: DataFrame) -> DataFrame:
    """Questions for each subject, and in the row without a subject all of them."""
    return questions.rollup("subject").agg(F.count("*").alias("n"))


def random_questions(questions: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n complete questions in a hash order that the seed fixes."""
    return questions.filter(complete_choice()).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "id")), "id").limit(n)


def first_by_hash(rows: DataFrame, hash_col: str = "text_hash", order: str = "id") -> DataFrame:
    """The first row of each hash; rows without a hash all stay, each being a key of its own."""
    known = F.col(hash_col).isNotNull()
    w = Window.partitionBy(hash_col, F.when(~known, F.col(order))).orderBy(order)
    return rows.withColumn("_r", F.when(known, F.row_number().over(w)).otherwise(1)).filter("_r = 1").drop("_r")


def dedup_against(rows: DataFrame, stored: DataFrame, hash_col: str = "text_hash") -> DataFrame:
    """Rows whose hash is not stored; a null hash never matches."""
    return rows.join(stored.select(hash_col), hash_col, "left_anti")


def import_stats(rows: DataFrame, stored: DataFrame, hash_col: str = "text_hash") -> DataFrame:
    """total, imported and skipped rows of a package."""
    kept = first_by_hash(dedup_against(rows, stored, hash_col), hash_col)
    total = rows.agg(F.count("*").alias("total"))
    return total.join(F.broadcast(kept.agg(F.count("*").alias("imported"))), F.lit(True)).withColumn("skipped", F.col("total") - F.col("imported"))


def ordered_list(rows: DataFrame, key: str, item: str, order: str) -> DataFrame:
    """The items of each key in order, comma-joined, each once."""
    first = rows.groupBy(key, item).agg(F.min(order).alias(order), F.count("*").alias("n"))
    packed = F.array_sort(F.collect_list(F.struct(order, item)))  # distinct items only
    return first.groupBy(key).agg(F.array_join(F.transform(packed, lambda x: x[item]), ",").alias("items"), F.sum("n").alias("n"))


def of_chapter(questions: DataFrame, subject: str, chapter: str, question_type: str | None = None) -> DataFrame:
    """The questions of a chapter in the order of their source, which is that of ids. Of a chapter question type ``choice`` only those with four options."""
    found = questions.filter((F.col("subject") == subject) & (F.col("chapter") == chapter))
    if question_type is not None:
        found = found.filter((F.col("question_type") == question_type) & complete_choice())
    return found.orderBy("id")
