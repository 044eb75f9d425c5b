"""Conversations: transcripts and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transcripts(messages: DataFrame) -> DataFrame:
    """conv_id, transcript, n: the messages of each conversation in order, a line each. messages: conv_id, at, role, text."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    packed = F.array_sort(F.collect_list(F.struct("at", line.alias("line"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("transcript"), F.count("*").alias("n"))


def activity(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """conv_id, last_activity, bookmarks, questions, newest activity first, ties by conv_id.

    messages: conv_id, at, role; marks: conv_id, at, bookmarks (a JSON list that replaces the ones before). Broken JSON is an empty list, so is
    none. Of changes at one time the greatest text counts. One shuffle, combined before it.
    """
    said = messages.select("conv_id", "at", F.lit(None).cast("string").alias("bookmarks"), (F.col("role") == "user").alias("asked"), F.lit(False).alias("mark"))
    events = said.unionByName(marks.select("conv_id", "at", "bookmarks", F.lit(False).alias("asked"), F.lit(True).alias("mark")))
    last_mark = F.max(F.when(F.col("mark"), F.struct("at", "bookmarks")))
    found = events.groupBy("conv_id").agg(F.max("at").alias("last_activity"), last_mark.alias("m"), F.count_if("asked").alias("questions"))
    listed = F.coalesce(F.from_json("m.bookmarks", "array<string>"), F.array().cast("array<string>"))
    return found.select("conv_id", "last_activity", listed.alias("bookmarks"), "questions").orderBy(F.desc("last_activity"), "conv_id")
