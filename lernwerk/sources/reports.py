"""Sinks that end a job: manifests, quality reports, snapshots of notes, the log of runs. All paths are folders that Spark writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions import text as T
from .corpora import write_notes
from .shared import written


def write_manifest(entries: DataFrame, path: str) -> None:
    """One JSON object with the list ``banks``, by id; as many entries as there are banks."""
    banks = F.array_sort(F.collect_list(F.struct(*entries.columns)))
    entries.agg(F.to_json(F.struct(banks.alias("banks"))).alias("value")).write.mode("overwrite").text(path)


def report_lines(issues: DataFrame, most: int = 200) -> DataFrame:
    """part, at, line of the Markdown report: counts by severity and by type, then the first ``most`` grave issues and how many more there are."""
    grave = issues.filter(F.col("severity").isin("high", "critical"))
    title = lambda part, text: issues.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit("").alias("at"), F.lit(text).alias("line"))
    count = lambda part, c: issues.groupBy(c).count().select(F.lit(part), c, F.concat(F.lit("- "), c, F.lit(": "), "count"))
    shown = grave.orderBy("id", "issue_type").limit(most)
    each = shown.select(F.lit(5), F.concat_ws(":", F.lpad(F.col("id").cast("string"), 20, "0"), "issue_type"), F.concat(F.lit("- Q"), "id", F.lit(": "), "issue_type", F.lit(" | "), F.coalesce("subject", F.lit("")), F.lit(" | "), F.coalesce("preview", F.lit(""))))
    rest = grave.agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.lit(6), F.lit(""), F.concat(F.lit("- ... "), F.col("n") - most, F.lit(" more")))
    parts = [title(0, "## Issues by severity"), count(1, "severity"), title(2, "## Issues by type"), count(3, "issue_type"), title(4, "## Grave issues"), each, rest]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def write_qc_report(issues: DataFrame, summary: Callable[[DataFrame], DataFrame], path: str, most: int = 200) -> None:
    """Issues as CSV and JSON, the summary as JSON, and a Markdown report of one file: its rows are bounded by ``most`` and the types.

    Issues are found once and stored; ``summary`` gives the summary from the stored ones.
    """
    issues = written(issues)
    issues.write.mode("overwrite").option("header", True).csv(f"{path}/issues_csv")
    issues.write.mode("overwrite").json(f"{path}/issues_json")
    summary(issues).write.mode("overwrite").json(f"{path}/summary")
    report_lines(issues, most).repartition(1).sortWithinPartitions("part", "at").select("line").write.mode("overwrite").text(f"{path}/report")


def write_snapshot(weak: DataFrame, misconceptions: DataFrame, wrong: DataFrame, path: str, limit: int = 200) -> DataFrame:
    """Weak points (the ``limit`` weakest), misconceptions and the error book as JSON, a note for each weak point, and a manifest of counts.

    weak: as ``functions.replies.note`` takes it. Rows are counted while they are written. Result: the manifest, one row.
    """
    spark = weak.sparkSession
    tables = {"weak_points": weak.orderBy("mastery_score", "tag").limit(limit), "misconceptions": misconceptions, "wrong_questions": wrong}
    counts = {}
    for name, rows in tables.items():
        seen = Observation(name)
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{path}/json/{name}")
        counts[f"{name}_count"] = seen.get["n"]
    notes = spark.read.schema(tables["weak_points"].schema).json(f"{path}/json/weak_points")  # as written: at most ``limit`` rows
    named = lambda c: T.safe_name(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("uncategorized"))).alias(c)
    write_notes(notes.select(named("subject"), named("chapter"), R.note().alias("content")), f"{path}/markdown")
    manifest = spark.range(1).select(*(F.lit(n).cast("long").alias(name) for name, n in counts.items()))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)
