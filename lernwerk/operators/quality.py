"""Quality rules over question texts: one scan, one row for each rule that a question breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def rules(long_text: int = 3000) -> list[tuple[str, Column, Column]]:
    """(issue type, severity, whether it holds) over question_type, option_a..d, answer, question_text and n_assets."""
    body = F.coalesce("question_text", F.lit(""))
    blank = lambda c: F.coalesce(T.strip(c), F.lit("")) == ""
    images = F.size(T.image_refs(body))
    return [
        ("choice_missing_option", F.lit("high"), (F.col("question_type") == "choice") & (blank("option_a") | blank("option_b") | blank("option_c") | blank("option_d"))),
        ("empty_answer", F.lit("info"), blank("answer")),
        ("markdown_image_reference", F.when(F.col("n_assets") == 0, "medium").otherwise("info"), images > 0),
        ("raw_html_table", F.lit("medium"), F.contains(F.lower(body), F.lit("<table")) | F.contains(F.lower(body), F.lit("</table>"))),
        ("latex_array", F.lit("medium"), F.contains(body, F.lit("\\begin{array}")) | F.contains(body, F.lit("\\end{array}"))),
        ("mineru_details_or_mermaid", F.lit("medium"), F.contains(F.lower(body), F.lit("<details")) | F.contains(F.lower(body), F.lit("```mermaid"))),
        ("unbalanced_code_fence", F.lit("high"), F.regexp_count(body, F.lit("```")) % 2 == 1),
        ("very_long_question_text", F.lit("medium"), F.length(body) > long_text),
    ]


def broken() -> Column:
    """The broken rules of a question, as structs of issue_type and severity."""
    found = F.array(*(F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("issue_type"), severity.alias("severity"))) for name, severity, holds in rules()))
    return F.filter(found, lambda x: x.isNotNull())


def issues(questions: DataFrame) -> DataFrame:
    """id, subject, issue_type, severity, preview for each broken rule."""
    each = questions.select("id", "subject", T.preview("question_text").alias("preview"), F.explode(broken()).alias("i"))
    return each.select("id", "subject", "i.issue_type", "i.severity", "preview")


def asset_issues(assets: DataFrame, listing: DataFrame) -> DataFrame:
    """Assets whose file is not listed, as issues of their question. assets: question_id, path; listing: path."""
    return missing_assets(assets, listing).select(F.col("question_id").alias("id"), F.lit(None).cast("string").alias("subject"), F.lit("missing_asset_file").alias("issue_type"), F.lit("critical").alias("severity"), F.lit("").alias("preview"))


def fact(name: str, a: Column | None = None, b: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(name).alias("name"), (none if a is None else a.cast("string")).alias("a"), (none if b is None else b.cast("string")).alias("b"))


def summary(questions: DataFrame, assets: DataFrame, listing: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """name, a, b, n: issues by type and by severity, questions by subject and type and by source, and how many questions and assets there are.

    questions: as for ``issues``, and source; listing: the files that assets should be among. Texts are read once: each question gives its facts, and facts are counted.
    found: all issues, of assets too, where they are stored already; texts are not read then.
    """
    own = F.array(fact("questions"), fact("subject_type", F.col("subject"), F.col("question_type")), fact("source", F.col("source")))
    of_issue = F.array(fact("issue_type", F.col("issue_type")), fact("severity", F.col("severity")))
    of_rules = F.flatten(F.transform(broken(), lambda i: F.array(fact("issue_type", i["issue_type"]), fact("severity", i["severity"]))))
    parts = [questions.select(F.explode(F.concat(own, of_rules) if found is None else own).alias("f")), assets.select(fact("assets").alias("f"))]
    if found is not None:
        parts.append(found.select(F.explode(of_issue).alias("f")))
    elif listing is not None:
        parts.append(asset_issues(assets, listing).select(F.explode(of_issue).alias("f")))
    facts = parts[0]
    for part in parts[1:]:
        facts = facts.unionByName(part)
    return facts.groupBy("f.name", "f.a", "f.b").agg(F.count("*").alias("n"))


def top_issues(found: DataFrame, limit: int = 200) -> DataFrame:
    return found.filter(F.col("severity").isin("high", "critical")).orderBy("id", "issue_type").limit(limit)


def missing_assets(assets: DataFrame, listing: DataFrame) -> DataFrame:
    return assets.join(listing.select("path").hint("merge"), "path", "left_anti")


def pua_histogram(rows: DataFrame, *fields: str) -> DataFrame:
    """Private-use characters of the fields with their code points, how often they stand there and what replaces them, the most frequent first.

    ``replacement``: the opening and closing character of one that comes in pairs, the character and its code point of another, empty for one that goes, ``?`` for one that is not known.
    """
    each = rows.select(F.explode(F.flatten(F.array(*(F.coalesce(F.regexp_extract_all(f, F.lit(f"({T.PUA})"), F.lit(1)), F.array().cast("array<string>")) for f in fields or ("question_text",))))).alias("ch"))
    counts = each.groupBy("ch").agg(F.count("*").alias("n")).withColumn("code", F.hex(F.encode("ch", "UTF-16BE")))
    known = {code: f"{opening}...{closing} (paired)" for code, opening, closing in T.PAIRED}
    known |= {code: f"{to} (U+{ord(to):04X})" if to else "" for code, to in T.SINGLE.items()}
    mapping = F.create_map(*(F.lit(x) for item in known.items() for x in item))
    return counts.withColumn("replacement", F.coalesce(mapping[F.col("ch")], F.lit("?"))).orderBy(F.desc("n"), "ch")


def change_report(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """For each field, and under ``(rows)`` for rows of which any field changes: how many the cleaning of a table, done to ``after``, changes or not, and the private-use characters before and after.

    Under ``(n fields)``: how many rows have so many changed fields. Both tables have id, once each.
    """
    cleaned = after.select("id", *(F.col(f).alias(f"_{f}") for f in fields))
    return change_counts(before.select("id", *fields).join(cleaned.hint("merge"), "id"), fields)


def change_counts(met: DataFrame, fields: list[str]) -> DataFrame:
    """``change_report`` of rows that hold the fields before cleaning and, with ``_`` before their names, after it: nothing has to be joined."""
    differs = {f: ~F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields}
    count = lambda c: F.coalesce(T.pua_count(c), F.lit(0)).cast("long")
    row = lambda name, changed, a=F.lit(0).cast("long"), b=F.lit(0).cast("long"): F.struct(name.alias("field"), changed.alias("changed"), a.alias("a"), b.alias("b"))
    n = sum((d.cast("int") for d in differs.values()), F.lit(0))
    each = [row(F.lit(f), differs[f], count(f), count(f"_{f}")) for f in fields]
    long = met.select(F.explode(F.array(*each, row(F.lit("(rows)"), n > 0), row(F.concat(F.lit("("), n.cast("string"), F.lit(" fields)")), n > 0))).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("unchanged"), F.sum("a").alias("pua_before"), F.sum("b").alias("pua_after"))
