"""Corpus texts into question rows: a table of lines, headings carried forward, blocks between question numbers, options."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Headings of chapters and sections, and what begins a question (a number that no digit follows, as 3.14 is none).
CHAPTER = r"^##\s*第\s*(\d{1,2})\s*章\s*(.*)"
SECTION = r"^##\s*(\d{1,2}\.\d{1,2})\s*(.*)"
START = r"^(\d{1,4})\s*[.、．]\s*(?:$|[^\s\d])"


def lines(corpus: DataFrame) -> DataFrame:
    """file, line_no, line from file, text."""
    return corpus.select("file", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def carry_sections(rows: DataFrame) -> DataFrame:
    """Each line with chapter, section and answer reference, the number of its question block (0: before the first of its section), and whether it is a heading.

    A chapter's heading is a section too. References in brackets do not count as a part of a heading; one on a line of its own, or in a heading that opens nothing, holds for the
    whole section, and the last one counts.
    """
    line = T.strip("line")
    bare = T.strip(F.regexp_replace(F.regexp_replace(line, T.ANSWER_REF, ""), r"[（(][^)）]*[)）]", ""))
    header = line.startswith("##")
    is_chapter, is_section = header & F.regexp_like(bare, F.lit(CHAPTER)), header & F.regexp_like(bare, F.lit(SECTION))
    chapter = F.when(is_chapter, T.strip(F.concat(F.lit("第"), F.regexp_extract(bare, CHAPTER, 1), F.lit("章 "), F.regexp_extract(bare, CHAPTER, 2))))
    section = F.coalesce(chapter, F.when(is_section, T.strip(F.concat_ws(" ", F.regexp_extract(bare, SECTION, 1), F.regexp_extract(bare, SECTION, 2)))))
    alone = F.regexp_like(line, F.lit(rf"^\s*{T.ANSWER_REF}\s*$"))
    ref = F.when((header | alone) & section.isNull(), T.answer_ref(line))
    so_far = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumns({"_c": chapter, "_s": section, "_r": ref, "_start": F.regexp_like("line", F.lit(START)).cast("int"), "heading": section.isNotNull() | alone})
    told = told.withColumns({"chapter": F.last("_c", ignorenulls=True).over(so_far), "section": F.last("_s", ignorenulls=True).over(so_far), "_no": F.sum(F.col("_s").isNotNull().cast("int")).over(so_far), "_block": F.sum("_start").over(so_far)})
    within = Window.partitionBy("file", "_no")
    begun = F.sum("_start").over(within.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    ref_of = F.max(F.when(F.col("_r").isNotNull(), F.struct("line_no", "_r"))).over(within)["_r"]
    return told.withColumns({"answer_ref": ref_of, "block": F.when(begun > 0, F.col("_block")).otherwise(0)}).drop("_c", "_s", "_r", "_start", "_no", "_block")


def parse(corpus: DataFrame) -> DataFrame:
    """A row for each question of a corpus that has a text: file, number, chapter, section, answer_ref, exam_year, knowledge_tag, question_text, option_a..d, images, text_hash.

    A question reaches from its number to the next or to the heading of the next section; of its options see ``text.inline_options``. images: the paths it names, comma-joined.
    """
    body = carry_sections(lines(corpus)).filter((F.col("block") > 0) & ~F.col("heading"))
    kept = ["chapter", "section", "answer_ref"]
    grouped = body.groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"), F.min(F.struct("line_no", *kept)).alias("m"))
    whole = T.strip(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), r"^\d{1,4}\s*[.、．]\s*", ""))
    out = grouped.select("file", F.regexp_extract(F.col("l")[0]["line"], START, 1).cast("int").alias("number"), *(F.col(f"m.{c}") for c in kept), whole.alias("_t"))
    out = out.filter("_t <> ''").withColumn("_o", T.inline_options("_t"))
    year = T.exam_year("_o.stem")
    return out.select("file", "number", *kept, year.alias("exam_year"), T.knowledge_tags("section", year).alias("knowledge_tag"), F.col("_o.stem").alias("question_text"), *(F.col(f"_o.{k}").alias(f"option_{k}") for k in "abcd"), F.array_join(T.image_refs("_t"), ",").alias("images"), T.text_hash("_o.stem").alias("text_hash"))


def near_empty_ratio(pages: DataFrame, chars: int = 30, scanned_from: float = 0.5) -> DataFrame:
    """Share of pages under ``chars`` characters for each document, and whether it counts as scanned."""
    return pages.groupBy("doc").agg(F.avg((F.length(T.strip("text")) < chars).cast("double")).alias("ratio")).withColumn("scanned", F.col("ratio") >= scanned_from)
