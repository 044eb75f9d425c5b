"""Page texts of documents into question rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import replies as R
from ..functions import text as T
from ..operators.ordered import carried, last_before, sum_before

# What begins a question, a chapter, a section and an option, and an exam year.
START = r"^\s*(\d{1,4})\s*[.、．]\s*(?:$|[^\s\d])"
CHAPTER = r"^\s*第\s*(\d+)\s*章\s*(.*)$"
SECTION = r"^\s*(\d{1,2}\.\d{1,2})\s+(\S.*)$"
OPTION = r"\n\s*([A-Ea-e])\s*[.、．)]\s*"
YEAR = r"【\s*\d{4}\s*(?:统考)?真题\s*】"


def scan_pages(pages: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """doc, page_no, start, n_chars, text: cleaned page texts, and where each begins in its document, pages joined by newlines.

    pages: doc, page_no (whole numbers), text. Null texts count as empty.
    """
    clean = pages.select("doc", "page_no", F.coalesce(C.page_noise("text", patterns), F.lit("")).alias("text"))
    sized = clean.withColumn("n_chars", F.length("text").cast("long")).withColumn("_n", F.col("n_chars") + 1)
    return sum_before(sized, "doc", "page_no", "_n", "start").select("doc", "page_no", "start", "n_chars", "text")


def answers_of_pages(replies: DataFrame) -> DataFrame:
    """doc, page_no, number, answer, section, knowledge_tag of the questions that the replies to pages give an answer to.

    replies: doc, page_no (whole numbers), reply. Chapter and section that a page does not name are those of the pages before; the chapter
    stands in for a section that none names. Broken replies give no answers and name nothing.
    """
    read = replies.select("doc", "page_no", R.page_answers("reply").alias("_answers"), R.page_context("reply").alias("_c")).select("doc", "page_no", "_answers", "_c.*")
    for part in ("chapter", "section"):
        read = last_before(read, "doc", "page_no", part, "_earlier").withColumn(part, F.coalesce(part, "_earlier")).drop("_earlier")
    each = read.select("doc", "page_no", F.coalesce("section", "chapter").alias("section"), F.explode("_answers").alias("a"))
    return each.select("doc", "page_no", "a.number", "a.answer", "section", F.concat_ws(",", "section", "a.exam_year").alias("knowledge_tag"))


def correction_blocks(questions: DataFrame, width: int = 1000) -> DataFrame:
    """doc, page_no, first_id, n, prompt: the questions of a page in one prompt, by id; of a page with more, those of each ``width`` ids.

    questions: doc, page_no, id, question_text, option_a..d. A prompt holds ``width`` questions at most if ids do not repeat.
    """
    packed = F.array_sort(F.collect_list(F.struct("id", R.correction_part().alias("part"))))
    blocks = questions.groupBy("doc", "page_no", F.floor(F.col("id") / width).alias("_range")).agg(F.min("id").alias("first_id"), F.count("*").alias("n"), packed.alias("_p"))
    return blocks.select("doc", "page_no", "first_id", "n", F.array_join(F.transform("_p", lambda x: x["part"]), "\n\n").alias("prompt"))


def parse_pages(pages: DataFrame, patterns: list[str] | None = None, width: int = 64) -> DataFrame:
    """doc, number, page_no, chapter, section, answer_ref, exam_year, question_text, option_a..e, text_hash.

    pages: doc, page_no, text. A question reaches from its number to the next, over pages, and lies on the page of its number. Chapter,
    section and answer reference (as it is written) are the last ones above it; their lines belong to no question. Two options at least are
    options, of a letter that repeats the last; fewer stay in the text. Null texts count as empty, questions without text go. Pages are worked out by ranges of ``width``; what stands above a range is carried on.
    """
    lines = pages.select("doc", "page_no", F.posexplode(F.split(C.page_noise("text", patterns), "\n", -1)).alias("line_no", "line"))
    line = F.col("line")
    is_chapter, is_section, ref = F.regexp_like(line, F.lit(CHAPTER)), F.regexp_like(line, F.lit(SECTION)), F.nullif(F.regexp_extract(line, T.ANSWER_REF, 0), F.lit(""))
    is_start = F.regexp_like(line, F.lit(START))
    chapter = F.when(is_chapter, F.concat(F.lit("第"), F.regexp_extract(line, CHAPTER, 1), F.lit("章 "), F.trim(F.regexp_extract(line, CHAPTER, 2))))
    section = F.when(is_section, F.concat(F.regexp_extract(line, SECTION, 1), F.lit(" "), F.trim(F.regexp_extract(line, SECTION, 2))))
    heads = {"chapter": chapter, "section": section, "answer_ref": F.when(~is_start, ref)}
    told = carried(lines, "doc", ["page_no", "line_no"], heads, {"block": is_start.cast("long")}, width)
    body = told.filter((F.col("block") > 0) & ~is_chapter & ~is_section & (is_start | ref.isNull()))
    at = F.struct("page_no", "line_no", "line", *heads)
    blocks = body.groupBy("doc", "block").agg(F.array_sort(F.collect_list(at)).alias("l"))
    first = F.col("l")[0]
    whole = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    text = F.regexp_replace(T.strip(F.regexp_replace(whole, YEAR, "")), r"^\s*\d{1,4}\s*[.、．]\s*", "")
    out = blocks.select("doc", F.regexp_extract(first["line"], START, 1).cast("int").alias("number"), first["page_no"].alias("page_no"), *(first[k].alias(k) for k in heads), T.exam_year(whole).alias("exam_year"), text.alias("_t"))
    out = out.withColumn("_k", F.transform(F.regexp_extract_all("_t", F.lit(OPTION), F.lit(1)), F.upper)).withColumn("_v", F.split("_t", OPTION, -1))
    some = F.size("_k") >= 2
    each = F.arrays_zip("_k", F.slice(F.col("_v"), F.lit(2), F.size("_v")).alias("_o"))
    out = out.withColumn("_z", F.when(some, F.transform(each, lambda x: F.struct(x["_k"].alias("k"), x["_o"].alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>")))
    out = out.withColumn("question_text", F.when(some, T.strip(F.col("_v")[0])).otherwise(C.page_noise("_t", patterns)))
    options = [C.page_noise(F.get(F.reverse(F.filter("_z", letter(k))), F.lit(0))["v"], patterns).alias(f"option_{k.lower()}") for k in "ABCDE"]
    return out.filter("question_text <> ''").select("doc", "number", "page_no", *heads, "exam_year", "question_text", *options, T.text_hash("question_text").alias("text_hash"))


def letter(k: str):
    return lambda x: x["k"] == k
