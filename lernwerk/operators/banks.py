"""Question packages and what hangs on them: assets, imports, corrections, run logs, file listings."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from .ordered import last_before, sum_before

#: Pairs of image and question that a task makes, on average, while there are no more tasks than that.
PAIRS_OF_TASK, MOST_TASKS = 2**26, 2**14

def assets_per_question(questions: DataFrame, assets: DataFrame) -> DataFrame:
    """Questions with ``assets``, an array of (id, path, asset_type) by id; null where there are none."""
    packed = assets.groupBy(F.col("question_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "path", "asset_type"))).alias("assets"))
    return questions.join(packed.hint("merge"), "id", "left")


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` and those rows of ``new``, one for each key, whose key is not stored. Keys with nulls are never found."""
    fresh = new.join(stored.select(*keys).hint("merge"), keys, "left_anti").dropDuplicates(keys)
    return stored.unionByName(fresh, allowMissingColumns=True)


def remove_batch(rows: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows without those of the listed ids, and the rows that go."""
    listed = ids.select(key).hint("merge")
    return rows.join(listed, key, "left_anti"), rows.join(listed, key, "left_semi")


def remove_cascade(questions: DataFrame, ids: DataFrame, hanging: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """By name, the rows that stay and those that go: the questions of the listed ids, and with them the rows that hang on them by question_id."""
    listed = ids.select("id").distinct()
    out = {"questions": remove_batch(questions, listed)}
    return out | {name: remove_batch(rows, listed.withColumnRenamed("id", "question_id"), "question_id") for name, rows in hanging.items()}


def with_question(book: DataFrame, questions: DataFrame) -> DataFrame:
    """Error-book rows with their question as a struct ``question``; null where it is gone."""
    nested = questions.select(F.col("id").alias("question_id"), F.struct(*(c for c in questions.columns if c not in ("id", "answer", "analysis"))).alias("question"))
    return book.join(nested.hint("merge"), "question_id", "left")


def legacy_path(c: str, folder: str) -> Column:
    """Paths of an earlier layout: below ``/app/`` or within ``folder``."""
    return F.coalesce(F.col(c).startswith("/app/") | F.contains(c, F.lit(folder)), F.lit(False))


def blank(c: str) -> Column:
    return F.coalesce(T.strip(c), F.lit("")) == ""


def import_report(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """found, success, skipped and error rows of each file, and in the row without a file of all.

    rows: id, file, question_text, text_hash. Blank texts are errors; of the others the first of each hash that is not stored succeeds.
    """
    first = rows.filter(~blank("question_text")).groupBy("text_hash").agg(F.min("id").alias("_first"))
    first = first.join(stored.select("text_hash").hint("merge"), "text_hash", "left_anti").select(F.col("_first").alias("id"), F.lit(True).alias("_new"))
    marked = rows.join(first.hint("merge"), "id", "left").withColumn("_error", blank("question_text"))
    new = F.coalesce("_new", F.lit(False))
    return marked.rollup("file").agg(F.count("*").alias("found"), F.count_if(new).alias("success"), F.count_if(~new & ~F.col("_error")).alias("skipped"), F.count_if("_error").alias("error"))


def import_errors(rows: DataFrame) -> DataFrame:
    """file, id, error: what is said of each row that an import refuses. rows: id, file, number (of the question, may be null), question_text."""
    return rows.filter(blank("question_text")).select("file", "id", F.concat(F.lit("Q#"), F.coalesce(F.col("number").cast("string"), F.lit("None")), F.lit(": empty question text")).alias("error"))


def package_metadata(questions: DataFrame, assets: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: how many questions, assets and candidates, whether there are media, whether some question has an answer."""
    parts = [
        questions.agg(F.count("*").alias("questions"), F.coalesce(F.bool_or(~blank("answer")), F.lit(False)).alias("has_partial_answers")),
        assets.agg(F.count("*").alias("assets")),
        candidates.agg(F.count("*").alias("candidates")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.join(F.broadcast(part), F.lit(True))  # one row each
    return whole.withColumn("has_media", F.col("assets") > 0)


def pua_report(rows: DataFrame, text: str = "question_text") -> DataFrame:
    """Rows and characters in private use for each file, before and after the repair that leaves unmapped ones."""
    counted = rows.select("file", T.pua_count(text).alias("a"), T.pua_count(T.pua_repair(text, drop_unmapped=False)).alias("b"))
    return counted.groupBy("file").agg(F.count_if(F.col("a") > 0).alias("affected"), F.sum("a").cast("long").alias("before"), F.sum("b").cast("long").alias("after"), F.count_if(F.col("b") > 0).alias("still_affected"))


def latest_run(runs: DataFrame, bank: str) -> DataFrame:
    """The newest run of each bank; of equal times the highest id. Combined before the shuffle, so one bank may hold most runs."""
    newest = runs.groupBy(bank).agg(F.max(F.struct("created_at", "id")).alias("_m"))
    return newest.select(bank, "_m.created_at", "_m.id")


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def file_name(c: str) -> Column:
    return F.lower(F.regexp_extract(c, r"([^/\\]*)$", 1))


def resolve_files(rows: DataFrame, listing: DataFrame, source: str) -> DataFrame:
    """``path`` of each stored name: equal lower-case file name, else equal name without its ending; of several the first in order."""
    stem = lambda x: F.regexp_replace(x, r"\.[^.]*$", "")
    by_name = listing.groupBy(file_name("path").alias("_name")).agg(F.min("path").alias("_exact"))
    by_stem = listing.groupBy(stem(file_name("path")).alias("_stem")).agg(F.min("path").alias("_near"))
    named = rows.withColumn("_name", file_name(source)).withColumn("_stem", stem(F.col("_name")))
    met = named.join(by_name.hint("merge"), "_name", "left").join(by_stem.hint("merge"), "_stem", "left")
    return met.withColumn("path", F.coalesce("_exact", "_near")).drop("_name", "_stem", "_exact", "_near")


def ordinal_images(questions: DataFrame, images: DataFrame) -> DataFrame:
    """The k-th image of a page goes to the k-th question of the page, or to its last. questions: doc, page, y, number; images: doc, page, y, image."""
    page = Window.partitionBy("doc", "page")
    q = questions.withColumn("_k", F.row_number().over(page.orderBy("y", "number"))).withColumn("_n", F.count("*").over(page))
    n = q.groupBy("doc", "page").agg(F.max("_n").alias("_n"))
    i = images.withColumn("_k", F.row_number().over(page.orderBy("y", "image"))).join(n.hint("merge"), ["doc", "page"])
    return i.withColumn("_k", F.least("_k", "_n")).drop("_n").join(q.select("doc", "page", "_k", "number").hint("merge"), ["doc", "page", "_k"]).select("doc", "page", "image", "number")


def images_of_pages(questions: DataFrame, images: DataFrame, numbered: DataFrame, most: int = 4096, run: int = 256) -> DataFrame:
    """Documents without a numbered question: every image of a page goes to every question of the page. numbered: doc of those that have one.

    The questions of a large page are dealt into blocks of about ``most``, its images into blocks of about four times as many, and each block of images meets each block of questions by itself: a task holds a block of either, and a page is the work of many tasks.
    A block travels as one row with an array, and pairs are made where they are put out. An image comes with ``run`` questions in turn, then the next image with the same ones: in columns such rows repeat within a page of Parquet, so that a pair takes a small part of a byte there.
    Repeated rows and null images or numbers count as any other; rows without a document or page meet nothing. Tasks are as many as the pairs ask for.
    """
    place = ["doc", "page"]
    bare = questions.join(numbered.select("doc").hint("merge"), "doc", "left_anti")
    q, i = (written(rows.select(*place, key).dropna(subset=place)) for rows, key in ((bare, "number"), (images, "image")))
    sizes = q.select(*place, F.lit(1).alias("q"), F.lit(0).alias("i")).union(i.select(*place, F.lit(0), F.lit(1))).groupBy(*place).agg(F.sum("q").alias("q"), F.sum("i").alias("i"))
    sizes = written(sizes)
    pairs = sizes.agg(F.sum(F.col("q").cast("double") * F.col("i"))).first()[0] or 0
    few = min(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(pairs / 2**20))
    tasks = max(1, few, min(ceil(pairs / PAIRS_OF_TASK), MOST_TASKS))
    blocks = lambda c, n: F.when(F.least("q", "i") > 0, F.ceil(F.col(c) / n)).otherwise(0).cast("int")
    cut = sizes.filter(F.greatest("q", "i") > most).select(*place, blocks("q", most).alias("_nq"), blocks("i", 4 * most).alias("_ni"))  # at most 1/most of the rows

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """The rows in blocks, each block once for each block of the other kind."""
        met = rows.withColumn("_r", F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(cut), place, "left")  # dealt by place in the files, so that repeated rows part
        block = F.coalesce(F.pmod("_r", F.col(f"_n{own}")), F.lit(0)).cast("int")
        met = met.select(*place, key, block.alias(f"_{own}"), F.coalesce(f"_n{other}", F.lit(1)).alias("_n")).filter("_n > 0")
        nulls = F.array_repeat(F.lit(None).cast(rows.schema[key].dataType), F.count_if(F.col(key).isNull()).cast("int"))  # collect_list leaves them out
        packed = met.groupBy(*place, f"_{own}", "_n").agg(F.concat(F.collect_list(key), nulls).alias(key))
        return packed.select(*place, f"_{own}", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias(f"_{other}"), key).repartition(tasks, *place, "_i", "_q")

    met = dealt(i, "image", "i", "q").join(dealt(q, "number", "q", "i").hint("merge"), [*place, "_i", "_q"])
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("number") - 1) / run).cast("int")), lambda k: F.slice("number", k * run + 1, run))
    met = met.select(*place, "image", F.explode(runs).alias("_run"))
    met = met.select(*place, F.explode(F.transform("image", lambda x: F.struct(x.alias("image"), F.col("_run").alias("run")))).alias("_m"))  # with transform, Spark steps from image to image; a bare explode of either would put out a block's pairs at once
    return met.select(*place, F.col("_m.image").alias("image"), F.explode("_m.run").alias("number"))


def carry_last_number(pages: DataFrame) -> DataFrame:
    """For each page the last number that stands on an earlier page of its document. pages: doc, page_no, number (null where none)."""
    return last_before(pages, "doc", "page_no", "number", "carried")


def page_offsets(pages: DataFrame) -> DataFrame:
    """Pages with the place of their first character in the document, pages joined by newlines. pages: doc, page_no, text."""
    sized = pages.select("doc", "page_no", F.length("text").cast("long").alias("n_chars"))
    return sum_before(sized.withColumn("_n", F.col("n_chars") + 1), "doc", "page_no", "_n", "start").select("doc", "page_no", "start", "n_chars")


def trivial_page(text: str, chars: int = 50, lines: int = 2) -> Column:
    """Too short to hold a question: under ``chars`` characters, or at most ``lines`` lines that are not blank."""
    filled = F.filter(F.split(text, "\n", -1), lambda x: T.strip(x) != "")
    return (F.length(T.strip(text)) < chars) | (F.size(filled) <= lines)
