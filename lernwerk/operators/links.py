"""Linking texts, pages, images and answers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .banks import page_offsets
from .ordered import carried


def character_sets(rows: DataFrame, ranks: dict[str, int], chars: int) -> DataFrame:
    """id, subject, ``s``: the places, in an order of rare characters first, of the first ``chars`` characters that are no white space."""
    head = F.substring(F.regexp_replace("text", r"(?U)\s+", ""), 1, chars)
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(map(shared.value.__getitem__, set(t))) if t else [] for t in batch["t"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["subject"], pa.array(sets, pa.list_(pa.int32()))], names=["id", "subject", "s"])

    kept = rows.select("id", "subject", head.alias("t"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, subject string, s array<int>")


def fuzzy_answers(answers: DataFrame, questions: DataFrame, threshold: float = 0.6, chars: int = 50) -> DataFrame:
    """For each answer the question of its subject with the most similar character set, strictly above the threshold.

    Jaccard similarity of the sets of the first ``chars`` characters that are no white space; ties to the smaller question id. Both have id, subject, text. Questions of equal sets are taken once. A set of n characters keeps the
    n - ceil(threshold * n) + 1 rarest: two sets that are similar enough share one of these, so a pair meets by such a character only, at the rarest one that it shares, if the sizes allow. The
    order of characters comes from their counts in both tables; there are as many as Unicode has, at most. Empty and null texts meet nothing.
    """
    head = F.substring(F.regexp_replace("text", r"(?U)\s+", ""), 1, chars)
    letters = answers.select(head.alias("t")).unionByName(questions.select(head.alias("t"))).select(F.explode(F.array_distinct(F.split("t", ""))).alias("c"))
    counts = letters.filter("c <> ''").groupBy("c").agg(F.count("*").alias("n")).toArrow()
    ranks = {c: i for i, (_, c) in enumerate(sorted(zip(counts["n"].to_pylist(), counts["c"].to_pylist(), strict=True)))}
    sets = lambda d: character_sets(d, ranks, chars).filter(F.size("s") > 0)
    distinct = sets(questions).groupBy("subject", F.col("s").alias("q")).agg(F.min("id").alias("q_id"))
    laid = distinct.withColumn("p", kept_of("q", threshold)).withColumn("c", F.explode("p"))
    asked = sets(answers).select(F.col("id").alias("a_id"), "subject", F.col("s").alias("a"), kept_of("s", threshold).alias("ap")).withColumn("c", F.explode("ap"))
    n, m = F.size("a"), F.size("q")
    met = laid.join(asked.hint("merge"), ["subject", "c"]).filter((F.least(n, m) > threshold * F.greatest(n, m)) & (F.array_min(F.array_intersect("ap", "p")) == F.col("c")))
    shared = F.size(F.array_intersect("a", "q"))
    scored = met.withColumn("score", shared / (n + m - shared)).filter(F.col("score") > threshold)
    best = scored.groupBy("a_id").agg(F.max(F.struct("score", (-F.col("q_id")).alias("m"))).alias("b"))
    return best.select(F.col("a_id").alias("answer_id"), (-F.col("b.m")).alias("question_id"), F.col("b.score").alias("score"))


def kept_of(c: str, threshold: float) -> Column:
    """The rarest characters of a set, one of which every similar set has among its own."""
    return F.slice(c, 1, F.size(c) - F.ceil(F.lit(threshold) * F.size(c) - 1e-9).cast("int") + 1)


def fill_answers(recovered: DataFrame, questions: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Questions that recovered answers fill, with the filled ``answer`` and ``analysis``.

    recovered: id, subject, text, answer, analysis; questions: id, subject, text, answer, analysis. A recovered row without text or answer does nothing. The others look for their most similar
    question; if that has no answer, the first of them, by id, gives its answer in capitals, and its analysis if there was none. A question that has an answer stays as it is, and
    nobody turns to the second best.
    """
    trimmed = lambda c: T.strip(F.coalesce(c, F.lit("")))
    told = recovered.select("id", "subject", trimmed("text").alias("text"), F.upper(trimmed("answer")).alias("new_answer"), trimmed("analysis").alias("new_analysis")).filter("text <> '' AND new_answer <> ''")
    best = fuzzy_answers(told, questions, threshold).join(told.select(F.col("id").alias("answer_id"), "new_answer", "new_analysis").hint("merge"), "answer_id")
    first = best.groupBy("question_id").agg(F.min(F.struct("answer_id", "new_answer", "new_analysis")).alias("b"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    met = questions.filter(empty("answer")).join(first.hint("merge"), F.col("id") == F.col("question_id"))
    return met.select("question_id", F.col("b.answer_id").alias("answer_id"), F.col("b.new_answer").alias("answer"), F.when(empty("analysis") & (F.col("b.new_analysis") != ""), F.col("b.new_analysis")).otherwise(F.col("analysis")).alias("analysis"))


def nearest_above(questions: DataFrame, images: DataFrame, same_page: bool = False, width: int = 64) -> DataFrame:
    """Each image goes to the closest question at or above it, else to the last question of an earlier page.

    questions: doc, page, y, number; images: doc, page, y, image. A backward as-of join: pages are worked out by ranges of ``width``, and what is above a range is carried on; no pairs, no task with a whole document.
    Of questions at one place the greatest number counts.
    """
    both = questions.select("doc", "page", "y", F.lit(0).alias("_o"), "number", F.lit(None).cast("long").alias("image")).unionByName(images.select("doc", "page", "y", F.lit(1).alias("_o"), F.lit(None).cast("long").alias("number"), F.col("image").cast("long")))
    above = F.struct(F.col("page").alias("page"), F.col("number").alias("number"))
    told = carried(both, "doc", ["page", "y", "_o", "number"], {"_above": F.when(F.col("_o") == 0, above)}, width=width).filter("_o = 1")
    near = F.when(F.col("_above.page").eqNullSafe(F.col("page")), F.col("_above.number")) if same_page else F.col("_above.number")
    return told.select("doc", "image", near.alias("number"))


def offset_pages(offsets: DataFrame, pages: DataFrame, width: int = 1 << 20) -> DataFrame:
    """The page whose character range holds an offset. offsets: doc, off; pages: doc, page_no, text in page order, joined by newlines.

    A backward as-of join within stretches of ``width`` characters of a document: no pairs, and no task holds a whole document. A page that reaches into more stretches
    stands in each. Null offsets and documents, and offsets that no page holds, give no row.
    """
    ranged = page_offsets(pages).filter("doc IS NOT NULL").withColumn("end", F.col("start") + F.col("n_chars") + 1)
    part = lambda c: F.floor(F.col(c) / width)
    laid = ranged.select("doc", "page_no", "start", "end", F.explode(F.sequence(part("start"), F.floor((F.col("end") - 1) / width))).alias("part"))
    laid = laid.select("doc", "part", F.greatest("start", F.col("part") * width).alias("at"), F.struct("page_no", "end").alias("page"), F.lit(None).cast("long").alias("off"))
    sought = offsets.filter("doc IS NOT NULL AND off IS NOT NULL").withColumn("off", F.col("off").cast("long"))
    sought = sought.select("doc", part("off").alias("part"), F.col("off").alias("at"), F.lit(None).cast(laid.schema["page"].dataType).alias("page"), "off")
    w = Window.partitionBy("doc", "part").orderBy("at", F.asc_nulls_first("off")).rowsBetween(Window.unboundedPreceding, 0)
    met = laid.unionByName(sought).withColumn("page", F.last("page", ignorenulls=True).over(w))
    return met.filter(F.col("off").isNotNull() & (F.col("off") < F.col("page.end"))).select("doc", "off", "page.page_no")


def cluster_boxes(boxes: DataFrame, gap: float = 30.0, share: float = 0.05, least_height: float = 20.0, pad: float = 0.1) -> DataFrame:
    """Boxes of a page that form figures. boxes: page, id, left, top, right, bottom, page_width, page_height.

    Boxes of more than 0.8 of the page both ways, and those under 5 both ways, go. The others, by top, join while the next top is less than ``gap`` under the lowest bottom
    so far. A cluster of at least ``share`` of the page and ``least_height`` stays, widened by ``pad`` of its height within the page.
    """
    width, height = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    border = (width > 0.8 * F.col("page_width")) & (height > 0.8 * F.col("page_height"))
    fine = boxes.filter(~border & ~((width < 5) & (height < 5)))
    order = Window.partitionBy("page").orderBy("top", "bottom", "id")
    low = F.max("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(low.isNull() | (F.col("top") - low >= gap), 1).otherwise(0)
    numbered = fine.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("page", "cluster").agg(F.min("left").alias("l"), F.min("top").alias("t"), F.max("right").alias("r"), F.max("bottom").alias("b"), F.count("*").alias("n"), F.max("page_width").alias("w"), F.max("page_height").alias("h"))
    kept = whole.filter(((F.col("r") - F.col("l")) * (F.col("b") - F.col("t")) >= share * F.col("w") * F.col("h")) & (F.col("b") - F.col("t") >= least_height)).withColumn("p", pad * (F.col("b") - F.col("t")))
    low_end, high_end = (lambda c: F.greatest(F.lit(0.0), F.col(c) - F.col("p"))), (lambda c, m: F.least(F.col(m).cast("double"), F.col(c) + F.col("p")))
    return kept.select("page", "cluster", low_end("l").alias("left"), low_end("t").alias("top"), high_end("r", "w").alias("right"), high_end("b", "h").alias("bottom"), "n")


def resolve_refs(refs: DataFrame, listing: DataFrame) -> DataFrame:
    """Image references with ``found``: whether a file of that path is listed. refs: ref; listing: path."""
    there = listing.select(F.col("path").alias("ref"), F.lit(True).alias("found")).distinct()
    return refs.join(there.hint("merge"), "ref", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def hash_key(rows: DataFrame) -> Column:
    """The hash that a row of a package names its question by: ``question_text_hash``, or ``text_hash`` where that is missing, null or empty."""
    named = [F.nullif(F.col(c), F.lit("")) for c in ("question_text_hash", "text_hash") if c in rows.columns]
    return F.coalesce(*named) if named else F.lit(None).cast("string")


def relink_by_hash(attached: DataFrame, inserted: DataFrame) -> DataFrame:
    """Rows that name a question by its text hash get the id of the newly inserted question; the hash is called ``question_text_hash`` then."""
    keyed = attached.withColumn("question_text_hash", hash_key(attached))
    return keyed.join(inserted.select(F.col("text_hash").alias("question_text_hash"), F.col("id").alias("question_id")).hint("merge"), "question_text_hash")


def apply_corrections(questions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrected fields by id: those columns of ``corrections`` besides id. Null keeps the original, a value that still has private-use characters is refused.

    ``n_corrected`` and ``n_refused`` count the fields of a row. The hash follows the question text.
    """
    fields = [c for c in corrections.columns if c != "id"]
    c = corrections.select("id", *(F.col(f).alias(f"_{f}") for f in fields))
    joined = questions.join(c.hint("merge"), "id", "left")
    fine = {f: F.col(f"_{f}").isNotNull() & (T.pua_count(f"_{f}") == 0) for f in fields}
    total = lambda flags: sum((F.coalesce(x, F.lit(False)).cast("long") for x in flags), F.lit(0).cast("long"))
    joined = joined.withColumns({"n_corrected": total(fine.values()), "n_refused": total(F.col(f"_{f}").isNotNull() & (T.pua_count(f"_{f}") > 0) for f in fields)})
    out = joined.withColumns({f: F.when(fine[f], F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).drop(*(f"_{f}" for f in fields))
    return out.withColumn("text_hash", T.text_hash("question_text"))
