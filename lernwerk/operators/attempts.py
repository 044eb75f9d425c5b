"""Grading of attempts and what is counted from them. Input columns as in ``sources.projection``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

OPTIONS = ("option_a", "option_b", "option_c", "option_d")


def filled(c: str) -> Column:
    """Not null and not only spaces."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def complete_choice() -> Column:
    """Choice questions need four options; other types pass."""
    whole = filled(OPTIONS[0]) & filled(OPTIONS[1]) & filled(OPTIONS[2]) & filled(OPTIONS[3])
    return F.coalesce(F.col("question_type") != "choice", F.lit(True)) | whole


def gradable() -> Column:
    """A choice question with at least one option; the key is checked apart."""
    return (F.col("question_type") == "choice") & F.coalesce(*(F.when(filled(o), True) for o in OPTIONS), F.lit(False))


def best_verified(candidates: DataFrame) -> DataFrame:
    """For each question the verified candidate of highest confidence, then the newest, then the highest id."""
    w = Window.partitionBy("question_id").orderBy(F.desc("confidence"), F.desc("created_at"), F.desc("id"))
    return candidates.filter("is_verified").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The newest row of each key; of equal times the highest id."""
    w = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def with_keys(attempts: DataFrame, questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Attempts with their question and its key: the built-in answer, else the best verified candidate."""
    best = best_verified(candidates).select("question_id", F.col("answer_text").alias("_text"), F.col("source").alias("_source"), F.col("confidence").alias("_confidence"))
    q = questions.withColumnRenamed("id", "question_id")
    own = F.when(filled("answer"), F.trim("answer"))
    joined = attempts.join(q, "question_id").join(best, "question_id", "left")
    return (
        joined.withColumn("key", F.coalesce(own, F.when(filled("_text"), F.trim("_text"))))
        .withColumn("key_source", F.when(own.isNotNull(), "built_in").when(filled("_text"), F.col("_source")))
        .withColumn("key_confidence", F.when(own.isNotNull(), 1.0).when(filled("_text"), F.col("_confidence")))
        .drop("_text", "_source", "_confidence")
    )


def grade(attempts: DataFrame, questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Graded attempts only: ``is_correct`` compares trimmed upper-case answers; attempts without a usable key leave no row."""
    keyed = with_keys(attempts, questions, candidates)
    return keyed.filter(gradable() & F.col("key").isNotNull()).withColumn("is_correct", F.upper(F.trim("user_answer")) == F.upper("key"))


def ratio(places: int | None = None) -> Column:
    r = F.when(F.count("*") == 0, 0.0).otherwise(F.count_if("is_correct") / F.count("*"))
    return r if places is None else F.round(r, places)


def total_accuracy(graded: DataFrame) -> DataFrame:
    return graded.agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), ratio(4).alias("accuracy"))


def subject_accuracy(graded: DataFrame) -> DataFrame:
    return graded.groupBy("subject").agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), ratio().alias("accuracy"))


def tags(c: str = "knowledge_tag") -> Column:
    """The trimmed, non-empty parts of a comma list; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def tag_mastery(graded: DataFrame) -> DataFrame:
    """Correct and wrong attempts for each tag, once for each time it stands in the list; mastery is correct / all."""
    each = graded.select(F.explode(tags()).alias("tag"), "is_correct")
    return each.groupBy("tag").agg(F.count_if("is_correct").alias("correct_count"), F.count_if(~F.col("is_correct")).alias("wrong_count"), (F.count_if("is_correct") / F.count("*")).alias("mastery_score"))


def first_wrongs(graded: DataFrame) -> DataFrame:
    """The first wrong attempt of each question, with how many there are: an aggregate, so that a question that many miss is summed up before it is shuffled."""
    wrong = graded.filter(~F.col("is_correct"))
    found = wrong.groupBy("question_id").agg(F.count("*").alias("frequency"), F.min_by(F.struct(*(c for c in graded.columns if c != "question_id")), F.struct("create_time", "id")).alias("_first"))
    return found.select("question_id", "_first.*", "frequency")


def fallback_tag_wrongs(graded: DataFrame) -> DataFrame:
    """Untagged questions: the first wrong attempt counts under ``subject:chapter``, or the subject."""
    untagged = first_wrongs(graded).filter(F.size(tags()) == 0)
    return untagged.groupBy(F.coalesce(F.concat_ws(":", "subject", F.when(filled("chapter"), F.col("chapter"))), F.lit("")).alias("tag")).agg(F.count("*").alias("wrong_count"))


def weak_list(mastery: DataFrame, limit: int = 20, min_wrong: int = 1) -> DataFrame:
    """Weakest tags first."""
    return mastery.filter(F.col("wrong_count") >= min_wrong).orderBy("mastery_score", "tag").limit(limit)


def weak_summary(mastery: DataFrame, questions: DataFrame | None = None, n: int = 5) -> DataFrame:
    """How many tags are weak and how well they are mastered; with questions also ``weakest``: subject:tag of the ``n`` weakest of each subject, comma-joined."""
    whole = mastery.filter("wrong_count > 0").agg(F.count("*").alias("weak_tags"), F.round(F.coalesce(F.avg("mastery_score"), F.lit(0.0)), 4).alias("average_mastery"))
    if questions is None:
        return whole
    few = weakest_per_subject(mastery, questions, n).agg(F.array_sort(F.collect_list(F.struct("subject", "rank", "tag"))).alias("w"))  # n for each subject
    named = F.array_join(F.transform("w", lambda x: F.concat_ws(":", x["subject"], x["tag"])), ",")
    return whole.join(F.broadcast(few.select(named.alias("weakest"))), F.lit(True))  # one row each


# Fixed value: the subject of a tag that no question has.
UNKNOWN = "未知"
GRAM = 3


def grams(c: str, n: Column | int) -> Column:
    """The distinct runs of ``n`` characters of a text."""
    at = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(c, i, F.lit(n) if isinstance(n, int) else n)))


def tag_subjects(mastery: DataFrame, questions: DataFrame) -> DataFrame:
    """Each tag with the subject of the first question whose tag list contains it, as a whole tag or within one, in any case of letters; ``UNKNOWN`` if none does.

    Lists that repeat are taken once. For every run of up to ``GRAM`` characters the first list that has it and how many have it are summed up, so a tag as short as that is answered by the sums alone. A longer
    tag meets the lists that have the rarest of its runs, and is looked for in these only.
    """
    lists = questions.filter(filled("knowledge_tag")).groupBy(F.lower("knowledge_tag").alias("_list")).agg(F.min(F.struct("id", "subject")).alias("_first"))
    laid = lists.select("_list", "_first", F.explode(F.concat(*(grams("_list", n) for n in range(1, GRAM + 1)))).alias("_gram"))
    runs = laid.groupBy("_gram").agg(F.count("*").alias("_n"), F.min("_first").alias("_first"))
    tags_sought = mastery.select(F.lower("tag").alias("_tag")).filter("_tag <> ''").distinct()
    short = tags_sought.filter(F.length("_tag") <= GRAM).join(runs.hint("merge"), F.col("_tag") == F.col("_gram")).select("_tag", "_first")
    asked = tags_sought.filter(F.length("_tag") > GRAM).select("_tag", F.explode(grams("_tag", GRAM)).alias("_gram"))
    counted = asked.join(runs.select("_gram", "_n").hint("merge"), "_gram", "left")  # a run that no list has: the tag is in none
    rarest = counted.groupBy("_tag").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("r")).filter("r.n > 0").select("_tag", F.col("r.gram").alias("_gram"))
    long = rarest.join(laid.hint("merge"), "_gram").filter(F.contains("_list", F.col("_tag"))).groupBy("_tag").agg(F.min("_first").alias("_first"))
    found = short.unionByName(long).select("_tag", F.col("_first.subject").alias("subject"))
    met = mastery.withColumn("_tag", F.lower("tag")).join(found.hint("merge"), "_tag", "left").drop("_tag")
    return met.withColumn("subject", F.coalesce("subject", F.lit(UNKNOWN)))


def weakest_per_subject(mastery: DataFrame, questions: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("subject").orderBy("mastery_score", "tag")
    return tag_subjects(mastery.filter("wrong_count > 0"), questions).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def grade_reviews(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers given again, from the error book: of questions of any type, by the built-in answer alone; without one every answer is wrong."""
    key = questions.select(F.col("id").alias("question_id"), F.col("answer").alias("_key"))
    right = F.coalesce(F.upper(F.trim("user_answer")) == F.upper(F.trim("_key")), F.lit(False)) & filled("_key")
    return attempts.join(key, "question_id").withColumn("is_correct", right).drop("_key")


def wrong_book(graded: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """The error book: a row for each question answered wrong, from its first wrong attempt on.

    ``unreviewed`` after one wrong attempt, ``wrong`` after more. A review (question_id, id, create_time, is_correct) sets the status to its result and is counted, if it comes after the first wrong attempt; before that there is nothing to review. The
    last of wrong attempts and reviews, by time and id, gives the status.
    """
    at = F.struct("create_time", "id")
    wrong = graded.filter(~F.col("is_correct"))
    book = wrong.groupBy("question_id", "subject", "chapter").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.count("*").alias("wrong_attempts"))
    book = book.withColumn("added_at", F.col("_first.create_time"))
    unseen = F.when(F.col("wrong_attempts") > 1, "wrong").otherwise("unreviewed")
    if reviews is None:
        out = book.withColumns({"last_status": unseen, "review_count": F.lit(0).cast("long"), "last_review_at": F.lit(None).cast(book.schema["added_at"].dataType)})
    else:
        later = reviews.select("question_id", at.alias("_at"), "is_correct").join(book.select("question_id", "_first").hint("merge"), "question_id").filter("_at > _first")
        seen = later.groupBy("question_id").agg(F.count("*").alias("_n"), F.max("_at").alias("_at"), F.max_by("is_correct", "_at").alias("_ok"))
        joined = book.join(seen.hint("merge"), "question_id", "left")
        status = F.when(F.col("_at") > F.col("_last"), F.when(F.col("_ok"), "correct").otherwise("wrong")).otherwise(unseen)
        out = joined.withColumns({"last_status": status, "review_count": F.coalesce("_n", F.lit(0)).cast("long"), "last_review_at": F.col("_at.create_time")})
    return out.select("question_id", "subject", "chapter", "added_at", "wrong_attempts", "last_status", "review_count", "last_review_at")


def wrong_stats(book: DataFrame) -> DataFrame:
    """Counts over all, for each subject and for each status; ``review_rate``: the share that is no longer unreviewed."""
    counts = book.groupingSets([[], [F.col("subject")], [F.col("last_status")]], "subject", "last_status")
    flags = (F.grouping(c).cast("int").alias(f"all_{name}") for c, name in (("subject", "subjects"), ("last_status", "statuses")))
    return counts.agg(*flags, F.count("*").alias("n"), F.round(F.count_if(F.col("last_status").isin("correct", "wrong")) / F.count("*"), 2).alias("review_rate"))


def wrong_list(book: DataFrame, questions: DataFrame, subject: str | None = None, chapter: str | None = None, status: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of the error book, the newest first (then by question id), with the first 80 characters of the question as they are, the number of matching rows and of pages."""
    for name, value in (("subject", subject), ("chapter", chapter), ("last_status", status)):
        book = book if value is None else book.filter(F.col(name) == value)
    total = book.agg(F.count("*").alias("total"))
    rows = book.orderBy(F.desc("added_at"), "question_id").offset((page - 1) * page_size).limit(page_size)
    body = F.coalesce("question_text", F.lit(""))
    text = questions.select(F.col("id").alias("question_id"), F.concat(F.substring(body, 1, 80), F.when(F.length(body) > 80, "...").otherwise("")).alias("preview"))
    met = rows.join(text.hint("merge"), "question_id", "left").join(F.broadcast(total), F.lit(True))  # one row
    return met.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("long"))


def wrong_chapters(book: DataFrame, subject: str) -> DataFrame:
    return book.filter((F.col("subject") == subject) & filled("chapter")).select("chapter").distinct().orderBy("chapter")


def question_tag() -> Column:
    """What a misconception is filed under: the tag list as it is, else ``subject:chapter``, else the subject."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return F.when(has("knowledge_tag"), F.col("knowledge_tag")).when(has("chapter"), F.concat("subject", F.lit(":"), "chapter")).otherwise(F.col("subject"))


# What is said of a wrong answer without an analysis.
CHOSEN, GIVEN_ANSWER, RIGHT_ANSWER = "选了", "选择了", "，正确答案是"
REMEDY, REPEAT = "建议复习该章节相关知识点", ["复习相关知识点", "重做同类题"]


def misconceptions(graded: DataFrame) -> DataFrame:
    """One row for each question answered wrong: the first wrong answer, how often it went wrong, and what the rules say of it. ``analysis`` of the question is used where there is one."""
    said = lambda how: F.concat(F.lit(how), F.coalesce("user_answer", F.lit("")), F.lit(RIGHT_ANSWER), "key")
    path = F.coalesce("analysis", F.lit("")) if "analysis" in graded.columns else F.lit("")
    return first_wrongs(graded).select(
        "question_id", "subject", "chapter", "user_answer", F.col("key").alias("correct_answer"), question_tag().alias("related_knowledge_tag"), "frequency", F.col("create_time").alias("created_at"),
        said(CHOSEN).alias("misconception_summary"), F.coalesce("chapter", F.lit("")).alias("knowledge_gap"), F.lit(REMEDY).alias("remediation"), said(GIVEN_ANSWER).alias("error_cause"),
        F.lit("[]").alias("confused_concepts_json"), path.alias("correct_reasoning_path"), F.to_json(F.array(*map(F.lit, REPEAT))).alias("recommended_actions_json"),
        F.lit(0.3).alias("analysis_confidence"), F.lit(None).cast("string").alias("analysis_model"), F.lit("fallback").alias("analysis_source"),
    )


def misconception_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("subject", "chapter").agg(F.count("*").alias("n"), F.sum("frequency").alias("attempts"))


def misconception_list(found: DataFrame, subject: str | None = None, skip: int = 0, limit: int = 20) -> DataFrame:
    """The newest misconceptions, of a subject or of all, with the number of matching ones."""
    found = found if subject is None else found.filter(F.col("subject") == subject)
    rows = found.orderBy(F.desc("created_at"), "question_id").offset(skip).limit(limit)
    return rows.join(F.broadcast(found.agg(F.count("*").alias("total"))), F.lit(True))  # one row


def misconception_stats(found: DataFrame) -> DataFrame:
    """For each subject, and in the row with ``all_subjects`` 1 for all."""
    return found.rollup("subject").agg(F.grouping("subject").cast("int").alias("all_subjects"), F.countDistinct("chapter").alias("chapters"), F.count("*").alias("n"), F.sum("frequency").alias("attempts"))


def attempt_history(attempts: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    return attempts.orderBy(F.desc("create_time"), F.desc("id")).offset(skip).limit(limit)


def in_first_order(rows: DataFrame, items: Column) -> DataFrame:
    """tag, items: the distinct items of each tag in the order in which its rows, newest first, have them. rows: tag, created_at, question_id."""
    each = rows.select("tag", "created_at", "question_id", F.posexplode(items).alias("pos", "item"))
    age = -F.col("created_at").cast("timestamp").cast("double")
    first = each.groupBy("tag", "item").agg(F.min(F.struct(age.alias("age"), "question_id", "pos")).alias("at"))
    return first.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("items"))


def weak_point_enrich(mastery: DataFrame, found: DataFrame, questions: DataFrame, split_tags: bool = False) -> DataFrame:
    """Weak tags with their misconceptions: those filed under just this tag, or with ``split_tags`` those whose tag list has it.

    Their number, sorted question ids, distinct confused concepts and recommended actions with those of newer ones first, the summary of the newest that has one, subject and
    chapter of the newest that has them. Where that leaves one out, it comes from the first question with the tag, whose id joins the others then.
    found: question_id, subject, chapter, related_knowledge_tag, created_at, and confused_concepts_json, recommended_actions_json, misconception_summary.
    """
    rows = found.withColumn("tag", F.explode(F.array_distinct(tags("related_knowledge_tag"))) if split_tags else F.col("related_knowledge_tag")).filter("tag IS NOT NULL")
    newest = F.struct(F.col("created_at"), (-F.col("question_id")).alias("q"))
    latest_of = lambda c: F.max_by(c, F.when(filled(c), newest))
    by_tag = rows.groupBy("tag").agg(F.count("*").alias("n"), F.collect_set("question_id").alias("ids"), *(latest_of(c).alias(c) for c in ("subject", "chapter")), latest_of("misconception_summary").alias("summary"))
    concepts = in_first_order(rows, T.json_list("confused_concepts_json")).withColumnRenamed("items", "confused_concepts")
    actions = in_first_order(rows, T.json_list("recommended_actions_json")).withColumnRenamed("items", "recommended_actions")
    each = questions.select("id", "subject", "chapter", F.explode(F.array_distinct(tags())).alias("tag"))
    first = each.groupBy("tag").agg(F.min(F.struct("id", "subject", "chapter")).alias("q"))
    out = mastery.filter("wrong_count > 0")
    for part in (by_tag, concepts, actions, first):
        out = out.join(part.hint("merge"), "tag", "left")
    lacking = ~(filled("subject") & filled("chapter")) & F.col("q").isNotNull()
    ids = F.coalesce("ids", F.array().cast("array<bigint>"))
    listed = F.array_join(F.array_sort(F.when(lacking, F.array_union(ids, F.array("q.id"))).otherwise(ids)), ",")
    own = lambda c: F.coalesce(F.when(filled(c), F.col(c)), F.col(f"q.{c}")).alias(c)
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
    return out.select("tag", "wrong_count", "correct_count", "mastery_score", own("subject"), own("chapter"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("n", F.lit(0)).alias("misconception_count"), joined("confused_concepts"), joined("recommended_actions"), listed.alias("question_ids"))
