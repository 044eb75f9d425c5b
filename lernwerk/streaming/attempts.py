"""The attempt analytics on a stream of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import attempts as A
from ..sources.projection import attempt_columns
from .tables import read_table


def read_stream(spark: SparkSession, sf_dir: str, events: str | None = None) -> DataFrame:
    """The attempts of the table of events as a stream; ``events``: a folder with files of such rows below it, in place of the table."""
    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    if events:
        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        found = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(events)
    else:
        found = read_table(spark, sf_dir, "events")
    return spark.sql(f"SELECT {attempt_columns(n)} FROM {{t}}", t=found)


def grade_stream(stream: DataFrame, questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Graded on arrival: a stream-static join; the static side is ranked in batch."""
    return A.grade(stream, questions, candidates)


def mastery_stream(graded: DataFrame) -> DataFrame:
    """Counters for each tag, in update mode: a batch gives the tags that it changes."""
    return A.tag_mastery(graded)


def accuracy_trend(graded: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Accuracy for each subject and window of time, for append mode: a window is written once, when the watermark, the latest time of earlier batches less ``late``, has passed its end.

    Its state goes then; rows of windows that are closed are dropped.
    """
    timed = graded.withColumn("create_time", F.col("create_time").cast("timestamp"))
    return timed.withWatermark("create_time", late).groupBy(F.window("create_time", width), "subject").agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"))


def trend_so_far(graded: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """The windows of ``accuracy_trend`` for update mode: a batch gives the windows that it changes, by start and subject, so those that are still open are there too; late rows and state go as there."""
    return accuracy_trend(graded, late, width).select(F.col("window.start").alias("start"), "subject", "total", "correct")


def misconception_stream(graded: DataFrame) -> DataFrame:
    """For each question answered wrong: how often, and the first wrong answer by time and id, whatever the order of batches. In update mode a batch gives the questions that it changes."""
    wrong = graded.filter(~F.col("is_correct"))
    return wrong.groupBy("question_id").agg(F.count("*").alias("frequency"), F.min_by("user_answer", F.struct("create_time", "id")).alias("user_answer"))


BOOK = "question_id long, subject string, chapter string, added_at timestamp, wrong_attempts long, last_status string, review_count long, last_review_at timestamp"


#: So many ids in sequence share a group and its state, so that a call of the processor has more than one question to work on.
SPAN = 256


class ErrorBook(StatefulProcessor):
    """The error book of a span of questions, a row for each: the first wrong attempt makes it, later ones and reviews change it; reviews before it count for nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", BOOK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        book = pd.DataFrame([tuple(r) for r in self.rows.get()] if self.rows.exists() else [], columns=NAMES, dtype=object)
        events = pd.concat(list(rows))
        for found in (book, events):
            found["q"] = found["question_id"].astype(object).where(found["question_id"].notna(), -1)  # ids that are null are a span of their own
        events = events.sort_values(["q", "create_time", "id"], kind="stable")
        book = book.set_index("q")
        wrong = ~events["is_review"]
        moves = events[events["q"].isin(book.index) | (wrong.groupby(events["q"]).cumsum() > 0)]
        if moves.empty:
            return
        wrongs = moves[~moves["is_review"]]
        reviews = moves[moves["is_review"]]
        first, last = wrongs.drop_duplicates("q").set_index("q"), moves.drop_duplicates("q", keep="last").set_index("q")
        n_wrong, n_reviews, reviewed = wrongs["q"].value_counts().to_dict(), reviews["q"].value_counts().to_dict(), dict(zip(reviews["q"], reviews["create_time"], strict=True))
        held, firsts = {r[0]: r[1:] for r in book.itertuples(name=None)}, {r[0]: r[1:] for r in first[["subject", "chapter", "create_time"]].itertuples(name=None)}
        changed = []
        for q, is_review, is_correct in last[["is_review", "is_correct"]].itertuples(name=None):
            if q in held:
                row = dict(zip(NAMES, held[q], strict=True))
            else:
                subject, chapter, at = firsts[q]
                row = dict(zip(NAMES, (None if key[0] is None else int(q), subject, chapter, at.to_pydatetime(), 0, None, 0, None), strict=True))
            row["wrong_attempts"] += n_wrong.get(q, 0)
            row["review_count"] += n_reviews.get(q, 0)
            row["last_status"] = ("correct" if is_correct else "wrong") if is_review else "wrong" if row["wrong_attempts"] > 1 else "unreviewed"
            if q in reviewed:
                row["last_review_at"] = reviewed[q].to_pydatetime()
            held[q] = tuple(row[n] for n in NAMES)
            changed.append(held[q])
        self.rows.put(list(held.values()))
        out = pd.DataFrame(changed, columns=NAMES)
        for c in ("added_at", "last_review_at"):
            out[c] = pd.to_datetime(out[c])
        yield out

    def close(self) -> None:
        pass


NAMES = [x.split()[0] for x in BOOK.split(", ")]


def wrong_book_stream(events: DataFrame, span: int = SPAN) -> DataFrame:
    """Rows of the error book that a batch changes, in update mode. events: id, question_id, subject, chapter, create_time, is_correct, is_review.

    A question's events are taken by time and id within a batch, and in the order of batches; a batch's wrong attempts and reviews of ``span`` questions are held by one task. A checkpoint keeps its span.
    """
    timed = events.select("id", "question_id", "subject", "chapter", F.col("create_time").cast("timestamp"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("is_correct", "is_review")), F.floor(F.col("question_id") / span).alias("span"))
    moving = timed.filter("is_review OR NOT is_correct")  # a right answer leaves the book alone
    return moving.groupBy("span").transformWithStateInPandas(ErrorBook(), BOOK, "Update", "None")
