"""Streams of several batches: late rows, state that ends, a batch that runs twice, a restart in the middle; equal to the batch results."""

import datetime as dt
import random
import shutil

from pyspark.sql import functions as F

from lernwerk import catalog
from lernwerk.operators import attempts as A
from lernwerk.streaming import attempts as ST
from lernwerk.streaming import tables as TB

EVENT = "id long, question_id long, subject string, chapter string, knowledge_tag string, user_answer string, create_time timestamp, is_correct boolean, is_review boolean"


def rows_of(seed, n, start=0):
    r = random.Random(seed)
    at = dt.datetime(2024, 1, 1)
    return [(start + i, r.randint(0, 12), "s", None if r.random() < 0.3 else "c", r.choice(["a", "a, b", "b,c", None]), r.choice("ABCD"), at + dt.timedelta(hours=start + i - r.randint(0, 2)), r.random() < 0.5, r.random() < 0.3) for i in range(n)]


def arrive(spark, root, name, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{root}/in/{name}")


def stream_of(spark, root):
    return spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(f"{root}/in")


def plain(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_trend_closes_windows_once_and_drops_late_rows(spark, tmp_path):
    root, day = str(tmp_path), dt.timedelta(days=1)
    at = dt.datetime(2024, 1, 1, 12)
    batches = [[at, at, at + day], [at + 3 * day], [at + 3 * day, at - 18 * day], [at + 6 * day]]
    written = []
    for i, times in enumerate(batches):
        arrive(spark, root, str(i), [(10 * i + j, 1, "s", None, None, "A", t, True, False) for j, t in enumerate(times)])
        trend = ST.accuracy_trend(stream_of(spark, root)).select("window.start", "subject", "total", "correct")
        TB.run(trend, f"{root}/out", "append")
        written.append({(r.start.day, r.total) for r in TB.changes(spark, f"{root}/out", trend).collect()})
    assert written[0] == set() and written[1] == written[2] == {(1, 2), (2, 1)}  # the day of the late row is never written
    assert written[3] == {(1, 2), (2, 1), (4, 2)}  # the last day is still open
    assert TB.changes(spark, f"{root}/out", trend).count() == 3


def test_updates_are_kept_by_key(spark, tmp_path):
    root, all_rows = str(tmp_path), []
    for i in range(3):
        rows = rows_of(i, 40, 40 * i) if i < 2 else [(99, 3, "s", "c", "c", "D", dt.datetime(2024, 2, 1), False, False)]
        all_rows += rows
        arrive(spark, root, str(i), rows)
        for name, f in (("tags", ST.mastery_stream), ("firsts", ST.misconception_stream)):
            out = f(stream_of(spark, root))
            TB.run(out, f"{root}/{name}", "update")
    batch = spark.createDataFrame(all_rows, EVENT)
    assert plain(TB.current(spark, f"{root}/tags", out := ST.mastery_stream(stream_of(spark, root)), ["tag"])) == plain(A.tag_mastery(batch))
    assert {r.tag for r in TB.changes(spark, f"{root}/tags", out).filter("batch = 2").collect()} == {"c"}  # only what changed
    found = ST.misconception_stream(stream_of(spark, root))
    want = A.first_wrongs(batch).select("question_id", "frequency", "user_answer")
    assert plain(TB.current(spark, f"{root}/firsts", found, ["question_id"])) == plain(want)
    shutil.copytree(f"{root}/tags/changes/batch=1", f"{root}/again")  # the same batch once more
    spark.read.parquet(f"{root}/again").write.mode("overwrite").parquet(f"{root}/tags/changes/batch=1")
    assert plain(TB.current(spark, f"{root}/tags", out, ["tag"])) == plain(A.tag_mastery(batch))
    TB.compact(spark, f"{root}/tags", out, ["tag"], f"{root}/compacted")
    assert plain(TB.current(spark, f"{root}/compacted", out, ["tag"])) == plain(A.tag_mastery(batch))


def test_error_book_steps_and_restart(spark, tmp_path):
    """Each batch is a run of its own from the checkpoint, so the state of a question outlives the query."""
    root, all_rows, seen = str(tmp_path), [], {}
    at = lambda d: dt.datetime(2024, 1, d)
    steps = [
        [(1, 50, "s", "c", None, "A", at(1), True, True), (2, 50, "s", "c", None, "A", at(2), False, False)],  # a review of what is not there, the first wrong
        [(3, 50, None, None, None, "A", at(3), True, True)],
        [(4, 50, "s", "c", None, "A", at(4), True, False)],  # a right answer leaves the row alone
        [(6, 50, "s", "c", None, "A", at(5), False, False), (5, 50, None, None, None, "A", at(5), True, True)],  # equal times: by id
    ]
    want = [("unreviewed", 0, 1), ("correct", 1, 1), ("correct", 1, 1), ("wrong", 2, 2)]
    for i, step in enumerate(steps):
        rows = step + rows_of(10 + i, 30, 100 + 30 * i)
        all_rows += rows
        arrive(spark, root, str(i), rows)
        out = ST.wrong_book_stream(stream_of(spark, root))
        TB.run(out, f"{root}/book", "update")
        now = {r.question_id: r for r in TB.current(spark, f"{root}/book", out, ["question_id"]).collect()}
        seen[i] = (now[50].last_status, now[50].review_count, now[50].wrong_attempts)
    assert list(seen.values()) == want and now[50].added_at == at(2) and now[50].last_review_at == at(5)
    events = spark.createDataFrame(all_rows, EVENT)
    book = A.wrong_book(events.filter("NOT is_review").withColumn("chapter", F.lit("c")), events.filter("is_review"))
    streamed = TB.current(spark, f"{root}/book", out, ["question_id"]).withColumn("chapter", F.lit("c"))
    assert plain(streamed) == plain(book)


def test_tables_in_several_files_are_streamed_whole(spark, tmp_path):
    """a table is one file or a folder of files; of each text the smallest id stays."""
    made = {i: f"text {i // 7 % 9 if i > 100 else i}" for i in range(7, 490, 7)}  # all with the same mark
    texts = spark.createDataFrame([(i, x, "en", "s", 6) for i, x in made.items()], "doc_id long, text string, lang string, source string, n_chars long")
    events = spark.range(50).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 5 AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    parts = spark.range(9).selectExpr("id AS p_partkey")
    stored = {x for i, x in made.items() if i % 3 == 0}
    want = sorted(min(i for i in made if made[i] == x and i % 3) for x in {x for i, x in made.items() if i % 3} - stored)
    single = tmp_path / "single"
    single.mkdir()
    for table, rows in (("documents", texts), ("events", events), ("part", parts)):
        rows.repartition(3).write.parquet(f"{tmp_path}/folder/{table}.parquet")
        rows.coalesce(1).write.parquet(f"{tmp_path}/one/{table}.parquet")
        shutil.copy(next((tmp_path / "one" / f"{table}.parquet").glob("part-*.parquet")), single / f"{table}.parquet")
    for where in (tmp_path / "folder", single):
        assert want and sorted(r.id for r in catalog.QUERIES["stream_dedup_ingest"](spark, str(where)).collect()) == want
        read = ST.read_stream(spark, str(where))
        TB.run(read, f"{tmp_path}/out-{where.name}", "append")
        assert TB.changes(spark, f"{tmp_path}/out-{where.name}", read).count() == 50


def test_trend_holds_all_days(spark, tmp_path):
    """days that the watermark has not closed yet are in the result too."""
    root, day, at = str(tmp_path), dt.timedelta(days=1), dt.datetime(2024, 1, 1, 12)
    for i, times in enumerate([[at, at, at + day], [at + day, at + 3 * day], [at - 18 * day, at + 3 * day]]):
        arrive(spark, root, str(i), [(10 * i + j, 1, "s", None, None, "A", t, True, False) for j, t in enumerate(times)])
        out = ST.trend_so_far(stream_of(spark, root))
        TB.run(out, f"{root}/out", "update")
    got = {(r.start.day, r.total, r.correct) for r in TB.current(spark, f"{root}/out", out, ["start", "subject"]).collect()}
    assert got == {(1, 2, 2), (2, 2, 2), (4, 2, 2)}  # the row that came after its day was closed is not counted


def test_questions_share_the_state_of_a_span(spark, tmp_path):
    """a call of the processor works on a span of questions, whose book is that of the batch; a batch gives only questions that it changes."""
    root, all_rows = str(tmp_path), []
    for i in range(2):
        all_rows += (rows := rows_of(30 + i, 60, 60 * i))
        arrive(spark, root, str(i), rows)
        out = ST.wrong_book_stream(stream_of(spark, root), span=5)
        TB.run(out, f"{root}/book", "update")
    events = spark.createDataFrame(all_rows, EVENT)
    book = A.wrong_book(events.filter("NOT is_review").withColumn("chapter", F.lit("c")), events.filter("is_review"))
    assert plain(TB.current(spark, f"{root}/book", out, ["question_id"]).withColumn("chapter", F.lit("c"))) == plain(book)
    assert ST.SPAN > 1
