"""Package, reply and option operators on small tables: nulls, blanks, broken replies, ties."""

from pyspark.sql import functions as F

from lernwerk.functions import replies as R
from lernwerk.functions import text as T
from lernwerk.operators import banks as B


def test_replies_and_lists(spark):
    rows = spark.createDataFrame([('```json\n{"answer": "b", "confidence": 0.9, "usable": "yes"}\n```',), ("broken",), (None,)], "x string")
    got = [r.y for r in rows.select(R.candidate("x").alias("y")).collect()]
    assert [(y.answer, y.confidence, y.usable) for y in got] == [("B", 0.9, True), ("", 0.0, False), ("", 0.0, False)]
    assert [r.y.cause for r in rows.select(R.analysis("x").alias("y")).collect()][1:] == ["broken", None]
    assert [r.y for r in rows.select(F.size(R.page_answers("x")).alias("y")).collect()] == [0, 0, 0]
    assert [r.y for r in rows.select(R.appended("x", F.lit("broken")).alias("y")).collect()][1:] == ["broken", "broken"]
    one = spark.createDataFrame([("Q?主A. x F8B. y b.z\nD. w",), ("no options",), ("C. first A. x",), (None,)], "x string")
    assert [tuple(r.y) for r in one.select(T.inline_options("x").alias("y")).collect()] == [("Q?主", "x F8B. y", "z", None, "w"), ("no options", None, None, None, None), ("C. first", "", None, "first A. x", None), (None,) * 5]


def test_banks(spark):
    rows = spark.createDataFrame([(1, "f", "a", "h"), (2, "f", "a", "h"), (3, "g", " ", "e"), (4, "g", "s", "k")], "id long, file string, question_text string, text_hash string")
    got = {r.file: (r.found, r.success, r.skipped, r.error) for r in B.import_report(rows, rows.filter("id = 4")).collect()}
    assert got == {"f": (2, 1, 1, 0), "g": (2, 0, 1, 1), None: (4, 1, 2, 1)}
    kept, gone = B.remove_batch(rows, spark.createDataFrame([(1,), (9,)], "id long"))
    assert kept.count() == 3 and gone.count() == 1
    files = spark.createDataFrame([("/d/A.PDF",), ("/d/b.md",)], "path string")
    named = spark.createDataFrame([("x/a.pdf",), ("B.pdf",), ("c.pdf",), (None,)], "s string")
    assert {r.s: r.path for r in B.resolve_files(named, files, "s").collect()} == {"x/a.pdf": "/d/A.PDF", "B.pdf": "/d/b.md", "c.pdf": None, None: None}


def test_large_pages_are_dealt_into_blocks(spark):
    """a page with more rows than a task may hold gives the same pairs, once each; only large pages are copied."""
    rows = spark.range(400).select((F.col("id") % 5).alias("doc"), F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("page"), F.col("id").alias("n"))
    questions, images = rows.filter("n % 2 = 0").withColumnRenamed("n", "number"), rows.filter("n % 3 = 0").withColumnRenamed("n", "image")
    images = images.union(images.filter("image < 9"))
    numbered = spark.createDataFrame([(0,)], "doc long")
    want = sorted((i.doc, i.page, i.image, q.number) for i in images.collect() for q in questions.collect() if i.doc == q.doc != 0 and i.page == q.page)
    for most in (4096, 7):
        got = B.images_of_pages(questions, images, numbered, most=most)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_pairs_of_a_large_page_take_little_disk(spark, tmp_path):
    """all pairs of a page lie so that Parquet stores them in a small part of a byte each, and several tasks make them."""
    ids = spark.range(3002).select(F.lit(1).alias("doc"), F.lit(2).alias("page"), F.col("id"))
    got = B.images_of_pages(ids.filter("id % 2 = 0").withColumnRenamed("id", "number"), ids.filter("id % 2 = 1").withColumnRenamed("id", "image"), spark.createDataFrame([], "doc int"), most=200)
    got.write.parquet(path := f"{tmp_path}/pairs")
    back = spark.read.parquet(path)
    assert back.agg(F.count("*"), F.count_distinct("image", "number")).first() == (1501 * 1501,) * 2
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 0.25 * 1501 * 1501
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_odd_rows_of_large_pages(spark):
    """repeated and null images and numbers count as others, also beyond a block; pages without the other kind, or without a document, give nothing."""
    images = spark.createDataFrame([(1, 1, 5)] * 90 + [(1, 1, None)] * 3 + [(2, 1, n) for n in range(70)] + [(None, 1, 8)] * 30 + [(3, None, 8)] + [(0, 1, 8)] * 40 + [(4, 1, 9)], "doc int, page int, image long")
    questions = spark.createDataFrame([(1, 1, n % 8) for n in range(30)] + [(1, 1, None)] * 2 + [(None, 1, 8)] * 30 + [(3, None, 8)] + [(0, 1, 8)] * 40 + [(4, 1, 3), (5, 1, 1)], "doc int, page int, number long")
    numbered = spark.createDataFrame([(0,), (0,), (None,)], "doc int")
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(((i.doc, i.page, i.image, q.number) for i in images.collect() for q in questions.collect() if i.doc == q.doc and i.page == q.page and i.doc and i.page), key=key)
    for most, run in ((4096, 256), (7, 256), (7, 3)):
        assert sorted(map(tuple, B.images_of_pages(questions, images, numbered, most=most, run=run).collect()), key=key) == want
    assert B.images_of_pages(questions.limit(0), images, numbered).count() == 0
