"""Operators over small tables, and every registered query against its SQL twin."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

from lernwerk import catalog
from lernwerk.functions import text as T
from lernwerk.operators import attempts as A
from lernwerk.operators import links as L
from lernwerk.operators import questions as S
from lernwerk.plans import parsing as P
from lernwerk.sources import corpora as C

SF = "/root/testdata/sf0.001"


def values(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, bool, type(None))) else str(v)
    return sorted(repr([plain(r[i]) for i in at]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert values(df.collect(), df.columns) == values(found.fetchall(), columns)


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, T.pua_repair, "O\uf0ee \uf0ee") == "O()"
    assert one(spark, T.pua_repair, None) is None
    assert one(spark, T.pua_normalize, "\u3000a \ue000b\n") == "ab"
    assert one(spark, T.strip, "\u3000 a b \n") == "a b"
    assert one(spark, T.question_number, "12、abc") == 12 and one(spark, T.question_number, "abc") is None
    assert one(spark, T.exam_year, "【2023 统考真题】x") == "2023统考真题"
    assert one(spark, T.answer_ref, "（该节答案见书本P15）") == "答案见原书P15"
    assert one(spark, T.safe_relative_path, "a\\b/c.png") == "a/b/c.png"
    assert [one(spark, T.safe_relative_path, p) for p in ("/a", "C:\\a", "a/../b", "")] == [None] * 4
    assert one(spark, T.infer_subject, "x/Operating System/1.md") == "操作系统" and one(spark, T.infer_subject, "x") == T.UNKNOWN_SUBJECT
    assert one(spark, T.json_list, '["a", " b ", ""]') == ["a", "b"] and one(spark, T.json_list, "plain") == ["plain"] and one(spark, T.json_list, "[broken") == ["[broken"]
    assert one(spark, T.strip_details, "a<details>x\ny</details>b") == "ab"
    assert one(spark, T.breaks, "a<br/>b") == "a\nb"
    assert one(spark, lambda c: T.clamp_confidence(c, 0.5), "abc") == 0.5


def test_nearest_above(spark):
    q = spark.createDataFrame([("d", 1, 10.0, 1), ("d", 1, 50.0, 2)], "doc string, page int, y double, number long")
    i = spark.createDataFrame([("d", 1, 5.0, 1), ("d", 1, 10.0, 2), ("d", 1, 60.0, 3), ("d", 2, 1.0, 4)], "doc string, page int, y double, image long")
    assert {r.image: r.number for r in L.nearest_above(q, i).collect()} == {1: None, 2: 1, 3: 2, 4: 2}
    assert {r.image: r.number for r in L.nearest_above(q, i, same_page=True).collect()}[4] is None


def test_first_by_hash_keeps_rows_without_hash(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, text_hash string")
    assert sorted(r.id for r in S.first_by_hash(rows).collect()) == [1, 3, 4]
    assert sorted(r.id for r in S.dedup_against(rows, rows.limit(1)).collect()) == [3, 4]


def test_wrong_book_with_reviews(spark):
    """Literal rows: reviews before the first wrong attempt have nothing to review; the last of attempts and reviews, by time and id, gives the status."""
    g = [(1, 1, "2024-01-01", False), (2, 1, "2024-01-02", False), (3, 2, "2024-01-01", False), (4, 3, "2024-01-05", False), (5, 4, "2024-01-01", False), (6, 4, "2024-01-04", False), (7, 5, "2024-01-01", True), (8, 6, "2024-01-01", False), (30, 7, "2024-01-01", False)]
    r = [(11, 1, "2024-01-03", True), (12, 3, "2024-01-02", True), (13, 3, "2024-01-03", False), (14, 4, "2024-01-02", True), (15, 5, "2024-01-02", True), (16, 6, "2024-01-02", True), (17, 6, "2024-01-02", False), (29, 7, "2024-01-01", True), (31, 7, "2024-01-01", True)]
    graded = spark.createDataFrame(g, "id long, question_id long, create_time string, is_correct boolean").withColumns({"subject": F.lit("s"), "chapter": F.lit("c")})
    got = {x.question_id: (x.last_status, x.review_count, x.last_review_at, x.wrong_attempts) for x in A.wrong_book(graded, spark.createDataFrame(r, "id long, question_id long, create_time string, is_correct boolean")).collect()}
    assert got == {1: ("correct", 1, "2024-01-03", 2), 2: ("unreviewed", 0, None, 1), 3: ("unreviewed", 0, None, 1), 4: ("wrong", 1, "2024-01-02", 2), 6: ("wrong", 2, "2024-01-02", 1), 7: ("correct", 1, "2024-01-01", 1)}


def test_reviews_are_graded_by_the_built_in_answer_alone(spark):
    q = spark.createDataFrame([(1, "other", " b "), (2, "choice", ""), (3, "choice", None), (4, "choice", "A")], "id long, question_type string, answer string")
    a = spark.createDataFrame([(1, 1, "B"), (2, 2, ""), (3, 3, "A"), (4, 4, " a"), (5, 4, None), (6, 9, "A")], "id long, question_id long, user_answer string")
    assert {r.id: r.is_correct for r in A.grade_reviews(a, q).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_wrong_list_shows_the_newest_with_the_text_as_it_is(spark):
    book = spark.createDataFrame([(1, "s", "c", "2024-01-01"), (2, "s", "c", "2024-01-03"), (3, "s", None, "2024-01-03"), (4, "t", "c", "2024-01-02")], "question_id long, subject string, chapter string, added_at string").withColumn("last_status", F.lit("wrong"))
    q = spark.createDataFrame([(1, "x" * 81), (2, " two\n  lines "), (3, None), (4, "y" * 80)], "id long, question_text string")
    rows = [(r.question_id, r.preview, r.total, r.pages) for r in A.wrong_list(book, q, page_size=3).orderBy(F.desc("added_at"), "question_id").collect()]
    assert rows == [(2, " two\n  lines ", 4, 2), (3, "", 4, 2), (4, "y" * 80, 4, 2)]
    assert [r.preview for r in A.wrong_list(book, q, page=2, page_size=3).collect()] == ["x" * 80 + "..."]


def test_first_wrongs(spark):
    rows = spark.createDataFrame([(1, 1, "b", "t2", False), (2, 1, "a", "t1", False), (3, 1, "c", "t0", True), (4, 1, "d", "t1", False), (5, 2, "e", "t0", True)], "id long, question_id long, user_answer string, create_time string, is_correct boolean")
    assert [(r.question_id, r.id, r.user_answer, r.frequency) for r in A.first_wrongs(rows).collect()] == [(1, 2, "a", 3)]


def test_parse_markdown_file(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.md").write_text("intro\n## 1.1 Basics\n1. What?\nmore\nA. one\nB. two\n2、Next\n## 1.2 Later\n3. Last\n")
    (tmp_path / "b.txt").write_text("1. no")
    rows = P.parse(C.scan_markdown(spark, str(tmp_path))).orderBy("number").collect()
    assert [(r.number, r.section, r.question_text, r.option_a, r.option_c) for r in rows] == [(1, "1.1 Basics", "What?\nmore", "one", None), (2, "1.1 Basics", "Next", None, None), (3, "1.2 Later", "Last", None, None)]


def test_package_round_trip(spark, tmp_path):
    q = spark.createDataFrame([(1, "s", "h"), (2, "t", None)], "id long, subject string, text_hash string")
    assets = spark.createDataFrame([(1, "p.png"), (2, "q.png")], "question_id long, path string")
    C.write_package(q.withColumn("answer", F.lit("A")), assets, assets, str(tmp_path / "p"))
    assert C.read_package(spark, str(tmp_path / "p")).count() == 2
    kept = C.read_attached(spark, str(tmp_path / "p"), "question_assets")
    assert [(r.question_text_hash, r.path) for r in kept.collect()] == [("h", "p.png")]
    assert [(r.path, r.question_id) for r in L.relink_by_hash(kept, q).collect()] == [("p.png", 1)]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"banks": [{"id": "a", "name": "x"}, {"id": "b", "name": "y"}]}')
    m = C.scan_manifest(spark, str(tmp_path / "m.json"))
    new = spark.createDataFrame([("a", "z")], "id string, name string")
    assert {(r.id, r.name) for r in C.upsert(m, new).collect()} == {("a", "z"), ("b", "y")}


def test_entry_point_works(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
