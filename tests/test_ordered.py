"""Sums, last values and page lookups along ranges against plain loops."""

import random

from pyspark.sql import functions as F

from lernwerk.operators import banks as B
from lernwerk.operators import links as L
from lernwerk.operators import ordered as O


def pages(seed: int) -> list[tuple]:
    r = random.Random(seed)
    return [(doc, n, r.choice([None, r.randint(1, 9)])) for doc in ("a", "b", None) for n in r.sample(range(-20, 60), 25)]


def before(rows, row, f):
    return f([v for d, n, v in sorted((x for x in rows if x[0] == row[0]), key=lambda x: x[1]) if n < row[1]])


def test_sums_and_last_values_cross_ranges(spark):
    rows = pages(3)
    df = spark.createDataFrame(rows, "doc string, n int, v int")
    for width in (1, 7, 4096):
        summed = {(r.doc, r.n): r.s for r in O.sum_before(df, "doc", "n", "v", "s", width).collect()}
        last = {(r.doc, r.n): r.s for r in O.last_before(df, "doc", "n", "v", "s", width).collect()}
        assert len(summed) == len(last) == len(rows)
        for row in rows:
            assert summed[row[:2]] == before(rows, row, lambda vs: sum(v or 0 for v in vs))
            assert last[row[:2]] == before(rows, row, lambda vs: next((v for v in reversed(vs) if v is not None), None))


def test_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([], "doc string, n int, v int")
    assert O.sum_before(df, "doc", "n", "v", "s").count() == O.last_before(df, "doc", "n", "v", "s").count() == 0


def test_offsets_meet_their_page_in_any_stretch(spark):
    texts = [("a", 2, "x" * 5), ("a", 1, "y" * 40), ("a", 3, ""), ("b", 1, "z"), ("b", 2, None), (None, 1, "w")]
    asked = [("a", i) for i in range(-2, 60)] + [("a", 3), ("b", 0), ("b", 1), ("b", 2), (None, 0), ("a", None), ("c", 0)]
    spans = {"a": [(1, 0, 41), (2, 41, 47), (3, 47, 48)], "b": [(1, 0, 2)]}
    want = sorted((d, o, p) for d, o in asked if o is not None for p, s, e in spans.get(d, []) if s <= o < e)
    for width in (3, 16, 1 << 20):
        found = L.offset_pages(spark.createDataFrame(asked, "doc string, off long"), spark.createDataFrame(texts, "doc string, page_no int, text string"), width)
        assert sorted(map(tuple, found.collect())) == want


def test_what_hangs_on_removed_questions_goes(spark):
    ids = lambda xs, name: spark.createDataFrame([(x,) for x in xs], f"{name} long")
    parts = B.remove_cascade(ids([1, 2, 3], "id"), ids([2, 2, 9], "id"), {"assets": ids([1, 2, 2, 9, None], "question_id")})
    plain = lambda df: sorted((r[0] for r in df.collect()), key=str)
    assert {k: tuple(map(plain, v)) for k, v in parts.items()} == {"questions": ([1, 3], [2]), "assets": ([1, None], [2, 2, 9])}


def test_values_are_carried_along_a_composite_order(spark):
    r = random.Random(8)
    rows = [(d, p, y, r.choice([None, r.randint(1, 99)])) for d in ("a", "b", None) for p, y in r.sample([(p, y) for p in (None, *range(-9, 30)) for y in (None, *range(6))], 90)]
    df = spark.createDataFrame(rows, "doc string, page int, y int, v int")
    key = lambda x: tuple((v is not None, v or 0) for v in x[1:3])
    want = {}
    for row in rows:
        upto = [x[3] for x in sorted((x for x in rows if x[0] == row[0]), key=key) if key(x) <= key(row)]
        want[row[:3]] = (next((v for v in reversed(upto) if v is not None), None), sum(v or 0 for v in upto))
    for width in (1, 5, 4096):
        got = O.carried(df, "doc", ["page", "y"], {"last": F.col("v")}, {"total": F.col("v")}, width)
        assert got.columns == ["doc", "page", "y", "v", "last", "total"]
        assert {tuple(x)[:3]: tuple(x)[4:] for x in got.collect()} == want


def test_images_equal_a_plain_search(spark):
    r = random.Random(11)
    place = lambda n: [(r.choice("de"), r.randint(1, 9), float(r.randint(0, 9)), i) for i in range(n)]
    questions, images = place(40), place(40)
    for same in (False, True):
        want = {}
        for d, p, y, i in images:
            above = [(qp, qy, n) for qd, qp, qy, n in questions if qd == d and (qp, qy) <= (p, y) and (qp == p or not same)]
            want[i] = max(above)[2] if above else None
        found = L.nearest_above(spark.createDataFrame(questions, "doc string, page int, y double, number long"), spark.createDataFrame(images, "doc string, page int, y double, image long"), same, width=2)
        assert {x.image: x.number for x in found.collect()} == want
