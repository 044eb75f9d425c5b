"""Fingerprints in pages against plain containment; what is emitted for a page."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lernwerk.operators import fingerprints as FP

rng = random.Random(7)
WORDS = ["ab", "cde", "fghi", "äö", "数据", "xy", "z", "\U0001f600k"]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def plain(text):
    return re.sub(r"\s+", "", re.sub("[-]", "", text or ""))


PAGES = [(f"s{i % 3}" if i % 7 else None, i, prose(rng.randint(0, 120))) for i in range(60)] + [("s0", 100, None), ("s1", 101, ""), ("s0", 102, prose(30_000)), ("s0", 103, PAGES_TEXT := prose(50)), ("s0", 104, PAGES_TEXT)]
QUESTIONS = (
    [(i, s, t[a : a + n]) for i, (s, _, t) in enumerate(PAGES) if t for a, n in [(rng.randrange(len(t)), rng.choice([8, 20, 60, 300]))]]
    + [(200 + i, rng.choice(["s0", "s1", None, "nowhere"]), prose(rng.choice([1, 3, 5, 30]))) for i in range(40)]
    + [(300, "s0", None), (301, "s0", "ab"), (302, None, PAGES[62][2][50_000:50_100]), (303, "s0", PAGES_TEXT), (304, "s0", PAGES_TEXT)]
)


@pytest.mark.parametrize("most", [10**6, 20])
def test_pages_equal_plain_containment(spark, monkeypatch, most):
    monkeypatch.setattr(FP, "PIECE", 5000)
    questions = spark.createDataFrame(QUESTIONS, "id long, source string, question_text string").repartition(3)
    pages = spark.createDataFrame(PAGES, "source string, page_no int, text string").repartition(3)
    want = set()
    for i, s, q in QUESTIONS:
        fp = plain(q)[:40]
        want |= {(i, ps, n) for ps, n, t in PAGES if len(fp) >= 5 and (s is None or s == ps) and fp in plain(t)}
    got = FP.fingerprint_pages(questions, pages, first_only=False, most=most).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
    first = {}
    for i, s, n in want:
        first[i] = min(first.get(i, (s, n)), (s, n), key=lambda x: (x[0] or "", x[1]))
    assert {r.id: (r.source, r.page_no) for r in FP.fingerprint_pages(questions, pages, most=most).collect()} == first
    assert FP.fingerprint_pages(questions.limit(0), pages).count() == 0 and FP.fingerprint_pages(questions, pages.limit(0)).count() == 0


def test_windows_and_few_rows(spark):
    c = FP.normal(prose(300)).astype(np.uint64)
    for width in (1, 5, 7, 32, 39, 40):
        assert (FP.windows(c, width) == FP.windows(c, width, np.arange(len(c) - width + 1))).all()
    pages = spark.createDataFrame([("s", i, "".join(rng.choice("abcdefghij") for _ in range(5000))) for i in range(20)], "source string, page_no int, text string")
    questions = spark.createDataFrame([(i, "s", "".join(rng.choice("abcdefghij") for _ in range(n))) for i, n in enumerate([40, 60, 12, 25] * 200)], "id long, source string, question_text string")
    keys = FP.keyed(questions, 5, 40)
    long = FP.filter_of(keys.filter("size = 40").select("key"), 400)
    short = FP.filter_of(keys.filter("size < 40").select(F.col("start").alias("key")), 400), FP.filter_of(keys.filter("size < 40").select("key"), 400), [12, 25]
    assert FP.found_windows(pages, long, short, False, 5, 40).count() < 0.02 * 20 * 5000
