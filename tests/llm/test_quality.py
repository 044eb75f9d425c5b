"""The quality discriminant: its algebra against numpy, odd input, held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lernwerk.llm import quality, registry

SF = "/root/testdata/sf0.01"
CLASH = ["_statistics", "statistics", "score", "label", "fold", "key", "_text", "at"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    words = [a + b for a in "ka lo mi nu".split() for b in "ba do fe gi".split()]
    texts = [None, "", " \n ", "x", "word " * 400_000, "z" * 3_000_000, "É ñ ß\ud800".encode("utf-8", "replace").decode(), "same text", "same text"]
    texts += [" ".join(rng.choice(words) for _ in range(60)) + "." for _ in range(40)] + [" ".join([rng.choice(words)] * 50) for _ in range(40)]
    rows = [(None if i == 3 else i, t, *[f"{c}{i}" for c in CLASH]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3).cache()


def test_statistics():
    at = dict(zip(quality.STATISTICS, quality.statistics("Ab ab ab, 12 é|"), strict=True))
    assert at["log_words"] == math.log(6) and at["capitals"] == math.log(1.5 / 5.5) and at["repeats_neighbour"] == math.log(0.5 / 4.5)
    assert at["beyond_ascii"] == math.log(2.5 / (16 - 2 + 0.5)) and at["distinct_words"] == math.log(5.5 / 0.5) and at["most_frequent"] == math.log(1.5 / 4.5)
    assert all(len(quality.statistics(t)) == quality.DIM and np.isfinite(quality.statistics(t)).all() for t in ("", " ", "\n\n", "x", "a" * 10**6))


def test_densities_equal_plain_algebra():
    rng = np.random.default_rng(3)
    x, y, fold = rng.normal(0, 1, (500, quality.DIM)) * 3 + 1, np.arange(500) % 4 // 3, np.arange(500) % quality.FOLDS
    of = {(k, f): (float(((y == k) & (fold == f)).sum()), x[(y == k) & (fold == f)].sum(0), x[(y == k) & (fold == f)].T @ x[(y == k) & (fold == f)]) for k in (0, 1) for f in range(quality.FOLDS)}
    for without in (None, 2):
        model, used = quality.densities(of, 1.0, without), fold != without
        xs, ys = x[used], y[used]
        z = (xs - xs.mean(0)) / (xs.std(0) + 1e-3)
        own = [np.cov(z[ys == k].T, bias=True) for k in (0, 1)]
        n = [int((ys == k).sum()) for k in (0, 1)]
        pooled = sum(a * b for a, b in zip(own, n, strict=True)) / sum(n)
        g = quality.DIM / (quality.DIM + sum(n))
        pooled = (1 - g) * pooled + (g * np.trace(pooled) / quality.DIM + 1e-6) * np.eye(quality.DIM)
        want = []
        for k in (0, 1):
            share = quality.DIM / (quality.DIM + n[k])
            c, d = (1 - share) * own[k] + share * pooled, z - z[ys == k].mean(0)
            want.append(math.log((n[k] + 0.5) / (sum(n) + 1)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
        assert np.allclose(model.difference(xs), np.arcsinh(want[1] - want[0]), atol=1e-6)


def test_best_cut_and_curve():
    counts = np.zeros((2, quality.BINS))
    counts[0, 1000:1100], counts[1, 3000:3100] = 3, 5
    assert abs(quality.best_cut(counts) - (2050 * 2 * quality.WIDEST / quality.BINS - quality.WIDEST)) < 0.02
    slope, shift, loss = quality.logistic(counts)
    assert slope > 0 and loss < 0.1 and abs(shift) < 10


def test_odd_input(spark, odd):
    labels = spark.createDataFrame([(i, int(i < 49), 0) for i in range(9, 89)] + [(None, 1, 0), (9, None, 0), (10, 1, 0), (1, 7, 0)], "doc_id long, quality int, extra int")
    model = quality.train_from(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and set(got[0].asDict()) == {"doc_id", "text", *CLASH}
    by = {r.doc_id: r.score for r in got}
    assert all(0 <= s <= 1 for s in by.values()) and by[7] == by[8] and by[0] == by[1]
    assert np.mean([by[i] >= 0.3 for i in range(9, 49)]) > 0.9 and np.mean([by[i] < 0.3 for i in range(49, 89)]) > 0.9
    assert quality.score(odd.limit(0), model).count() == 0
    for some in (labels.limit(0), labels.filter("quality = 1")):
        one = quality.train_from(odd, some)
        assert len({r.score for r in quality.score(odd, one, keep=["doc_id"]).collect()}) == 1


def test_held_out_accuracy(spark):
    got = registry.op11_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert got and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    right = [np.mean([r.predicted == k for r in got if r.quality == k]) for k in (0, 1)]
    assert min(right) >= 0.9
    assert registry.op11_quality(spark, SF).agg(F.count("*"), F.countDistinct("doc_id")).first()[:] == (1000, 1000)
