"""Quality: a regularised quadratic discriminant over transformed statistics of a document.

Every text gives some counts (bytes by kind, words, distinct words, words that repeat the one before, pairs of words, lines, lengths), which become logarithms and log odds. Each class is a
normal density; its covariance is drawn to the pooled one, and that to its diagonal, the more the fewer labels there are. Sums of products are what is learned from, so all
labelled rows teach and none is collected. Five folds by a hash of the key choose the strength of shrinkage, and the slope and shift that make log-density differences into scores; the cut of best balanced accuracy,
drawn to the threshold where few labels show it, becomes ``threshold``. Scores come from Mahalanobis distances by the inverse Cholesky factors, made once.

Defined cases: a null or empty text has counts of 0 and is scored like any other; whole texts are read, whatever their length. Equal texts have equal scores. Columns besides the text pass through; one
named like the result is replaced. Labels other than 0 and 1, null labels and null keys teach nothing; repeated keys teach a row for each pair. Labels of one kind only, or none: the score is the share of label 1. An empty
table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, settle, with_text

FOLDS = 5
#: Strengths of shrinkage to choose from: pseudo-rows for each statistic.
STRENGTHS = (0.3, 1.0, 3.0, 10.0, 30.0)
#: Log-density differences are told apart by their inverse hyperbolic sine in so many steps.
BINS, WIDEST = 4096, 12.0
#: Labels of the rarer class at which half of a shift of the cut is believed.
FEW = 20
#: Kinds of bytes: capitals, small letters, digits, blanks, ends of sentences and commas, other ASCII signs; what is left is not ASCII.
KIND = np.full(256, 6, np.int64)
KIND[32:127] = 5
KIND[[ord(c) for c in ".,;:?'"]] = 4
KIND[[9, 10, 11, 12, 13, 32]] = 3
KIND[48:58], KIND[97:123], KIND[65:91] = 2, 1, 0
STATISTICS = (
    "log_bytes log_words word_length word_length_spread capitals digits blanks stops signs beyond_ascii distinct_words repeats_neighbour distinct_pairs most_frequent lines distinct_lines stops_a_word squeezed".split()
)


def odds(part: float, of: float) -> float:
    """Log odds of a share, drawn to one half where there is little of it."""
    return math.log((part + 0.5) / (of - part + 0.5))


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(KIND, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 7)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n, letters = len(words), kinds[0] + kinds[1]
    frequency: dict[str, int] = {}
    for w in words:
        frequency[w] = frequency.get(w, 0) + 1
    mean = float(lengths.mean()) if n else 0.0
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(len(raw)),
        math.log1p(n),
        math.log1p(mean),
        math.log1p(float(lengths.std()) if n else 0.0),
        odds(kinds[0], letters),
        odds(kinds[2], len(raw)),
        odds(kinds[3], len(raw)),
        odds(kinds[4], len(raw)),
        odds(kinds[5], len(raw)),
        odds(kinds[6], len(raw)),
        odds(len(frequency), n),
        odds(sum(map(eq, words, words[1:])), max(0, n - 1)),
        odds(pairs, max(0, n - 1)),
        odds(max(frequency.values(), default=0), n),
        math.log1p(len(lines)),
        odds(len(set(lines)), len(lines)),
        math.log((kinds[4] + 0.5) / (n + 1)),
        math.log((len(zlib.compress(raw, 1)) + 1) / (len(raw) + 16)),
    ]


DIM = len(STATISTICS)
HALF = [(i, j) for i in range(DIM) for j in range(i + 1)]


@dataclass
class Density:
    """A normal density of standardised statistics: its mean, the inverse of its Cholesky factor, and the log of its weight."""

    mean: np.ndarray
    whiten: np.ndarray
    weight: float

    def log(self, x: np.ndarray) -> np.ndarray:
        return self.weight - 0.5 * (((x - self.mean) @ self.whiten.T) ** 2).sum(1)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[Density, Density] | None  # none: labels of one kind
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """The squashed difference of the log densities of classes 1 and 0."""
        if self.classes is None:
            return np.zeros(len(x))
        z = (x - self.centre) / self.scale
        return np.arcsinh(self.classes[1].log(z) - self.classes[0].log(z))

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.difference(x) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def with_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "statistics") -> DataFrame:
    """The columns ``keep`` (all but a former one of this name) and the statistics of each whole text."""
    names = [c for c in (keep if keep is not None else df.columns) if c != name]
    kept, body = with_text(df, names, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in cut(batches, body):
            found = [statistics(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], pa.array(found, pa.list_(pa.float64()))], names=[*names, name])

    fields = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names]
    return kept.mapInArrow(run, ", ".join([*fields, f"`{name}` array<double>"]))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)


def moments(labelled: DataFrame) -> dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]:
    """For each label and fold: rows, sums, sums of products. Tasks give theirs, Spark adds them up; what comes here has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FOLDS, 1 + DIM + len(HALF)))
        rows, columns = np.array(HALF).T
        for batch in batches:
            x, label, fold = matrix(batch["statistics"]), batch["label"].to_numpy(), batch["fold"].to_numpy()
            for k in (0, 1):
                for f in range(FOLDS):
                    some = x[(label == k) & (fold == f)]
                    total[k, f] += np.concatenate([[len(some)], some.sum(0), (some.T @ some)[rows, columns]])
        k, f, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(f, pa.int32()), pa.array(at, pa.int32()), pa.array(total[k, f, at])], names=["label", "fold", "at", "value"])

    total = np.zeros((2, FOLDS, 1 + DIM + len(HALF)))
    for r in labelled.mapInArrow(run, "label int, fold int, at int, value double").groupBy("label", "fold", "at").agg(F.sum("value").alias("value")).collect():
        total[r.label, r.fold, r.at] = r.value
    out = {}
    for k in (0, 1):
        for f in range(FOLDS):
            products = np.zeros((DIM, DIM))
            for (i, j), v in zip(HALF, total[k, f, 1 + DIM :], strict=True):
                products[i, j] = products[j, i] = v
            out[k, f] = total[k, f, 0], total[k, f, 1 : 1 + DIM], products
    return out


def densities(of: dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]], strength: float, without: int | None = None) -> Model:
    """The discriminant of all folds but one; ``strength`` pseudo-rows for each statistic draw class covariances to the pooled one and that to its mean variance."""
    n, sums, products = [], [], []
    for k in (0, 1):
        parts = [of[k, f] for f in range(FOLDS) if f != without]
        n.append(sum(p[0] for p in parts)), sums.append(sum(p[1] for p in parts)), products.append(sum(p[2] for p in parts))
    rows = max(1.0, sum(n))
    centre = (sums[0] + sums[1]) / rows
    scale = np.sqrt(np.maximum(0, np.diag(products[0] + products[1]) / rows - centre**2)) + 1e-3
    means = [s / m if m else centre for s, m in zip(sums, n, strict=True)]
    own = [(p - m * np.outer(mean, mean)) / np.outer(scale, scale) for p, m, mean in zip(products, n, means, strict=True)]
    drawn = strength * DIM
    pooled, to_mean = (own[0] + own[1]) / rows, drawn / (drawn + rows)
    pooled = (1 - to_mean) * pooled + (to_mean * np.trace(pooled) / DIM + 1e-6) * np.eye(DIM)
    found = []
    for k in (0, 1):
        share = drawn / (drawn + n[k])
        factor = np.linalg.cholesky((1 - share) * own[k] / max(1.0, n[k]) + share * pooled)
        found.append(Density((means[k] - centre) / scale, np.linalg.inv(factor), math.log((n[k] + 0.5) / (rows + 1)) - float(np.log(np.diag(factor)).sum())))
    return Model(centre, scale, (found[0], found[1]))


def held_back(labelled: DataFrame, models: list[list[Model]]) -> np.ndarray:
    """Counts of squashed differences by strength, label and bin, each row judged by the models that did not learn from its fold."""
    shared = labelled.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(shared.value), 2, BINS), np.int64)
        for batch in batches:
            x, label, fold = matrix(batch["statistics"]), batch["label"].to_numpy(), batch["fold"].to_numpy()
            for s, of in enumerate(shared.value):
                for f, model in enumerate(of):
                    some = fold == f
                    at = np.clip((model.difference(x[some]) + WIDEST) * (BINS / 2 / WIDEST), 0, BINS - 1).astype(np.int64)
                    np.add.at(total[s], (label[some], at), 1)
        s, k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(total[s, k, at])], names=["strength", "label", "at", "n"])

    total = np.zeros((len(models), 2, BINS))
    for r in labelled.mapInArrow(run, "strength int, label int, at int, n long").groupBy("strength", "label", "at").agg(F.sum("n").alias("n")).collect():
        total[r.strength, r.label, r["at"]] = r.n
    return total


MIDDLES = (np.arange(BINS) + 0.5) * (2 * WIDEST / BINS) - WIDEST


def logistic(counts: np.ndarray) -> tuple[float, float, float]:
    """Slope, shift and mean log loss of the logistic curve through counts by label and bin; a prior of one row draws to slope 1 and shift 0."""
    w = np.array([1.0, 0.0])
    x = np.stack([MIDDLES, np.ones(BINS)], 1)
    n = counts.sum(0)
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.eye(2), x.T @ (counts[1] - n * p) - (w - [1.0, 0.0]))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(sigmoid(x @ w), 1e-12, 1 - 1e-12)
    return float(max(w[0], 1e-3)), float(w[1]), float(-(counts[1] * np.log(p) + counts[0] * np.log(1 - p)).sum() / max(1, n.sum()))


def best_cut(counts: np.ndarray) -> float:
    """The difference of best balanced accuracy: the middle of the places that share it around the first."""
    low, high = counts[0] / counts[0].sum(), counts[1] / counts[1].sum()
    right = np.concatenate([[0], np.cumsum(low)]) + np.concatenate([[1], 1 - np.cumsum(high)])  # cut before each bin
    top = np.flatnonzero(right >= right.max() - 1e-12)
    run = top[: np.flatnonzero(np.diff(top, append=BINS + 9) > 1)[0] + 1]
    return float((run[0] + run[-1]) / 2 * (2 * WIDEST / BINS) - WIDEST)


def learn(with_stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", name: str = "statistics", threshold: float = 0.3) -> Model:
    """Fit on the statistics of all rows that have a label; scores at the best cut come near ``threshold``."""
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    told = with_stats.select(F.col(key).alias("key"), F.col(name).alias("statistics")).join(marks.hint("merge"), "key")
    labelled = settle(told.select("label", F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int").alias("fold"), "statistics"), "labelled")
    of = moments(labelled)
    n = [sum(of[k, f][0] for f in range(FOLDS)) for k in (0, 1)]
    if not min(n):
        return Model(np.zeros(DIM), np.ones(DIM), None, 1.0, math.log((n[1] + 0.5) / (n[0] + 0.5)))
    counts = held_back(labelled, [[densities(of, s, f) for f in range(FOLDS)] for s in STRENGTHS])
    curves = [logistic(c) for c in counts]
    best = min(range(len(STRENGTHS)), key=lambda s: (curves[s][2], s))
    model = densities(of, STRENGTHS[best])
    slope, shift, _ = curves[best]
    logit = math.log(threshold / (1 - threshold))
    at = (logit - shift) / slope
    at += (best_cut(counts[best]) - at) * min(n) / (min(n) + FEW)
    model.slope, model.shift = slope, logit - slope * at
    return model


def score_statistics(with_stats: DataFrame, model: Model, statistics_name: str = "statistics", name: str = "score") -> DataFrame:
    """Add the score (0 to 1) of each row's statistics, which go."""
    names = [c for c in with_stats.columns if c not in (statistics_name, name)]
    shared = with_stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.score(matrix(batch.columns[-1])), pa.float64())], names=[*names, name])

    fields = [f"`{c}` {with_stats.schema[c].dataType.simpleString()}" for c in names]
    return with_stats.select(*names, statistics_name).mapInArrow(run, ", ".join([*fields, f"`{name}` double"]))


def train_from(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", threshold: float = 0.3) -> Model:
    """Fit on the whole texts of all labelled rows."""
    return learn(with_statistics(docs, text, [key]), labels, key, label, threshold=threshold)


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Add the score of each whole text. keep: the columns that pass through."""
    own = fresh(df, "statistics")
    names = [c for c in (keep if keep is not None else df.columns) if c != name]
    return score_statistics(with_statistics(df, text, names, own), model, own, name)
