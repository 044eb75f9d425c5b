"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of two rows of an embedding table, picked by two hashes, so that two words share both rows almost never, and of
rows for its pieces of ``GRAM`` bytes, so that a word not seen in training has the parts of those that were. Filters of one, two and three
words slide over the text; each filter keeps its maximum over the whole text, and a logistic layer reads these maxima.

Defined cases: a null or empty text has no words, so every maximum is 0 and the score is that of the
bias alone. Repeated rows get equal scores; a very long text is scored whole. Columns besides the text pass through, whatever their names; a
column of the same name as a result is replaced. Lower case; ASCII punctuation around a word is dropped. Training leaves out rows without text or label; texts
of any length teach, whole, while all fit into ``most_chars`` together; repeated keys in either table give a row for each pair. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, mix64, settle, split_words, with_text, word_hashes
from .tokens import spread

PUNCTUATION = ".,;:!?$%&*#|\"'()[]{}<>-_/\\"
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS)
GRAM = 4


@dataclass
class Model:
    table: np.ndarray  # (3 * buckets, dim): two rows of a word, then those of its pieces; the last row stays zero, for padding
    filters: dict[int, np.ndarray]  # width -> (width, dim, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    @property
    def buckets(self) -> int:
        return len(self.table) // 3


@dataclass
class Words:
    """The table rows of distinct words, one word's after the other's, with weights; the last word is the padding."""

    rows: np.ndarray
    weights: np.ndarray
    n: np.ndarray
    begin: np.ndarray

    def embed(self, table: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The embeddings of some of the words."""
        n = self.n[some]
        at = spread(self.begin[some], n)
        return np.add.reduceat(table[self.rows[at]] * self.weights[at, None], np.cumsum(n) - n, axis=0)


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pieces of each word, its ends marked, and how many there are."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()), np.uint8)
    whole = np.full(int(size.sum()) + 2 * len(size), 2, np.uint64)
    start = np.cumsum(size + 2) - size - 2
    whole[spread(start + 1, size)] = raw
    whole[start + size + 1] = 3
    n = np.maximum(size + 3 - GRAM, 0)
    at = spread(start, n)
    value = np.zeros(len(at), np.uint64)
    for i in range(GRAM):
        value = value * np.uint64(256) + whole[at + i]
    return mix64(value), n


def hashed(words: pa.Array, buckets: int, at_once: int = 1 << 15) -> Words:
    """Nothing but punctuation is padding. Some words are taken at once, so that what is needed on the way stays small."""
    rows, weights, sizes = [], [], []
    for a in range(0, len(words), at_once):
        bare = pc.utf8_trim(words.slice(a, at_once), characters=PUNCTUATION)
        h = word_hashes(bare)
        pieces, n = grams(bare)
        blank = pc.equal(bare, "").to_numpy(zero_copy_only=False)
        first, n = 2 * np.arange(len(h)) + np.cumsum(n) - n, n + 2
        own, weight = np.zeros(int(n.sum()), np.int32), np.ones(int(n.sum()), np.float32)
        own[first] = np.where(blank, 3 * buckets - 1, h % np.uint64(buckets))
        own[first + 1] = np.where(blank, 3 * buckets - 1, np.uint64(buckets) + (h >> np.uint64(32)) % np.uint64(buckets))
        at = spread(first + 2, n - 2)
        own[at] = np.uint64(2 * buckets) + pieces % np.uint64(buckets - 1)
        weight[at] = np.repeat(1 / np.sqrt(np.maximum(n - 2, 1)), n - 2)
        rows.append(own), weights.append(weight), sizes.append(n)
    n = np.concatenate([*sizes, [1]]).astype(np.int64)
    return Words(np.append(np.concatenate(rows), 3 * buckets - 1) if rows else np.array([3 * buckets - 1]), np.concatenate([*weights, [1]]).astype(np.float32), n, np.cumsum(n) - n)


def encoded(texts: Iterable[str], at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As ``split_words``, over texts that come one by one: only about ``at_once`` characters of them are held at a time, then 4 bytes a word."""
    codes, sizes, words = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], pa.array([], pa.string())
    held, n = [], 0
    for text in chain(texts, [None]):
        if held and (text is None or n + len(text) > at_once):
            own, offsets, found = split_words(pa.array(held, pa.string()))
            known = pc.index_in(found, value_set=words)
            new = found.filter(pc.is_null(known))
            place = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int32)
            place[place < 0] = len(words) + np.arange(len(new), dtype=np.int32)
            codes.append(place[own]), sizes.append(np.diff(offsets))
            words = pa.concat_arrays([words, new])
            held, n = [], 0
        if text is not None:
            held.append(text)
            n += len(text)
    return np.concatenate(codes), np.cumsum(np.concatenate(sizes)), words


def padded(codes: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes with PAD padding words after each text, so that no filter sees two texts; where each text starts."""
    n = np.diff(offsets)
    starts = offsets[:-1] + PAD * np.arange(len(n))
    out = np.full(len(codes) + PAD * len(n), pad, dtype=np.int64)
    out[np.arange(len(codes)) + PAD * np.repeat(np.arange(len(n)), n)] = codes
    return out, starts


def tables(model: Model, embedded: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(width, place in the filter, filters x words): what each filter adds up, by word. Filters are linear, so this is done once for each word."""
    each = [(w, j) for w in WIDTHS for j in range(w)]
    # few columns: not worth the threads that a matrix product would start on the driver
    all_of_them = np.einsum("df,nd->fn", np.concatenate([model.filters[w][j] for w, j in each], axis=1), embedded)
    return [(w, j, part) for (w, j), part in zip(each, np.split(all_of_them, len(each)), strict=True)]


def maxima(tabled: list[tuple[int, int, np.ndarray]], codes: np.ndarray, starts: np.ndarray, pad: int, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's maximum in each text, and with ``where`` the position of it."""
    total = sum(t.shape[0] for w, j, t in tabled if j == 0)
    best = np.empty((total, len(starts)), dtype=np.float32)
    at = np.empty((total, len(starts)), dtype=np.int64) if where else None
    at_pad = np.flatnonzero(codes == pad)
    place = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes)))) if where else None
    row = 0
    for w in WIDTHS:
        parts = [t for width, _, t in tabled if width == w]
        for f in range(parts[0].shape[0]):
            conv = parts[0][f][codes]
            for j in range(1, w):
                conv[: len(conv) - j] += parts[j][f][codes[j:]]
            conv[at_pad] = 0
            best[row] = np.maximum.reduceat(conv, starts)
            if where:
                hits = np.flatnonzero(conv == best[row][place])
                at[row][place[hits[::-1]]] = hits[::-1]
            row += 1
    return best, at


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    codes, offsets, words = split_words(texts)
    return score_codes(model, hashed(words, model.buckets), np.arange(len(words) + 1), codes, offsets)


def score_codes(model: Model, known: Words, used: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of texts as codes into ``used``, the words that come in them and then the padding."""
    pad = len(used) - 1
    codes, starts = padded(codes, offsets, pad)
    best, _ = maxima(tables(model, known.embed(model.table, used)), codes, starts, pad)
    return sigmoid(model.out @ np.maximum(best + model.bias[:, None], 0) + model.out_bias)


class Adam:
    """Adam steps on whole arrays, or on some rows of a table, whose other rows keep their moments."""

    def __init__(self, value: np.ndarray):
        self.value, self.first, self.second = value, np.zeros_like(value), np.zeros_like(value)

    def step(self, grad: np.ndarray, lr: float, n: int, rows: np.ndarray | slice = slice(None)) -> None:
        self.first[rows] += 0.1 * (grad - self.first[rows])
        self.second[rows] += 0.001 * (grad**2 - self.second[rows])
        self.value[rows] -= lr * (self.first[rows] / (1 - 0.9**n)) / (np.sqrt(self.second[rows] / (1 - 0.999**n)) + 1e-8)


def train(texts: Iterable[str], labels: np.ndarray, langs: list[str] | None = None, *, buckets: int = 1 << 14, dim: int = 12, filters: int = 8, steps: int = 1000, batch: int = 32, rate: float = 0.01, decay: float = 1e-2, seed: int = 7) -> Model:
    """Fit by Adam on weighted log loss; every fifth text is kept back to set the thresholds. Texts are read once, one after the other.

    The score of best F1, drawn to 0.5 where few texts have label 1, becomes 0.5 by a shift of the bias. Thresholds: for each language of the texts kept back with at least 10 texts of
    either label, its own score of best F1, drawn halfway to 0.5; 0.5 holds elsewhere. Labels of one kind only, or no texts: a model that scores by the share of label 1.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float32)
    model = Model(rng.normal(0, 0.1, (3 * buckets, dim)).astype(np.float32), {w: rng.normal(0, 0.5, (w, dim, filters)).astype(np.float32) for w in WIDTHS}, np.full(len(WIDTHS) * filters, -0.1, np.float32), rng.normal(0, 0.5, len(WIDTHS) * filters).astype(np.float32), 0.0)
    model.table[-1] = 0
    model.out[: len(model.out) // 2] = np.abs(model.out[: len(model.out) // 2])
    if not len(y) or y.min() == y.max():
        model.out[:] = 0
        model.out_bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return model
    codes, offsets, words = encoded(texts)
    known, n_words = hashed(words, buckets), len(words)
    del words

    def taken(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words of some texts and the padding, their texts as codes into these, and where each starts."""
        own = np.concatenate([codes[offsets[i] : offsets[i + 1]] for i in some])
        here = np.concatenate([[0], np.cumsum([offsets[i + 1] - offsets[i] for i in some])])
        used, own = np.unique(own, return_inverse=True)
        return np.append(used, n_words), own, here

    kept_back = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~kept_back)
    weight = np.where(y == 1, 0.5 / max(y[fit].mean(), 1e-6), 0.5 / max(1 - y[fit].mean(), 1e-6)).astype(np.float32) ** 0.7
    table, bias, out = Adam(model.table), Adam(model.bias), Adam(model.out)
    shaped = {w: Adam(model.filters[w]) for w in WIDTHS}
    step, epochs = 0, min(30, max(6, round(steps * batch / len(fit))))
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        shuffled = np.array_split(rng.permutation(fit), max(1, len(fit) // batch))
        for some in shuffled:
            step += 1
            used, own, here = taken(some)
            embedded = known.embed(model.table, used)
            pad = len(used) - 1
            own, starts = padded(own, here, pad)
            best, at = maxima(tables(model, embedded), own, starts, pad, where=True)
            z = best + model.bias[:, None]
            act = np.maximum(z, 0)
            p = sigmoid(model.out @ act + model.out_bias)
            err = ((p - y[some]) * weight[some] / len(some)).astype(np.float32)
            back = (model.out[:, None] * err) * (z > 0)
            grad_filter, pushed, on = {w: np.zeros_like(model.filters[w]) for w in WIDTHS}, [], []
            row = 0
            for w in WIDTHS:
                for f in range(filters):
                    live = (own[at[row]] != pad).astype(np.float32) * back[row]
                    for j in range(w):
                        word = own[np.minimum(at[row] + j, len(own) - 1)]
                        grad_filter[w][j, :, f] = (live[:, None] * embedded[word]).sum(0)
                        on.append(used[word])
                        pushed.append(live[:, None] * model.filters[w][j, :, f])
                    row += 1
            on, pushed = np.concatenate(on), np.concatenate(pushed)
            n = known.n[on]
            parts = spread(known.begin[on], n)
            hit, where = np.unique(known.rows[parts], return_inverse=True)
            grad = np.zeros((len(hit), dim), np.float32)
            np.add.at(grad, where, np.repeat(pushed, n, axis=0) * known.weights[parts, None])
            model.out_bias -= lr * float(err.sum())
            out.step(act @ err, lr, step), bias.step(back.sum(1), lr, step), table.step(grad, lr, step, hit)
            for w in WIDTHS:
                shaped[w].step(grad_filter[w], lr, step)
                model.filters[w] *= 1 - lr * decay
            model.table[-1] = 0
        model.table *= max(0.0, 1 - lr * decay * len(shuffled))
    back = np.flatnonzero(kept_back)
    if len(back) >= 20 and 0 < y[back].sum() < len(back):
        held = np.concatenate([score_codes(model, known, *taken(some)) for some in np.array_split(back, len(back) // 100 + 1)])
        positive = y[back].sum()  # few of them tell little about the cut
        cut = 0.5 + (best_cut(held, y[back]) - 0.5) * positive / (positive + 20)
        model.out_bias -= float(np.log(cut / (1 - cut)))
        held = sigmoid(np.log(np.maximum(held, 1e-12) / np.maximum(1 - held, 1e-12)) - np.log(cut / (1 - cut)))
        names = np.array([str(langs[i]) if langs else "" for i in back])
        for name in np.unique(names):
            of = names == name
            if min(y[back][of].sum(), (1 - y[back][of]).sum()) >= 10:
                model.thresholds[str(name)] = 0.5 * (best_cut(held[of], y[back][of]) + model.threshold)
    return model


def best_cut(score: np.ndarray, label: np.ndarray) -> float:
    """The score of best F1; of equals, the one nearest 0.5."""
    cuts = np.linspace(0.2, 0.9, 71)
    f1 = [2 * (label * (score >= c)).sum() / max(1, label.sum() + (score >= c).sum()) for c in cuts]
    top = max(f1)
    return float(min((abs(c - 0.5), c) for c, f in zip(cuts, f1, strict=True) if f >= top - 1e-9)[1])


def train_from(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", lang: str = "lang", key: str = "doc_id", most: int = 6000, most_chars: int = 60_000_000) -> Model:
    """Fit on at most ``most`` labelled rows, picked by a hash of their key, with at most ``most_chars`` characters together.

    Whole texts are taken in the order of the hash; one that does not fit into what is left is passed over. Rows without text or label are left out. Texts come to
    the driver compressed and are read there one after the other, so that it never holds them all as text.
    """
    hashed_key = F.xxhash64("_key")
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    sample = settle(marked.orderBy(hashed_key, "_key", "_label").limit(most), "sample")  # ``most`` rows: small enough to broadcast
    told = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    met = told.join(F.broadcast(sample), "_key").withColumn("_own", F.xxhash64("_text", "_label"))
    sizes = met.select("_key", "_own", F.length("_text").cast("long").alias("_chars")).orderBy(hashed_key, "_key", "_own").limit(most)
    taken, chars = [], 0
    for k, own, n in sizes.collect():
        if chars + n <= most_chars:
            taken.append((k, own))
            chars += n
    chosen = settle(docs.sparkSession.createDataFrame(taken, sizes.drop("_chars").schema).distinct(), "taken")
    packed = met.join(F.broadcast(chosen), ["_key", "_own"]).select("_key", "_text", "_label", "_lang")
    packed = packed.mapInArrow(compress, f"_key {packed.schema['_key'].dataType.simpleString()}, _text binary, _label int, _lang {packed.schema['_lang'].dataType.simpleString()}")
    rows = packed.orderBy(hashed_key, "_key", "_text", "_label").limit(len(taken)).toPandas()
    rows = rows.sort_values(["_key", "_text", "_label"], key=lambda c: c if c.name != "_key" else c.map(lambda k: xxh3_64_intdigest(str(k))))
    return train((zstandard.decompress(bytes(x)).decode() for x in rows["_text"]), rows["_label"].to_numpy(), rows["_lang"].tolist())


def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text column by zstandard."""
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        small = [zstandard.compress(x.as_py().encode()) for x in batch.column(at)]
        yield batch.set_column(at, "_text", pa.array(small, pa.binary()))


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Add a score (0 to 1) for each whole text. keep: the columns that pass through."""
    names = [c for c in (keep if keep is not None else df.columns) if c != name]
    kept, body = with_text(df, names, text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in cut(batches, body):
            s = score_texts(shared.value, texts)
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], pa.array(s, pa.float64())], names=[*names, name])

    fields = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names]
    return kept.mapInArrow(run, ", ".join([*fields, f"`{name}` double"]))


def rejected(model: Model, lang: str = "lang", name: str = "score") -> Column:
    """Whether the score reaches the threshold of the row's language."""
    cut = F.lit(model.threshold)
    for language, value in sorted(model.thresholds.items()):
        cut = F.when(F.col(lang) == language, F.lit(value)).otherwise(cut)
    return F.col(name) >= cut
