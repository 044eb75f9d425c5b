"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from sample texts. A text goes to the
language whose dictionary makes it smallest: whole texts, in chunks, whose sizes add up. The score is
a logistic function of the margin between the best two, in units fitted on texts kept back; where it is
under ``least``, the row is marked ``narrow`` (a caller may treat it as unknown).

Defined cases: null text or text without any letter: ``und``, score 0, narrow. Ties go to the
language more frequent in the sample, then to the name first in order. No language learned: always ``und``.
Columns besides the text pass through; ones named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, with_text

CHUNK = 4096
OTHER = regex.compile(r"[^\p{L}]+")


def plain(text: str) -> str:
    """Lower-case letters with single spaces; a word that repeats its neighbour is dropped, as junk runs tell nothing."""
    words = OTHER.sub(" ", text).lower().split()
    return " ".join(w for w, last in zip(words, ["", *words], strict=False) if w != last)


@dataclass
class Model:
    dictionaries: dict[str, bytes]  # by falling frequency in the sample
    scale: float = 0.02
    least: float = 0.6
    level: int = 3

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        out = []
        for lang, raw in self.dictionaries.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            out.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return out


def chunks(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "replace")
    return [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)] or [b""]


def sizes(text: str, compressors: list) -> list[int]:
    parts = chunks(text)
    return [sum(len(c.compress(p)) for p in parts) for _, c in compressors]


def classify(text: str | None, compressors: list, scale: float) -> tuple[str, float]:
    text = plain(text or "")
    if not text or not compressors:
        return "und", 0.0
    text = f" {text} "
    size = sizes(text, compressors)
    order = sorted(range(len(size)), key=lambda i: (size[i], i))
    if len(order) == 1:
        return compressors[0][0], 1.0
    margin = (size[order[1]] - size[order[0]]) / max(1, size[order[1]])
    return compressors[order[0]][0], 1 / (1 + math.exp(-min(30.0, margin / scale)))


def pieces_of_text(raw: bytes, most: int, size: int = 512) -> bytes:
    """At most ``most`` bytes of a text: all of it, or pieces at even distances over its whole length."""
    if len(raw) <= most:
        return raw
    n = max(1, most // size)
    return b" ".join(raw[(len(raw) - size) * i // max(1, n - 1) :][: size - 1] for i in range(n))


def fit(texts: list[str], langs: list[str], most_bytes: int = 1 << 17, most_held: int = 500) -> Model:
    """A dictionary of up to ``most_bytes`` from the texts of each language: four fifths of the sample; of the rest, up to ``most_held`` texts set the unit of the margin.

    Every text gives at most ``most_bytes`` / 32, from all over it, so that no single one fills a dictionary. Texts are taken in turn while they fit, and none is cut to fit.
    """
    parts: dict[str, list[bytes]] = {}
    room: dict[str, int] = {}
    count: dict[str, int] = {}
    held = []
    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        count[lang] = count.get(lang, 0) + 1
        if i % 5 == 4 and len(held) < most_held:
            held.append((text, lang))
        if i % 5 < 4 or lang not in parts:
            part = pieces_of_text(plain(text).encode("utf-8", "replace"), most_bytes // 32)
            if len(part) < room.setdefault(lang, most_bytes):
                parts.setdefault(lang, []).append(part)
                room[lang] -= len(part) + 1
    order = sorted(parts, key=lambda x: (-count[x], x))
    model = Model({lang: b" ".join(parts[lang]) for lang in order})
    made = model.compressors()
    margins = []
    for text, lang in held:
        found, p = classify(text, made, model.scale)
        if found == lang and 0.5 < p < 1:
            margins.append(model.scale * math.log(p / (1 - p)))
    if margins:
        model.scale = max(1e-4, sorted(margins)[len(margins) // 2] / 4)
    return model


def fit_from(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 400, most: int = 1 << 14) -> Model:
    """Fit on about ``per_lang`` texts a language, picked by a hash of the key; null languages and texts are left out.

    Longer texts give ``most`` bytes, from all over them. So the sample has ``per_lang`` times ``most`` bytes for each language at most; the languages are counted over all rows.
    """
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(key).alias("k")).filter(F.col("t").isNotNull() & F.col("l").isNotNull())
    n = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("k"), F.lit(1_000_000))
    share = F.lit(0)
    for name, count in sorted(n.items()):
        share = F.when(F.col("l") == name, F.lit(min(1_000_000, math.ceil(1_000_000 * per_lang / count)))).otherwise(share)
    drawn = rows.filter(draw < share) if n else rows.limit(0)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [t if len(t) <= most // 4 else pieces_of_text(t.encode("utf-8", "replace"), most).decode("utf-8", "ignore") for t in batch["t"].to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("t"), "t", pa.array(short, pa.string()))

    got = drawn.mapInArrow(shorten, drawn.schema).toPandas()
    got = got.assign(h=[xxh3_64_intdigest(str(k)) for k in got["k"]]).sort_values(["h", "k", "t"])
    return fit(got["t"].tolist(), got["l"].tolist())


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``narrow`` for each whole text."""
    names = [c for c in (keep if keep is not None else df.columns) if c not in ("lang_pred", "score", "narrow")]
    kept, body = with_text(df, names, text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        made = model.compressors()
        for rows, texts in cut(batches, body):
            found = [classify(x, made, model.scale) for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[: len(names)], pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64()), pa.array([p < model.least for _, p in found], pa.bool_())],
                names=[*names, "lang_pred", "score", "narrow"],
            )

    fields = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names]
    return kept.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "narrow boolean"]))
