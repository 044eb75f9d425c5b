"""Code within texts: which lines are C or assembly, and the text with fences around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import text as T

# Fixed value: what a line of C that opens a block begins with.
C_START = r"(?U)^(?:int|float|void|unsigned|char|double|long|short|typedef|struct|#include|#define|static|extern|size_t|bool|auto|const|register|volatile)\b"
# Fixed value: what goes on with a block of C that is never closed.
C_MORE = r"(?U)[{};]|^(?://|/\*|\*)|^\w"


# what is known of a line, as bits
ASM, START, OPENS, MORE, BLANK = 1, 2, 4, 8, 16
OUTSIDE, WITHIN, UNCLOSED = 0, 1, 2
LANGS = np.array([None, "c", "x86asm"], dtype=object)
#: Lines of a text that become rows at once.
SLICE = 100_000


def line_facts(text: Column) -> Column:
    """``text``, and for each of its lines what is known of it by patterns (``bits``) and by how much braces open or close (``braces``)."""
    flag = lambda bit, holds: F.when(holds, bit).otherwise(0)

    def bits(line: Column) -> Column:
        return T.once(T.strip(line), lambda bare: known(line, bare))

    def known(line: Column, bare: Column) -> Column:
        return flag(ASM, F.regexp_like(bare, F.lit(C.ASM_LINE))) + flag(START, F.regexp_like(bare, F.lit(C_START))) + flag(OPENS, F.contains(line, F.lit("{"))) + flag(MORE, F.regexp_like(bare, F.lit(C_MORE))) + flag(BLANK, bare == "")

    braces = lambda x: F.regexp_count(x, F.lit(r"\{")) - F.regexp_count(x, F.lit(r"\}"))
    facts = lambda t, lines: F.struct(t.alias("text"), F.transform(lines, bits).alias("bits"), F.transform(lines, braces).alias("braces"))
    return T.once(text, lambda t: T.once(F.split(t, "\n", -1), lambda lines: facts(t, lines)))


def region_langs(bits: np.ndarray, braces: np.ndarray) -> np.ndarray:
    """For each line 0 (no code), 1 (C) or 2 (assembly), in time that grows with the number of lines."""
    has = lambda bit: (bits & bit) > 0
    before = lambda x: np.append(False, x[:-1])
    after = lambda x: np.append(x[1:], False)
    asm = has(ASM)
    asm |= has(BLANK) & before(asm) & after(asm)
    asm &= before(asm) | after(asm)
    total = np.cumsum(braces)
    later = np.append(np.minimum.accumulate(total[::-1])[::-1][1:], np.iinfo(np.int64).max)
    closes = later <= total - braces
    one_line = has(OPENS) & (braces <= 0)
    c, mode, depth = np.zeros(len(bits), bool), OUTSIDE, 0
    for i, (start, more, whole, closed, d) in enumerate(zip(has(START).tolist(), has(MORE).tolist(), one_line.tolist(), closes.tolist(), braces.tolist(), strict=True)):
        if mode == WITHIN:
            c[i], depth = True, depth + d
            mode = WITHIN if depth > 0 else OUTSIDE
        elif mode == UNCLOSED and more:
            c[i] = True
        else:
            c[i], mode = start, OUTSIDE
            if start and not whole:
                mode, depth = (WITHIN if closed else UNCLOSED), d
    own = np.where(c, 1, np.where(asm, 2, 0))
    begins = np.flatnonzero((own > 0) & (np.append(0, own[:-1]) == 0))  # regions that touch are one, in the language of the first
    at = np.searchsorted(begins, np.arange(len(own)), side="right") - 1
    return np.where(own > 0, own[begins[at]] if len(begins) else 0, 0)


def langs_of(fact: dict) -> np.ndarray:
    return region_langs(np.array(fact["bits"], np.int64), np.array(fact["braces"], np.int64))


def marked(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """A row for each line: the key, line_no (from 0), line, and lang (``c``, ``x86asm``, null: no code).

    C begins at a line that looks like a declaration and lasts until its braces are closed; a block that never closes lasts
    while lines look like code. Two or more instructions in sequence, single blank lines between them allowed, are assembly.
    Regions that touch count as one, in the language of the first. Texts that are null have no lines. A text is worked out where it is read, in one pass over its lines.
    """
    known = texts.select(*key, F.when(F.col(text).isNotNull(), line_facts(F.col(text))).alias("_f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, fact in enumerate(batch["_f"]):
                if not fact.is_valid:
                    continue
                fact = fact.as_py()
                lines, langs = fact["text"].split("\n"), LANGS[langs_of(fact)]
                for a in range(0, len(lines), SLICE):
                    n = len(lines[a : a + SLICE])
                    own = batch.select(key).take(pa.array(np.full(n, i)))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(range(a, a + n), pa.int32()), pa.array(lines[a : a + n], pa.string()), pa.array(langs[a : a + n].tolist(), pa.string())], names=[*key, "line_no", "line", "lang"])

    fields = [f"`{c}` {known.schema[c].dataType.simpleString()}" for c in key]
    return known.mapInArrow(run, ", ".join([*fields, "line_no int, line string, lang string"]))


def fenced(lines: list[str], langs: list[str | None]) -> str:
    """The text with fences around code, and two blanks at the line ends outside."""
    out = []
    for i, (line, lang) in enumerate(zip(lines, langs, strict=True)):
        before, after = langs[i - 1] if i else None, langs[i + 1] if i + 1 < len(langs) else None
        if lang:
            out.append("\n" if before else f"```{lang}\n")
            out.append(line if after else f"{line}\n```\n")
        else:
            out.append(line if not i or before else f"  \n{line}")
    return "".join(out)


def clean_fields(rows: DataFrame, fields: list[str], patterns: list[str] | None = None) -> DataFrame:
    """Rows with the whole chain of cleaning over each of the fields; nulls and empty texts stay as they are.

    Breaks, private-use repair, rules, footers and spacing come first, then code is located, so that fences stand where the code is. Rows are worked out where they are read: nothing is shuffled.
    """
    simple = {f: C.part_spacing(C.footer_lines(T.drop_rules(T.once(T.breaks(f), lambda x: T.pua_repair(x))), patterns)) for f in fields}
    known = rows.select(*(F.when(F.col(c).isNotNull(), line_facts(F.when(F.col(c) == "", "").otherwise(simple[c]))).alias(c) if c in fields else F.col(c) for c in rows.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for name in batch.schema.names:
                if name not in fields:
                    columns.append(batch[name])
                    continue
                texts = [None if f is None or f["text"] is None else f["text"] and fenced(f["text"].split("\n"), LANGS[langs_of(f)].tolist()) for f in batch[name].to_pylist()]
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    kinds = ", ".join(f"`{c}` {'string' if c in fields else rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return known.mapInArrow(run, kinds).select(*(C.mark_inline_asm(c).alias(c) if c in fields else F.col(c) for c in rows.columns))
