"""Token ids of whole texts with a public tokenizer file, cut into pieces of at most one sequence.

Only tokenizers whose pre-tokenizer never joins text across white space qualify, as
``word_bpe_49k.json``: then the ids of a text are those of its white-space runs in a row. A run is a word and the
punctuation behind it; each worker process encodes a distinct word once, for all its tasks, and remembers as many
as ``MOST_BYTES`` hold. Texts are put together from these by array look-ups.

Defined cases: a null or empty text is one piece, the end id alone; texts of any length are cut into pieces, none is shortened; null and
repeated keys pass through, each row by itself; an empty table gives no piece. Columns besides key and text are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, split_words

#: Punctuation behind a word: the tokenizer itself splits there, after a letter.
TAIL = ".,;:!?$%&*#|"
#: Letters alone, all in composed form and with one lower-case form: one pre-token, which the model can take as it is.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: About how much memory of a worker the remembered words may take.
MOST_BYTES = 96 << 20
ENTRY_BYTES = 180


def byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write byte b as character b where that is printable, and the others as U+0100 and on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) if b in shown else chr(256 + sum(x not in shown for x in range(b))) for b in range(256)}


class Growing:
    """An array that doubles when it is full."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1024, kind), 0

    def add(self, x: np.ndarray) -> None:
        need = self.size + len(x)
        if need > len(self.room):
            wider = np.zeros(max(need, 2 * len(self.room)), self.room.dtype)
            wider[: self.size] = self.room[: self.size]
            self.room = wider
        self.room[self.size : need] = x
        self.size = need


class RunEncoder:
    """Ids of words and of runs that are more than a word: their number, and by number their place in one array of ids. Number 0 is the empty word."""

    def __init__(self, path: str, most_bytes: int = MOST_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.most_bytes = most_bytes
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.begin, self.n, self.held = Growing(np.uint32), Growing(np.int64), Growing(np.int64), 0
        self.begin.add(np.zeros(1, np.int64)), self.n.add(np.zeros(1, np.int64))

    def word(self, word: str) -> list[int]:
        """Ids of one lower-case word of LETTERS."""
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]

    def remember(self, runs: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        self.known.update(zip(runs, range(self.n.size, self.n.size + len(runs)), strict=True))
        self.begin.add(self.ids.size + np.cumsum(n) - n)
        self.ids.add(ids), self.n.add(n)
        self.held += sum(map(len, runs)) + ENTRY_BYTES * len(runs) + 4 * len(ids)

    def numbers(self, found: pa.Array, words: bool) -> np.ndarray:
        """The number of each of some distinct strings; new ones are encoded. words: all are lower-case words of LETTERS."""
        runs = found.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.known.get, runs, repeat(-1)), np.int64, len(runs))
        unknown = np.flatnonzero(numbers < 0)
        new = [runs[i] for i in unknown.tolist()]
        if words:
            made = [self.word(w) for w in new]
            self.remember(new, np.array([i for x in made for i in x], np.uint32), np.fromiter(map(len, made), np.int64, len(made)))
        else:
            marked = [r for r in new if "<|" in r]  # may hold the text of a special token, which pre-split input would hide
            for r in marked:
                ids = np.array(self.tokenizer.encode(r, add_special_tokens=False).ids, np.uint32)
                self.remember([r], ids, np.array([len(ids)]))
            plain = [r for r in new if "<|" not in r]
            for a in range(0, len(plain), 20_000):
                made = self.tokenizer.encode(plain[a : a + 20_000], is_pretokenized=True, add_special_tokens=False)
                self.remember(plain[a : a + 20_000], np.array(made.ids, np.uint32), np.bincount(np.array(made.word_ids, np.int64), minlength=len(plain[a : a + 20_000])))
        numbers[unknown] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's offsets into them."""
        codes, offsets, runs = split_words(texts, lower=False)
        if self.held > self.most_bytes:
            self.forget()
        core = pc.ascii_rtrim(runs, characters=TAIL)
        has_tail = flags(pc.less(pc.binary_length(core), pc.binary_length(runs)))
        is_word = flags(pc.match_substring_regex(core, LETTERS)) & (~has_tail | flags(pc.match_substring_regex(core, "[A-Za-z]$")))
        at = np.zeros((len(runs), 2), np.int64)  # the word and its tail, or the run
        for place, which, words, strings in (
            (0, is_word, True, lambda x: pc.utf8_lower(core.filter(x))),
            (0, ~is_word, False, lambda x: runs.filter(x)),
            (1, is_word & has_tail, False, lambda x: pc.replace_substring_regex(runs.filter(x), r"^.*?([.,;:!?$%&*#|]*)$", r"\1")),
        ):
            if which.any():
                coded = strings(pa.array(which)).dictionary_encode()
                at[which, place] = self.numbers(coded.dictionary, words)[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.n.room[at]
        ids = self.ids.room[spread(self.begin.room[at].ravel(), n.ravel())]
        n = n.sum(1)
        each = n[codes]
        return ids[spread((np.cumsum(n) - n)[codes], each)], np.concatenate([[0], np.cumsum(each)])[offsets]


_ENCODERS: dict[str, RunEncoder] = {}


def encoder_of(path: str) -> RunEncoder:
    """The encoder of this process, which outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = RunEncoder(path)
    return _ENCODERS[path]


def vocabulary_size(path: str) -> int:
    """One more than the highest id that the tokenizer may give."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=-1) + 1


def flags(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] of them, then the same for 1, and so on."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def pieces(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = 4096, end_id: int = 1, id_bytes: int = 0) -> DataFrame:
    """One row for each piece of a document: key, ``piece``, ``start``, ``length``, ``ids_crc32`` (of little-endian 32-bit ids), and with ``id_bytes`` 2 or 4 the ids as little-endian numbers of that size.

    A document is its text's ids and then ``end_id``; a null text counts as empty, so that it is one piece of one id.
    Only documents of more than ``capacity`` ids are cut.
    """
    kept = df.select(F.col(text).alias("_text"), F.col(key).alias("_key"))
    kind = kept.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for block in blocks(batches, "_text"):
            ids, offsets = encoder.encode(block.column(0))
            row, piece, start, length, crc, raw = [], [], [], [], [], []
            for i in range(block.num_rows):
                own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                for p, a in enumerate(range(0, len(own), capacity)):
                    ids_here = own[a : a + capacity]
                    part = ids_here.tobytes()
                    row.append(i), piece.append(p), start.append(a), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if id_bytes:
                        raw.append(part if id_bytes == 4 else ids_here.astype("<u2").tobytes())
            columns = [block.column(1).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if id_bytes:
                columns.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * bool(id_bytes))
