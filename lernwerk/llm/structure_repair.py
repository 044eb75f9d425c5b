"""Repair the order of roles in conversations by the cheapest edits, found by the auction algorithm for shortest paths.

A conversation is a lattice: a node for each row and state of the pattern ``(s?(ua)+)?`` of role initials, an arc for each edit: keep (0), rerole to user or assistant (2), delete (3), insert an empty
turn of user or assistant (2); a truncated row that stays costs 1 more; blank and duplicate rows must go. Every node has a price that never exceeds what is left to pay behind it. A path grows from the
origin along an arc that is tight (price = cost + price of its head); at a node without one it raises the price to the least cost + price and shrinks by a node. Reaching the end, it proves
the origin's price. Blocks of ``BLOCK`` rows are solved from the last to the first, each against the proven prices behind it, so the work is linear in the rows. All shortest paths
consist of tight arcs; of those that lead to the end, the one of the least letter is followed (D before I before K before R).

Defined cases: null role or text is one space, a space being no known role, so such a row is reroled or deleted. An empty role has no initial and is treated alike. Rows are ordered by turn (null first), role and md5 of the text; equal
rows are duplicates of the first. A null conv_id is a conversation of its own. Further columns are not read. No rows: no conversations. The texts of a conversation pass through a task one after the other; it keeps
one byte for each row, a hash for each distinct one and the prices of a block, so a conversation may be of any length, but is read by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose prices are proven together.
BLOCK = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the pattern: nothing yet, after s, after u, after a; where an initial leads, and the initial that an edit may give with its state.
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
GIVEN = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
ENDS = (0, 3)
FULL = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\v\f\r"
NEVER = 1 << 60


def arcs(code: str, state: int) -> list[tuple[str, int, int, int]]:
    """Edits at a row in a state: letter, cost, rows it goes on, state after. code: the role's initial, upper case if truncated, ``-`` if the row must go, empty behind the last row."""
    found = [("I", INSERT, 0, GIVEN[state][1])]
    if not code:
        return [("", 0, 1, 0)] + found if state in ENDS else found
    found.insert(0, ("D", DELETE, 1, state))
    if code != "-":
        extra = TRUNCATED if code.isupper() else 0
        kept = AFTER.get(code.lower(), (None,) * 4)[state]
        if kept is not None:
            found.append(("K", KEEP + extra, 1, kept))
        found.append(("R", REROLE + extra, 1, GIVEN[state][1]))
    return found


ARCS = {code: [arcs(code, q) for q in range(4)] for code in ["-", *"suaxSUAX", ""]}
#: What any way past a row costs at least, whatever the state.
LEAST = {code: min(cost for q in range(4) for _, cost, step, _ in found[q] if step) for code, found in ARCS.items()}


def auction(prices: list[list[int]], codes: list[str], origin: tuple[int, int], fixed: int) -> None:
    """Raise prices until the one at the origin is proven: layers from ``fixed`` on have proven ones."""
    path = [origin]
    while True:
        i, q = path[-1]
        least, head = NEVER, None
        for _, cost, step, state in ARCS[codes[i]][q]:
            through = cost + prices[i + step][state]
            if through < least:
                least, head = through, (i + step, state)
        if prices[i][q] < least:
            prices[i][q] = least
            if len(path) > 1:
                path.pop()
        elif head[0] >= fixed:
            return
        else:
            path.append(head)


def tight(prices: list[list[int]], codes: list[str], i: int, choice: list[str | None], behind: list[str | None]) -> None:
    """For the nodes of a layer the least letter of a tight arc that leads to the end; None where there is none. behind: those of the next layer."""
    for _ in range(3):  # inserts stay in the layer: a way takes two of them at most
        for q in range(4):
            for letter, cost, step, state in ARCS[codes[i]][q]:
                if prices[i][q] == cost + prices[i + step][state] and (behind if step else choice)[state] is not None:
                    choice[q] = letter
                    break


@lru_cache(1 << 14)
def cheapest(codes: str) -> tuple[int, str]:
    return solve(codes)


def solve(codes: str) -> tuple[int, str]:
    """The cost and the letters of the cheapest edits, the least string of those that cost the same."""
    after, behind = [0] + [NEVER] * 3, ["", None, None, None]
    n, chosen = len(codes) + 1, []
    for low in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        part = [*codes[low : low + BLOCK]]
        if low + BLOCK >= n:
            part.append("")
        prices = [after]
        for code in reversed(part):  # no price exceeds what is left to pay: the least past each row, then the least proven one
            prices.append([min(prices[-1]) + LEAST[code]] * 4)
        prices.reverse()
        for q in range(4):
            auction(prices, part, (0, q), len(part))
        for i in range(len(part) - 1, -1, -1):
            choice: list[str | None] = [None] * 4
            tight(prices, part, i, choice, behind)
            chosen.append("".join("." if c is None else c or "E" for c in choice))
            behind = choice
        after = prices[0]
    chosen.reverse()
    i = q = 0
    letters = []
    while (letter := chosen[i][q]) != "E":
        letters.append(letter)
        step, q = next((s, to) for x, _, s, to in ARCS[codes[i] if i < len(codes) else ""][q] if x == letter)
        i += step
    return after[0], "".join(letters)


class Turn(NamedTuple):
    conv_id: int | None
    role: str
    text: str
    edit: str


class Report(NamedTuple):
    conv_id: int | None
    gaps: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    cost: int
    audit: str


class Walk:
    """One conversation: first its rows without texts, then those with."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.seen = conv_id, [], set()
        self.low = self.last = None
        self.turns = self.illegal = self.at = self.state = 0
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.before: str | None = None
        self.report: Report | None = None

    def look(self, turn: int | None, role: str, digest: bytes, blank: bool, truncated: bool) -> None:
        initial = role[:1]
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.last, self.turns = turn, self.turns + 1
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        known = (role, digest)
        fault = "blank" if blank else "duplicate" if known in self.seen else "truncated" if truncated else None
        self.seen.add(known)
        if fault:
            self.count[fault] += 1
        code = initial if initial in AFTER else "x"
        self.codes.append("-" if fault in ("blank", "duplicate") else code.upper() if fault else code)

    def solved(self) -> Report:
        if self.report is None:
            codes = "".join(self.codes)
            cost, audit = (cheapest if len(codes) <= 64 else solve)(codes)
            gaps = 0 if self.low is None else self.last - self.low + 1 - self.turns
            self.report = Report(self.conv_id, gaps, *self.count.values(), self.illegal, cost, audit)
            self.codes, self.seen = [], set()
        return self.report

    def inserted(self) -> Iterator[Turn]:
        audit = self.solved().audit
        while self.at < len(audit) and audit[self.at] == "I":
            yield self.given("", "I")

    def given(self, text: str, edit: str) -> Turn:
        initial, self.state = GIVEN[self.state]
        self.at += 1
        return Turn(self.conv_id, FULL[initial], text, edit)

    def edited(self, role: str, text: str) -> Iterator[Turn]:
        """The turns that a row leaves, with those inserted before it."""
        yield from self.inserted()
        letter = self.report.audit[self.at]
        if letter == "R":
            yield self.given(text, "R")
            return
        self.at += 1
        if letter == "K":
            self.state = AFTER[role[0]][self.state]
            yield Turn(self.conv_id, role, text, "K")


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, alive, copies``: nulls as one space, then by crc32(conv_id:turn) % 20: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    what = F.crc32(place.cast("binary")) % 20
    text = F.coalesce("text", space)
    return rows.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.when(what == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(what == 1, "").when(what == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (what != 0).alias("alive"),
        F.when(what == 3, 2).otherwise(1).alias("copies"),
    )


def sorted_rows(rows: DataFrame) -> DataFrame:
    """Each conversation's rows twice, in order: first without texts, to find the edits, then with them."""
    space = F.lit(" ")
    text = F.coalesce("text", space)
    alive = F.col("alive") if "alive" in rows.columns else F.lit(True)
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    bare = F.rtrim(text, F.lit(BLANKS))
    known = rows.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", space).alias("role"),
        F.unhex(F.md5(text)).alias("digest"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
        alive.alias("alive"),
        copies.alias("copies"),
        text.alias("text"),
    )

    def kind(with_text: int) -> Column:
        return F.struct(F.lit(with_text).alias("kind"), F.when(F.lit(bool(with_text)), F.col("text")).alias("text"))

    kinds = F.when(F.col("alive"), F.flatten(F.array_repeat(F.array(kind(0), kind(1)), F.col("copies")))).otherwise(F.array(kind(0)))
    twice = known.withColumn("part", F.explode(kinds)).select("conv_id", "turn", "role", "digest", "blank", "truncated", "alive", "part.*")
    return twice.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest")


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[Turn | Report]:
    """The edited turns of each conversation, then its report."""
    walk = None
    for batch in batches:
        for conv_id, turn, role, digest, blank, truncated, alive, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if walk is None or conv_id != walk.conv_id:
                if walk is not None:
                    yield from walk.inserted()
                    yield walk.solved()
                walk = Walk(conv_id)
            if kind:
                walk.solved()
                yield from walk.edited(role, text)
            elif alive:
                walk.look(turn, role, digest, blank, truncated)
    if walk is not None:
        yield from walk.inserted()
        yield walk.solved()


def batched(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def reports(rows: DataFrame) -> DataFrame:
    """A row for each conversation: what is wrong with it, the cost and the letters of its edits, and the hash of what it becomes.

    ``rows``: conv_id, turn, role, text; ``alive`` false marks rows that are gone, but whose conversation is reported; ``copies`` how often a row stands.
    """
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in Report._fields[1:-1]), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, any_turn = [], hashlib.sha256(), False
        for found in walked(batches):
            if isinstance(found, Turn):
                digest.update(f"{chr(10) if any_turn else ''}{found.role}:{found.text}".encode("utf-8", "surrogatepass"))
                any_turn = True
            else:
                out.append((*found, digest.hexdigest()))
                digest, any_turn = hashlib.sha256(), False
                if len(out) == 10_000:
                    yield batched(out, schema)
                    out = []
        if out:
            yield batched(out, schema)

    return sorted_rows(rows).mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text, edit (K kept, R reroled, I inserted)."""
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, position = [], 0, 0
        for found in walked(batches):
            if isinstance(found, Report):
                position = 0
                continue
            out.append((found.conv_id, position, found.role, found.text, found.edit))
            position, size = position + 1, size + len(found.text) + 50
            if size > 4 << 20:
                yield batched(out, schema)
                out, size = [], 0
        if out:
            yield batched(out, schema)

    return sorted_rows(rows).mapInArrow(run, "conv_id long, position long, role string, text string, edit string")
