"""The trie of conversations that share their first turns, with what is saved if each shared turn is kept once.

A node is a distinct sequence of first turns (role and text). Distinct sequences are sorted and dealt to shards by ranges of this order, so that a subtree lies in one shard or in
neighbours. A shard writes its trie as balanced parentheses (``parentheses.py``): findclose delimits subtrees, the rank of leaf pairs counts leaves, sums along the preorder give members and savings.
Only nodes on the path of a shard's first or last sequence, its spine, may go on in a neighbour: a shard hands on these two sequences, with the sums of the finished subtrees that hang from them, and
64 shards are merged by the same code, until one is left. No node is ever spread over all tasks, and no task holds more than a shard.

Defined cases: a null role or text is empty. Turns are ordered by turn (null first), then by the hash of role and text; repeated rows stay repeated turns. Rows without a conv_id belong to no
conversation and are left out. A conversation without turns left ends at the root. No conversations: no rows. Further columns are not read. A turn is known by the 128 bits of its md5: two unlike ones of n are taken for one with a
probability of n * n / 2**129. The turns of a conversation (hash and length, 40 bytes each) must fit into a task; its texts never do. Copies of a conversation are gathered by ranges of
4,096 ids, so a conversation that holds a third of all ids is many groups, then read in order by the task that hashes them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, settle, small
from .parentheses import Parentheses

NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Turns that a shard holds, about, and shards that are made at least.
SHARD_TURNS, LEAST_SHARDS = 100_000, 32
#: Shards that a merge takes.
MERGED = 64
#: Conversations whose first turns are the same share the prefix of one in so many, up to so many turns.
BASE, MOST_HEAD = 100, 6

MARK = "struct<depth: bigint, n: bigint, saved: bigint, leaves: bigint, children: bigint, first: bigint, ends: string>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key string, parent_key string"
REST = f"path array<binary>, lens array<bigint>, marks array<{MARK}>"


def turn_hash(role: Column, text: Column) -> Column:
    """16 bytes; the length in front keeps role and text apart."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation's turns in order, as hash and code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), turn_hash(role, text).alias("hash"), F.length(text).cast("long").alias("n")).alias("turn")
    )
    ordered = F.array_sort(F.collect_list("turn"))
    return turns.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["hash"].alias("hash"), t["n"].alias("n"))).alias("turns"))


def with_shared_heads(convs: DataFrame) -> DataFrame:
    """conv_id, path, lens: the first h turns of the conversation at the hundred below, then the own ones after the first h."""
    convs = settle(convs, "turns")
    heads = convs.filter(F.col("conv_id") % BASE == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_HEAD).alias("head"))
    h = fold("conv_id", MOST_HEAD).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    met = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE).join(heads.hint("merge"), "base", "left")
    rebuilt = met.select("conv_id", F.concat(F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, h)), own).alias("turns"))
    return rebuilt.select("conv_id", F.col("turns.hash").alias("path"), F.col("turns.n").alias("lens"))


def distinct_paths(convs: DataFrame) -> DataFrame:
    """path, lens and one mark: how many conversations are just this, the smallest, and the hash of all."""
    grouped = convs.groupBy("path", "lens", F.shiftright("conv_id", 12).alias("range")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    dealt = grouped.repartition("path").sortWithinPartitions("path", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = lens = digest = None
        n = first = 0
        for batch in batches:
            out = []
            for p, size, ids in zip(batch["path"].to_pylist(), batch["lens"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if p != path:
                    if digest is not None:
                        out.append((path, lens, mark(len(path), n, first, digest)))
                    path, lens, digest, n, first = p, size, hashlib.sha256(), 0, ids[0]
                digest.update(f"{',' if n else ''}{','.join(map(str, ids))}".encode())
                n += len(ids)
            if out:
                yield rest_batch(out)
        if digest is not None:
            yield rest_batch([(path, lens, mark(len(path), n, first, digest))])

    return dealt.mapInArrow(run, REST)


def mark(depth: int, n: int, first: int, digest) -> list[dict]:
    return [{"depth": depth, "n": n, "saved": 0, "leaves": 0, "children": 0, "first": first, "ends": digest.hexdigest()}]


MARK_TYPE = pa.struct([("depth", pa.int64()), ("n", pa.int64()), ("saved", pa.int64()), ("leaves", pa.int64()), ("children", pa.int64()), ("first", pa.int64()), ("ends", pa.string())])
REST_TYPES = [pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(MARK_TYPE)]


def rest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, REST_TYPES, strict=True)], names=["path", "lens", "marks"])


@dataclass
class Shard:
    """The trie of sorted sequences. Node 0 is the root; nodes follow in preorder; what is marked at a node comes from finished subtrees or from conversations that end there."""

    bits: list[int] = field(default_factory=lambda: [1])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    length: list[int] = field(default_factory=lambda: [0])
    name: list[bytes] = field(default_factory=lambda: [b""])
    sums: dict[str, list[int]] = field(default_factory=lambda: {k: [0] for k in ("n", "saved", "leaves", "children")})
    first: list[float] = field(default_factory=lambda: [math.inf])
    ends: list[str] = field(default_factory=lambda: [NO_ENDS])
    stack: list[int] = field(default_factory=lambda: [0])
    first_path: list[int] | None = None

    def add(self, path: list[bytes], lens: list[int], marks: list[dict]) -> None:
        stack, name = self.stack, self.name
        common, most = 0, min(len(path), len(stack) - 1)
        while common < most and name[stack[common + 1]] == path[common]:
            common += 1
        self.bits.extend([-1] * (len(stack) - 1 - common))
        del stack[common + 1 :]
        for d in range(common, len(path)):
            self.parent.append(stack[-1])
            stack.append(len(name))
            name.append(path[d]), self.depth.append(d + 1), self.length.append(lens[d])
            self.first.append(math.inf), self.ends.append(NO_ENDS)
            for of in self.sums.values():
                of.append(0)
        self.bits.extend([1] * (len(path) - common))
        for m in marks:
            v = stack[m["depth"]]
            for k, of in self.sums.items():
                of[v] += m[k]
            self.first[v] = min(self.first[v], math.inf if m["first"] is None else m["first"])
            if m["ends"] != NO_ENDS:  # a sequence is in one shard, once
                self.ends[v] = m["ends"]
        if self.first_path is None:
            self.first_path = list(stack)

    def keys(self, nodes: list[int]) -> dict[int, str]:
        """A key for each of these nodes, which hold their parents' numbers before their own."""
        chained = {0: hashlib.md5()}
        for v in nodes:
            if v:
                h = chained[self.parent[v]].copy()
                h.update(self.name[v])
                chained[v] = h
        return {v: chained[v].hexdigest() for v in nodes}

    def finish(self, last: bool, keyed: bool) -> tuple[list[tuple], list[tuple]]:
        """Rows of finished nodes, and what is handed on: the sequences of the first and the last path with their marks."""
        last_path = list(self.stack)
        tree = Parentheses(np.array(self.bits + [-1] * len(last_path), np.int64))
        opens = tree.opens()
        close = tree.find_close(opens)
        size = (close - opens + 1) // 2
        here, end = np.arange(len(opens)), np.arange(len(opens)) + size
        length, parent = np.array(self.length, np.int64), np.array(self.parent, np.int64)
        done = np.ones(len(opens), bool)
        if not last:
            done[self.first_path] = done[last_path] = False

        def below(x: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(x)])
            return total[end] - total[here]

        n, saved, leaves, children = (np.array(self.sums[k], np.int64) for k in ("n", "saved", "leaves", "children"))
        members = below(n)
        saved = below(saved + np.where(done & (here > 0), (members - 1) * length, 0))
        no_leaf = (size == 1) & ~(done & (children == 0))
        leaves = tree.rank_leaf(close) - tree.rank_leaf(opens) + below(leaves - no_leaf)
        children = children + np.bincount(parent[1:][done[1:]], minlength=len(opens)) if len(opens) > 1 else children
        spine = list(dict.fromkeys([*self.first_path, *last_path])) if not last else []
        ready, above = done.tolist(), self.parent
        for v in range(len(above) - 1, 0, -1):
            if ready[v] and self.first[v] < self.first[above[v]]:
                self.first[above[v]] = self.first[v]
        key = self.keys(list(range(len(above))) if keyed else spine)
        rows = []
        for v, m, c, f, s in zip(here.tolist(), members.tolist(), children.tolist(), leaves.tolist(), saved.tolist(), strict=True):
            if ready[v]:
                p = above[v]
                known = p < 0 or ready[p]
                rows.append((self.first[v], self.depth[v], self.first[p] if known and p >= 0 else None, m, c, f, s, self.ends[v], key[v] if keyed else None, None if known else key[p]))
        own = {v: [int(x[v]) for x in (members, saved, leaves)] for v in spine}
        whole = {v: tuple(x) for v, x in own.items()}
        for v in spine:
            if v:
                own[above[v]] = [a - b for a, b in zip(own[above[v]], whole[v], strict=True)]
        rest, seen = [], set()
        for path in [self.first_path, last_path] if spine else []:
            marks = [
                {"depth": d, "n": own[v][0], "saved": own[v][1], "leaves": own[v][2], "children": int(children[v]), "first": None if self.first[v] == math.inf else self.first[v], "ends": self.ends[v]} for d, v in enumerate(path) if v not in seen
            ]
            seen.update(path)
            if marks:
                rest.append(([self.name[v] for v in path[1:]], [self.length[v] for v in path[1:]], marks))
        return rows, rest


NODE_TYPES = [pa.int64()] * 7 + [pa.string()] * 3
NODE_NAMES = [x.split()[0] for x in NODE.split(", ")]


def one_level(paths: DataFrame, shards: int, keyed: bool) -> DataFrame:
    """The finished nodes of each shard, and rows with a path for what it hands on; one shard hands on nothing."""
    dealt = paths.repartitionByRange(shards, "path") if shards > 1 else paths.coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for path, lens, marks in zip(batch["path"].to_pylist(), batch["lens"].to_pylist(), batch["marks"].to_pylist(), strict=True):
                shard.add(path, lens, marks)
        if shard.first_path is None:
            return
        rows, rest = shard.finish(shards == 1, keyed)
        for i in range(0, len(rows), 50_000):
            columns = zip(*rows[i : i + 50_000], strict=True)
            arrays = [pa.array(list(c), t) for c, t in zip(columns, NODE_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(arrays[0]), t) for t in REST_TYPES)], names=[*NODE_NAMES, "path", "lens", "marks"])
        if rest:
            given = rest_batch(rest)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rest), t) for t in NODE_TYPES), *given.columns], names=[*NODE_NAMES, "path", "lens", "marks"])

    return dealt.sortWithinPartitions("path").mapInArrow(run, f"{NODE}, {REST}")


def nodes(paths: DataFrame, shards: int | None = None, merged: int = MERGED, broadcast_rows: int = 100_000) -> DataFrame:
    """A row for each node: conv_id (the smallest member's), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = settle(paths, "paths")
    if shards is None:
        turns = paths.agg(F.coalesce(F.sum(F.size("path") + 1), F.lit(0))).first()[0]
        shards = max(LEAST_SHARDS, math.ceil(turns / SHARD_TURNS))
    levels, keyed = [], False
    while True:
        level = settle(one_level(paths, shards, keyed), "level")
        levels.append(level.filter("path IS NULL").select(NODE_NAMES))
        if shards == 1:
            break
        paths = level.filter("path IS NOT NULL").select("path", "lens", "marks")
        shards, keyed = math.ceil(shards / merged) if shards > merged else 1, True
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    spine = found.filter("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    open_ends = found.filter("parent_key IS NOT NULL")
    rows = spine.count()
    if rows <= broadcast_rows:
        met = open_ends.join(small(spine, rows, broadcast_rows), "parent_key")
    else:  # a parent may have a third of all nodes as children
        parts = F.lit(64)
        salted = spine.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        met = open_ends.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), parts).cast("int")).join(salted.hint("merge"), ["parent_key", "salt"])
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return found.filter("parent_key IS NULL").select(out).unionByName(met.withColumn("parent_conv_id", F.col("parent")).select(out))


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of a table of turns (conv_id, turn, role, text), as it is."""
    return nodes(distinct_paths(sequences(rows).select("conv_id", F.col("turns.hash").alias("path"), F.col("turns.n").alias("lens"))))


def rebuilt_trie(rows: DataFrame) -> DataFrame:
    """The nodes after each conversation got the head of the one at the hundred below."""
    return nodes(distinct_paths(with_shared_heads(sequences(rows))))
