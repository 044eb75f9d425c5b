"""The trie of conversations against a plain dictionary of prefixes, for any number of shards and levels of merging."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lernwerk.llm import prefix_trie
from lernwerk.llm.parentheses import Parentheses

SCHEMA = "conv_id long, turn long, role string, text string, conv string, path string, key string"


def test_find_close_and_leaf_rank():
    rng = random.Random(5)
    for _ in range(60):
        bits, depth = [1], 1
        for _ in range(rng.choice([0, 3, 60, 400, 3000])):
            up = depth == 1 or rng.random() < rng.choice([0.5, 0.8])
            bits.append(1 if up else -1)
            depth += bits[-1]
        bits += [-1] * depth
        tree, stack, close = Parentheses(np.array(bits)), [], {}
        for i, b in enumerate(bits):
            if b == 1:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opens = tree.opens()
        assert tree.find_close(opens).tolist() == [close[i] for i in opens.tolist()]
        pairs = [sum(bits[j] == 1 and bits[j + 1] == -1 for j in range(i)) for i in (0, len(bits) // 2, len(bits) - 1)]
        assert tree.rank_leaf(np.array([0, len(bits) // 2, len(bits) - 1])).tolist() == pairs


def brute_force(rows, heads=True):
    convs = {}
    for r in rows:
        if r[0] is not None:
            convs.setdefault(r[0], []).append(r)

    def order(r):
        role, text = r[2] or "", r[3] or ""
        return (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest())

    turns = {c: [(r[2] or "", r[3] or "") for r in sorted(rs, key=order)] for c, rs in convs.items()}
    members = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if heads else 0
        base = turns.get(c - int(math.fmod(c, 100)), [])  # as in SQL, the remainder has the sign of c
        path = tuple([*base[:h], *own[h:]])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path) == d))
    want = set()
    for node, of in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c, here in of if here)))
        want.add(
            (
                min(c for c, _ in of),
                len(node),
                min(c for c, _ in members[node[:-1]]) if node else None,
                len(of),
                sum(len(n) == len(node) + 1 for n in below),
                sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below),
                sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return want


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), 100, 107, 199, 10_000, 10_001, -3]:
        for t in range(rng.choice([1, 2, 3, 8])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "a longer text"])))
    rows += [(500, None, None, None), (500, 2, "user", None), (501, 1, "user", "x"), (501, 1, "user", "x"), (501, 1, "assistant", "y"), (None, 1, "user", "lost"), (502, 0, "", "user:")]
    rows += [(c, t, "user", "the same") for c in range(5000, 5060) for t in range(3)]
    return rows


@pytest.mark.parametrize(("seed", "shards", "merged", "broadcast"), [(1, 1, 64, 100), (2, 7, 64, 100_000), (3, 40, 3, 100_000), (4, 9, 2, 0), (5, None, 64, 100_000)])
def test_nodes_equal_brute_force(spark, seed, shards, merged, broadcast):
    rows = rows_of(seed, 40)
    table = spark.createDataFrame([(*r, "clash", "clash", None) for r in rows], SCHEMA).repartition(3)
    paths = prefix_trie.distinct_paths(prefix_trie.with_shared_heads(prefix_trie.sequences(table)))
    got = [tuple(r) for r in prefix_trie.nodes(paths, shards, merged, broadcast).collect()]
    want = brute_force(rows)
    assert len(got) == len(want) and set(got) == want


def test_long_turns_deep_chains_and_empty_tables(spark):
    rows = [(1, t, "user", f"t{t}" * 50) for t in range(700)] + [(2, t, "user", f"t{t}" * 50) for t in range(650)] + [(3, 0, "user", "x" * 3_000_000)]
    table = spark.createDataFrame([(*r, "", "", None) for r in rows], SCHEMA)
    got = {(r.conv_id, r.depth): r for r in prefix_trie.trie(table).collect()}
    assert len(got) == 702 and got[1, 650].n_convs == 2 and got[1, 651].n_convs == 1 and got[3, 1].saved_tokens == 0
    assert got[1, 0].saved_tokens == sum(len(f"t{t}" * 50) for t in range(650)) and got[1, 0].n_leaves == 2
    assert prefix_trie.rebuilt_trie(table.limit(0)).count() == 0
    alone = prefix_trie.rebuilt_trie(table.filter(F.col("conv_id") == 3)).collect()  # crc32("3") % 6 turns of a conversation that is not there
    assert alone[0].ends_sha256 != prefix_trie.NO_ENDS or len(alone) == 2
