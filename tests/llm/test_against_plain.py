"""The schedule of the mix, the number of sequences, the order of columns and the likeness of fingerprints, against plain counterparts on given tables."""

import math
import re
from collections import Counter
from fractions import Fraction

import pytest

from lernwerk.llm import mixing, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("share", [{"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 97, "b": 1, "c": 1, "d": 1}, {f"s{i}": i + 1 for i in range(12)}, {"x": 333, "y": 333, "z": 334}])
def test_schedule_equals_a_plain_one_and_keeps_its_bound(share):
    """Every slot looks at all sources: of the released blocks the one of the earliest deadline, ties by name."""
    period, done, want = sum(share.values()), Counter(), {k: [] for k in share}
    for slot in range(period):
        open_blocks = [(math.ceil(Fraction((done[k] + 1) * period, n)), k) for k, n in share.items() if done[k] < n and math.floor(Fraction(done[k] * period, n)) <= slot]
        _, k = min(open_blocks)
        want[k].append(slot)
        done[k] += 1
        assert all(abs(done[s] - Fraction(n * (slot + 1), period)) < 1 for s, n in share.items())
    assert mixing.schedule(share) == want


def lower_bound(lengths, capacity):
    """L2 of Martello and Toth: no packing has fewer bins."""
    best = math.ceil(sum(lengths) / capacity)
    for k in {n for n in lengths if n <= capacity // 2} | {0}:
        large, middle = [n for n in lengths if n > capacity - k], [n for n in lengths if capacity // 2 < n <= capacity - k]
        small = sum(n for n in lengths if k <= n <= capacity // 2)
        best = max(best, len(large) + len(middle) + max(0, math.ceil((small - (len(middle) * capacity - sum(middle))) / capacity)))
    return best


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sequences_are_as_few_as_the_bound_nearly(spark, sf):
    packed = registry.op6_best_fit_packing(spark, f"/root/testdata/{sf}")
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = packed.collect()
    n, bound = len({r.sequence_id for r in rows}), lower_bound([r.length for r in rows], 4096)
    assert bound <= n <= bound + max(1, bound // 200)


def test_likeness_estimates_the_shared_blocks(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    after = {i: docs[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}
    blocks = lambda t: Counter(b for line in t.split("\n") for b in re.findall(r"(?s).{1,48}", line))

    def likeness(a, b):
        a, b = blocks(a), blocks(b)
        if not a or not b:
            return float(a == b)
        apart = sum((a[x] - b[x]) ** 2 for x in a | b)
        return max(0.0, 1 - apart / (sum(n * n for n in a.values()) + sum(n * n for n in b.values())))

    errors = []
    for r in registry.op10_fingerprints(spark, SF).collect():
        text = docs[r.doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[r.doc_id][:half]
        errors += [r.near_edited - likeness(text, edited), r.near_next - likeness(text, after[r.doc_id])]
    assert max(map(abs, errors)) < 0.5 and sum(map(abs, errors)) / len(errors) < 0.08
