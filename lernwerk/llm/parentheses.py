"""A tree as balanced parentheses: one bit up and one down for each node in depth-first order, with a tree of least and greatest excess over blocks of bits."""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parentheses:
    """``bits``: 1 opens a node, -1 closes it; balanced. Positions count from 0."""

    def __init__(self, bits: np.ndarray):
        self.bits = np.asarray(bits, np.int64)
        self.excess = np.cumsum(self.bits)
        blocks = max(1, -(-len(self.bits) // BLOCK))
        self.leaves = 1 << (blocks - 1).bit_length()
        wide = np.full(self.leaves * BLOCK, -1, np.int64)  # behind the end no excess is sought: all that are sought are 0 at least
        wide[: len(self.bits)] = self.excess
        wide = wide.reshape(self.leaves, BLOCK)
        self.least, self.most = np.empty(2 * self.leaves, np.int64), np.empty(2 * self.leaves, np.int64)
        self.least[self.leaves :], self.most[self.leaves :] = wide.min(1), wide.max(1)
        for level in range((self.leaves - 1).bit_length() - 1, -1, -1):
            at = np.arange(1 << level, 2 << level)
            self.least[at] = np.minimum(self.least[2 * at], self.least[2 * at + 1])
            self.most[at] = np.maximum(self.most[2 * at], self.most[2 * at + 1])
        pair = (self.bits[:-1] == 1) & (self.bits[1:] == -1)
        self.pairs = np.concatenate([[0], np.cumsum(pair), [pair.sum()]])[: len(self.bits) + 1] if len(self.bits) else np.zeros(1, np.int64)

    def opens(self) -> np.ndarray:
        """Positions of the opening bits: nodes in preorder."""
        return np.flatnonzero(self.bits == 1)

    def rank_leaf(self, at: np.ndarray) -> np.ndarray:
        """How many pairs of an opening and a closing bit side by side start before each position."""
        return self.pairs[at]

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """For each opening bit the position of its closing one: the first later place whose excess is one less than at the opening bit."""
        want = self.excess[opens] - 1
        found = np.full(len(opens), -1, np.int64)
        left = self._scan(opens + 1, want, found, np.arange(len(opens)))
        node, target = (opens[left] + 1) // BLOCK + self.leaves, want[left]
        up = np.ones(len(left), bool)
        while up.any():  # climb until a tree of blocks to the right holds the excess: neighbours differ by one, so all between least and most is there
            there = up & (node % 2 == 0)
            there[there] = self._holds(node[there] + 1, target[there])
            node = np.where(there, node + 1, np.where(up, node // 2, node))
            up &= ~there
        while (down := node < self.leaves).any():
            node = np.where(down, 2 * node, node)
            node[down] += ~self._holds(node[down], target[down])
        self._scan((node - self.leaves) * BLOCK, target, found, left)
        return found

    def _holds(self, node: np.ndarray, excess: np.ndarray) -> np.ndarray:
        return (self.least[node] <= excess) & (excess <= self.most[node])

    def _scan(self, start: np.ndarray, want: np.ndarray, found: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Look for ``want`` from ``start`` to the end of its block; what is found goes to ``found[rows]``. The rows that are left."""
        at, end = start.copy(), np.minimum((start // BLOCK + 1) * BLOCK, len(self.bits))
        live = np.arange(len(rows))
        while len(live := live[at[live] < end[live]]):
            hit = self.excess[at[live]] == want[live]
            found[rows[live[hit]]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
        return rows[found[rows] < 0]
