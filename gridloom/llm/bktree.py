"""BK-trees over bit codes: children keyed by their integer Hamming distance to the parent.

A forest holds one tree for each shard and is built and searched level by level over all shards at once.
A tree gets its members in their order, so it is the tree that inserting them one by one would give. A search
follows only edges whose key differs from the node's distance by no more than the radius.
"""

from __future__ import annotations

import numpy as np

#: Queries searched at once, at most, and pairs of a query and a node held at once: as many queries as their trees have members.
QUERIES, PAIRS = 8192, 200_000


class Forest:
    def __init__(self, codes: np.ndarray, shard: np.ndarray):
        """codes: (n, words) uint64; shard: n numbers in ascending order, one tree each."""
        n = len(codes)
        self.codes, self.width = codes, 64 * codes.shape[1] + 1
        first = np.concatenate([[True], shard[1:] != shard[:-1]]) if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        keys, kids = [], []
        todo = np.flatnonzero(~first)
        at = self.root[todo]
        while len(todo):
            key = at * self.width + self.distance(todo, at)
            distinct, lead, group = np.unique(key, return_index=True, return_inverse=True)
            keys.append(distinct)
            kids.append(todo[lead])  # the first member with this parent and distance is the child
            at = todo[lead][group]
            on = at != todo
            todo, at = todo[on], at[on]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.keys, self.kids = key[order], (np.concatenate(kids) if kids else np.zeros(0, np.int64))[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for word in self.codes.T:  # no copy of whole codes for all pairs
            out += np.bitwise_count(word[a] ^ word[b])
        return out

    def search(self, radius: int):
        """Yields arrays (query, node) of all pairs of one shard within the radius, query != node."""
        size = np.bincount(self.root, minlength=len(self.root))[self.root]
        pairs = np.concatenate([[0], np.cumsum(size)])  # a query meets each member of its tree once, at most
        end = 0
        while end < len(self.codes):
            start = end
            end = int(np.searchsorted(pairs, pairs[start] + PAIRS, "right")) - 1
            end = max(start + 1, min(end, start + QUERIES))
            q = np.arange(start, end)
            node = self.root[q]
            while len(q):
                d = self.distance(q, node)
                near = (d <= radius) & (q != node)
                if near.any():
                    yield q[near], node[near]
                # children with edges in [d - radius, d + radius]: one run of the sorted keys
                a = np.searchsorted(self.keys, node * self.width + np.maximum(d - radius, 0))
                b = np.searchsorted(self.keys, node * self.width + np.minimum(d + radius, self.width - 1), "right")
                n = b - a
                at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                q, node = np.repeat(q, n), self.kids[at]

    def linked(self, radius: int) -> np.ndarray:
        """For each member the least member it is connected with through pairs within the radius."""
        label = np.arange(len(self.codes))
        for q, node in self.search(radius):
            a, b = label[q], label[node]
            on = a != b
            if not on.any():
                continue
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while x in up:
                    x = up[x]
                return x

            for x in np.unique(np.minimum(a, b)[on] * len(label) + np.maximum(a, b)[on]).tolist():
                s, t = find(x // len(label)), find(x % len(label))
                if s != t:
                    up[max(s, t)] = min(s, t)
            old = np.fromiter(up, np.int64, len(up))
            swap = np.arange(len(label))
            swap[old] = [find(x) for x in old.tolist()]
            label = swap[label]
        return label
