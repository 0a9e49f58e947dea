"""Burkhard-Keller trees over 64-bit fingerprints, many at once, in arrays.

A child hangs from its parent by the integer Hamming distance between the two;
no two children of a parent share a distance. All trees of a task are built and
searched together, one level a step.
"""

from __future__ import annotations

import numpy as np


class Forest:
    """One tree for each run of equal ``groups`` (sorted); its root is the run's first row.

    ``values``: fingerprints as unsigned 64-bit integers, distinct in a group.
    """

    def __init__(self, groups: np.ndarray, values: np.ndarray):
        n = len(values)
        self.values = values
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.zeros(0, np.int64)
        self.sizes = np.diff(np.r_[starts, n])
        self.roots = np.repeat(starts, self.sizes)
        codes, children = [], []
        active = np.setdiff1d(np.arange(n), starts, assume_unique=True)
        at = self.roots[active]
        while len(active):
            code = at * 65 + np.bitwise_count(values[active] ^ values[at])
            order = np.argsort(code, kind="stable")
            active, code = active[order], code[order]
            first = np.r_[True, code[1:] != code[:-1]]
            child = active[first]
            codes.append(code[first])
            children.append(child)
            at = np.repeat(child, np.diff(np.r_[np.flatnonzero(first), len(code)]))
            active, at = active[~first], at[~first]
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(code)
        #: parent * 65 + distance of each edge, ascending, and the child there.
        self.edges, self.children = code[order], child[order]

    def within(self, queries: np.ndarray, radius: int):
        """Pairs (query, row) of row numbers of one group at distance 1 to ``radius``.

        From a node at distance d only edges of d - radius to d + radius are followed.
        """
        found_q, found_v = [], []
        q, v = queries, self.roots[queries]
        while len(q):
            d = np.bitwise_count(self.values[q] ^ self.values[v]).astype(np.int64)
            hit = (d <= radius) & (q != v)
            found_q.append(q[hit])
            found_v.append(v[hit])
            low = np.searchsorted(self.edges, v * 65 + np.maximum(d - radius, 0))
            many = np.searchsorted(self.edges, v * 65 + np.minimum(d + radius, 64), side="right") - low
            total = int(many.sum())
            q = np.repeat(q, many)
            v = self.children[np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(total)]
        return np.concatenate(found_q) if found_q else queries[:0], np.concatenate(found_v) if found_v else queries[:0]


def linked(groups: np.ndarray, values: np.ndarray, radius: int, most_pairs: int = 2_000_000) -> np.ndarray:
    """For each row, the first row of its group that links of at most ``radius`` reach.

    Queries run in blocks, so that no more than about ``most_pairs`` pairs of a
    query and a node are held at once.
    """
    forest = Forest(groups, values)
    label = np.arange(len(values))
    cost = np.cumsum(np.repeat(forest.sizes, forest.sizes))
    begin = 0
    while begin < len(values):
        end = max(begin + 1, int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + most_pairs)))
        q, v = forest.within(np.arange(begin, end), radius)
        while True:
            a, b = label[q], label[v]
            open_ = a != b
            if not open_.any():
                break
            q, v, a, b = q[open_], v[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                jumped = label[label]
                if np.array_equal(jumped, label):
                    break
                label = jumped
        begin = end
    return label
