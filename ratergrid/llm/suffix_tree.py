"""Suffix trees of number sequences, and the longest common extension of any two suffixes in constant time."""

from __future__ import annotations

import numpy as np

#: Places of an Euler tour that are looked at together; the tables between blocks then stay linear in size.
_BLOCK = 32


class SuffixTree:
    """Ukkonen's tree of ``seq`` (numbers from 1 on), closed by a 0 that occurs nowhere else.

    Node 0 is the root. A child is found by ``node * width + first symbol`` in ``edges``; the label of the edge to a
    node is ``seq[start[node]:end[node]]``. Leaves are made in the order of their suffixes.
    """

    def __init__(self, seq: list[int]):
        self.seq = s = [*seq, 0]
        self.size, self.width = len(seq), max(s) + 1
        n, width = len(s), self.width
        self.edges = edges = {}
        self.start, self.end, self.leaves = start, end, leaves = [0], [0], []
        link = [0]
        node = first = length = open_suffixes = 0  # the active point, and the suffixes that are still implicit
        for i, c in enumerate(s):
            open_suffixes += 1
            lone = 0  # an inner node of this round that waits for its suffix link
            while open_suffixes:
                if not length:
                    first = i
                key = node * width + s[first]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    leaves.append(len(start))
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if lone:
                        link[lone] = node
                        lone = 0
                else:
                    a = start[child]
                    label = min(end[child], i + 1) - a
                    if length >= label:
                        first += label
                        length -= label
                        node = child
                        continue
                    if s[a + length] == c:
                        length += 1
                        if lone:
                            link[lone] = node
                        break
                    middle = len(start)
                    start += [a, i]
                    end += [a + length, n]
                    link += [0, 0]
                    edges[key] = middle
                    edges[middle * width + c] = middle + 1
                    edges[middle * width + s[a + length]] = child
                    leaves.append(middle + 1)
                    start[child] = a + length
                    if lone:
                        link[lone] = middle
                    lone = middle
                open_suffixes -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    first = i - open_suffixes + 1

    def _children(self, backward: bool) -> tuple[list[int], list[int]]:
        """Children of all nodes in the order of their symbols (0 first; the others falling if ``backward``), and
        where those of each node begin."""
        keys = np.fromiter(self.edges, np.int64, len(self.edges))
        kids = np.fromiter(self.edges.values(), np.int64, len(self.edges))
        parent, symbol = np.divmod(keys, self.width)
        order = np.lexsort(((-symbol) % self.width if backward else symbol, parent))
        begin = np.searchsorted(parent[order], np.arange(len(self.start) + 1))
        return kids[order].tolist(), begin.tolist()

    def tour(self, backward: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of an Euler tour: the string depth at each step, the step of each suffix's leaf, suffixes in tour order."""
        kids, begin = self._children(backward)
        start, end = self.start, self.end
        suffix = [-1] * len(start)
        for i, leaf in enumerate(self.leaves):
            suffix[leaf] = i
        depths, places, order = [], [0] * len(self.leaves), []
        path, below, ahead = [0], [0], begin[:-1]
        while path:
            node, depth = path[-1], below[-1]
            depths.append(depth)
            k = ahead[node]
            if k == begin[node + 1]:
                path.pop()
                below.pop()
                continue
            ahead[node] = k + 1
            child = kids[k]
            i = suffix[child]
            if i >= 0:
                places[i] = len(depths)
                order.append(i)
                depths.append(self.size - i)
            else:
                path.append(child)
                below.append(depth + end[child] - start[child])
        return np.array(depths), np.array(places), np.array(order)


class RangeMin:
    """Minima of ranges of ``values``, each in constant time, for many ranges at once; the tables are linear in size."""

    def __init__(self, values: np.ndarray):
        rows = -(-len(values) // _BLOCK)
        padded = np.full(rows * _BLOCK, np.iinfo(np.int64).max)
        padded[:len(values)] = values
        grid = padded.reshape(rows, _BLOCK)
        self.values = padded
        self.upto = np.minimum.accumulate(grid, axis=1).ravel()
        self.onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= rows:
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of ``values[low:high + 1]``."""
        a, b = low // _BLOCK, high // _BLOCK
        out = np.minimum(self.onward[low], self.upto[high])
        inner = np.flatnonzero(b - a > 1)
        level = np.log2(b[inner] - a[inner] - 1).astype(np.int64)
        for k in np.unique(level):
            of, table = inner[level == k], self.levels[k]
            out[of] = np.minimum(out[of], np.minimum(table[a[of] + 1], table[b[of] - (1 << k)]))
        within = np.flatnonzero(a == b)
        if len(within):
            places = low[within, None] + np.arange(_BLOCK)
            seen = self.values[np.minimum(places, len(self.values) - 1)]
            seen[places > high[within, None]] = np.iinfo(np.int64).max
            out[within] = seen.min(axis=1)
        return out


class Extension:
    """Longest common prefixes of pairs of suffixes: the depth of the lowest common ancestor of their leaves."""

    def __init__(self, depths: np.ndarray, places: np.ndarray):
        self.least, self.places = RangeMin(depths), places

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For different suffixes i and j; the empty one is the last."""
        a, b = self.places[i], self.places[j]
        return self.least(np.minimum(a, b), np.maximum(a, b))
