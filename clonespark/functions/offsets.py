"""The Sift4 string distance (Siderite Zackwehdex, 2014; the variant that counts transpositions), for arrays of pairs in lockstep.

Two places run through a pair's texts. Equal letters under them are common. Unequal ones level the places, to the earlier of the two, and the nearest
letter within ``max_offset`` that is equal to the other text's is looked for, first in the first text. Common letters that are met out of
the order of earlier ones are transpositions. The distance is the longer length, less the common letters, plus the transpositions. No built-in is
equal to it (``levenshtein`` is exact and slower).

One step of the loop is taken for all pairs of a batch that are not done, on numpy arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs in lockstep, and columns of the table of open matches.
PAIRS, OPEN = 4096, 8


class _Matches:
    """By pair, the common letters that a later one may cross: places in both texts and whether it was counted, oldest first."""

    def __init__(self, pairs: int) -> None:
        self.i, self.j = np.zeros((pairs, OPEN), np.int64), np.zeros((pairs, OPEN), np.int64)
        self.counted = np.zeros((pairs, OPEN), bool)
        self.n = np.zeros(pairs, np.int64)
        self.transpositions = np.zeros(pairs, np.int64)

    def add(self, pair: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """A common letter at (i, j) of each of the pairs."""
        if self.n.max() == self.i.shape[1]:
            wider = lambda x: np.concatenate([x, np.zeros_like(x)], 1)
            self.i, self.j, self.counted = wider(self.i), wider(self.j), wider(self.counted)
        width = int(self.n[pair].max()) + 1
        a, b, counted = self.i[pair, :width], self.j[pair, :width], self.counted[pair, :width]
        there = np.arange(width) < self.n[pair][:, None]
        crossed = there & ((i[:, None] <= a) | (j[:, None] <= b))
        at = np.where(crossed.any(1), crossed.argmax(1), width)  # the first that is crossed
        rows = np.flatnonzero(at < width)
        k = at[rows]
        farther = np.zeros(len(pair), bool)
        farther[rows] = np.abs(j[rows] - i[rows]) >= np.abs(b[rows, k] - a[rows, k])
        self.transpositions[pair[rows]] += farther[rows] | ~counted[rows, k]
        counted[rows, k] |= ~farther[rows]
        # those before it that both places have left behind are closed
        stays = there & ((np.arange(width) >= at[:, None]) | ~((i[:, None] > b) & (j[:, None] > a)))
        order = np.argsort(~stays, axis=1, kind="stable")
        n = stays.sum(1)
        for table, own, new in ((self.i, a, i), (self.j, b, j), (self.counted, counted, farther)):
            own = np.take_along_axis(own, order, 1)
            own[np.arange(len(pair)), n] = new
            table[pair, :width] = own
        self.n[pair] = n + 1


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, one row for each text, padded; lengths)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(sizes.max(initial=0)) + 1), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    return out, sizes


def sift4(first: list[str], second: list[str], max_offset: int = 5) -> np.ndarray:
    """The distances of pairs of texts."""
    (a, n), (b, m) = _letters(first), _letters(second)
    i, j, common, matches = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), _Matches(len(n))
    live = np.flatnonzero((n > 0) & (m > 0))
    while len(live):
        same = a[live, i[live]] == b[live, j[live]]
        hit, miss = live[same], live[~same]
        if len(hit):
            common[hit] += 1
            matches.add(hit, i[hit], j[hit])
        i[miss] = j[miss] = np.minimum(i[miss], j[miss])
        for step in range(max_offset if len(miss) else 0):
            p, q = i[miss], j[miss]
            in_first = (p + step < n[miss]) & (a[miss, np.minimum(p + step, n[miss] - 1)] == b[miss, q])
            in_second = ~in_first & (q + step < m[miss]) & (a[miss, p] == b[miss, np.minimum(q + step, m[miss] - 1)])
            i[miss[in_first]] += step - 1
            j[miss[in_first]] -= 1
            i[miss[in_second]] -= 1
            j[miss[in_second]] += step - 1
            miss = miss[~(in_first | in_second)]
        i[live] += 1
        j[live] += 1
        ended = live[(i[live] >= n[live]) | (j[live] >= m[live])]
        i[ended] = j[ended] = np.minimum(i[ended], j[ended])
        live = live[(i[live] < n[live]) & (j[live] < m[live])]
    return np.maximum(n, m) - common + matches.transpositions


def offset_distance(a: str, b: str, max_offset: int = 5) -> int:
    return int(sift4([a or ""], [b or ""], max_offset)[0])


def offset_distance_udf(a: Column, b: Column, max_offset: int = 5) -> Column:
    """The distance of two text columns; a null text is empty."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = x.fillna("").tolist(), y.fillna("").tolist()
        return pd.Series(np.concatenate([np.zeros(0, np.int64), *(sift4(x[k : k + PAIRS], y[k : k + PAIRS], max_offset) for k in range(0, len(x), PAIRS))]).astype("int32"))

    return run(a, b)
