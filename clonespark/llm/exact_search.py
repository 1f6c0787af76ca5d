"""Exact search for the largest inner products by elimination with a pivot table.

|q - x|^2 = |q|^2 + |x|^2 - 2 q.x, so a lower bound on the distance gives an upper bound on the product. The distances from all rows
to ``PIVOTS`` pivots are computed once and kept as a table. One pivot p bounds |q - x| from below by | |q - p| - |x - p| |, and a candidate's
bound is the largest one over all pivots. The candidates of the best bounds are evaluated first; those whose bound cannot reach the k-th best product
are eliminated. The rest gets the bound that the distances to the first ``SPAN`` pivots imply together (Connor et al., 2017): they fix a row's
place a in the pivots' span and its height h above it, and |q - x|^2 >= |a_q - a_x|^2 + (h_q - h_x)^2. What that leaves is evaluated in
the order of the bounds, and the search stops as soon as the next one is below the k-th best product so far, so the result is exact, ties included.

Pivots are chosen farthest first from a bounded sample (``SAMPLE`` rows); the choice changes the speed alone. Products of integers are exact:
in doubles where no product of two norms reaches 2^53, and otherwise in whole numbers without a bound (a result beyond a
long's range is returned as the nearest long). See vectors.py for rows that take no part, ties and repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.llm import vectors as V

#: Pivots of the table, and those whose span is used; rows that they are chosen from, candidates that are evaluated first, and numbers of bounds at once.
PIVOTS, SPAN, SAMPLE, FIRST, CELLS = 256, 49, 2048, 64, 1 << 18
#: Vectors with components from here on have no bound, as their squares are beyond doubles; all their products are evaluated.
HUGE = 1e100


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """At most n rows of x, each as far as can be from those before it; none is within rounding of another."""
    x = x[np.abs(x).max(1, initial=0) < HUGE]
    if not len(x):
        return x
    chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < n and near.max() > 1e-9 * max(1.0, (x**2).sum(1).max()):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


class PivotTable:
    """Distances to the pivots, and places in the span of the first of them, from these distances alone."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.all, pivots = pivots, pivots[:SPAN]
        keep, basis = [], np.zeros((0, pivots.shape[1]))
        arms = pivots[1:] - pivots[:1]
        for i, arm in enumerate(arms):  # pivots that lie in the span of those before them add nothing
            rest = arm - (basis @ arm) @ basis
            rest -= (basis @ rest) @ basis
            if (rest @ rest) > 1e-2 * (arm @ arm):
                keep.append(i)
                basis = np.concatenate([basis, rest[None] / np.sqrt(rest @ rest)])
        self.pivots = pivots[[0, *(i + 1 for i in keep)]]
        arms = arms[keep]
        self._arms, self._solve = (arms**2).sum(1), np.linalg.inv(arms @ basis.T).T if len(keep) else np.zeros((0, 0))

    @staticmethod
    def squared(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Squared distances, (rows, pivots)."""
        return np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distances to all pivots, (pivots, rows)."""
        return np.ascontiguousarray(np.sqrt(self.squared(x, self.all)).T)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the span, heights above it) of rows."""
        d = self.squared(x, self.pivots)
        along = (d[:, :1] - d[:, 1:] + self._arms) / 2  # products with the arms, by the law of cosines
        at = along @ self._solve
        return at, np.sqrt(np.maximum(d[:, 0] - (at**2).sum(1), 0))


class Index:
    """A block's rows with their distances and places; counts the candidates that the table eliminates, those that get the second bound, and the products."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, x: np.ndarray, pivots: np.ndarray, whole: bool) -> None:
        self.ids, self.keys, self.x, self.whole = ids, keys, x, whole
        self.table = PivotTable(pivots if pivots.shape[1:] == x.shape[1:] and len(pivots) else np.zeros((1, x.shape[1])))
        self.huge = np.abs(x).max(1, initial=0) >= HUGE
        x = np.where(self.huge[:, None], 0, x) if self.huge.any() else x
        self.apart = self.table.distances(x)
        self.at, self.height = self.table.places(x)
        self.squares = np.where(self.huge, np.inf, (x**2).sum(1))
        self.reach = (self.table.all**2).sum(1).max()
        self.eliminated = self.second = self.evaluated = 0

    def _slack(self, rows: np.ndarray | slice, own: float) -> np.ndarray:
        """Room for rounding."""
        return 1e-7 * (self.squares[rows] + own + self.reach + 1)

    def table_bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds on the products of a query with all rows, by the largest difference of their distances to one pivot."""
        if np.abs(q).max(initial=0) >= HUGE:
            return np.full(len(self.x), np.inf)
        own, apart = float(q @ q), self.table.distances(q[None])
        least, step = np.empty(len(self.x)), max(1, CELLS // len(apart))
        for i in range(0, len(least), step):
            gap = self.apart[:, i : i + step] - apart
            np.maximum(gap.max(0), -gap.min(0), out=least[i : i + step])
        return (self.squares + own - least**2) / 2 + self._slack(slice(None), own)

    def span_bounds(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Upper bounds on the products of a query with some rows, by the places in the pivots' span."""
        if np.abs(q).max(initial=0) >= HUGE:
            return np.full(len(rows), np.inf)
        (at,), (height,) = self.table.places(q[None])
        own, a, h = float(q @ q), self.at[rows], self.height[rows]
        # (|q|^2 + |x|^2 - |a_q - a_x|^2 - (h_q - h_x)^2) / 2, with the squares multiplied out
        return (self.squares[rows] - (a**2).sum(1) - h**2 + own - at @ at - height**2) / 2 + a @ at + height * h + self._slack(rows, own)

    def products(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.evaluated += len(rows)
        with np.errstate(over="ignore"):
            if not self.whole or (len(rows) and np.sqrt(self.squares[rows].max()) * np.sqrt(q @ q) < 2.0**53):
                return self.x[rows] @ q
        return np.array([sum(int(a) * int(b) for a, b in zip(self.x[i].tolist(), q.tolist(), strict=True)) for i in rows.tolist()], object)

    def top(self, q: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, keys, products) of the k largest products, ties to smaller ids; the rows with the id ``own`` are left out."""
        rows = np.flatnonzero(self.ids != own)
        bound = self.table_bounds(q)[rows]
        best, scores = rows[:0], np.zeros(0)
        if len(rows) > FIRST:  # the best bounds first; then what they leave
            some = np.argpartition(bound, len(bound) - FIRST)[len(bound) - FIRST :]
            best, scores = self._best(rows[some], self.products(rows[some], q), k)
            left = bound >= self._least(scores, k)
            self.eliminated += int(len(rows) - np.count_nonzero(left))
            left[some] = False
            rows, bound = rows[left], bound[left]
            self.second += len(rows)
            bound = np.minimum(bound, self.span_bounds(q, rows))
        order = np.argsort(-bound, kind="stable")
        at, step = 0, FIRST
        while at < len(order) and bound[order[at]] >= self._least(scores, k):
            some = rows[order[at : at + step]]
            best, scores = self._best(np.concatenate([best, some]), np.concatenate([scores, self.products(some, q)]), k)
            at, step = at + len(some), step * 2
        return self.ids[best], self.keys[best], scores

    @staticmethod
    def _least(scores: np.ndarray, k: int) -> float:
        """What the next bound has to reach."""
        least = float(np.clip(scores[-1], -HUGE, HUGE)) if len(scores) >= k else -np.inf
        return least - 1e-12 * abs(least) if np.isfinite(least) else least

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if scores.dtype == object:
            top = np.array(sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]], self.keys[rows[i]]))[:k], np.int64)
        else:
            top = np.lexsort((self.keys[rows], self.ids[rows], -scores))[:k]
        return rows[top], scores[top]


def _longs(scores: np.ndarray) -> np.ndarray:
    most = (1 << 63) - 1
    return np.array([max(-most, min(most, int(s))) for s in scores.tolist()], np.int64)


def largest_products(table: DataFrame, queries: str, k: int, scale: float | None = None, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows where ``queries`` (SQL over vec_id) holds, the k other rows of the largest inner product.

    scale: components become floor(scale * x), and products (long) are exact; without it they are doubles.
    """
    rows, dtype = V.usable(table, scale)
    chosen = farthest_first(V.sample(rows, SAMPLE, dtype), pivots)
    n, _ = V.blocks_of(rows)
    whole = scale is not None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, V.BATCH) for i in range(0, batch.num_rows, V.BATCH)):
                message = V.pack(b.column(0), b.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([message] * n, pa.binary())], names=["to", "message"])

    def meet(rows: pa.Table, sent: pa.Table) -> list[tuple]:
        made = {d: Index(i, key, x, chosen, whole) for d, (i, key, _, x) in V.by_dimension(np.asarray(rows["vec_id"]), rows["v"].combine_chunks(), np.zeros(rows.num_rows, np.int64), dtype).items()}
        found = []
        for message in sent["message"]:
            ids, vectors = V.unpack(message)
            for d, (own, _, _, q) in V.by_dimension(np.asarray(ids), vectors, np.zeros(len(ids), np.int64), dtype).items():
                if d in made:
                    index = made[d]
                    for one, vector in zip(own.tolist(), q, strict=True):
                        where, keys, scores = index.top(vector, k, one)
                        found.append((one, where, keys, _longs(scores) if whole else scores))
        return found

    to = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int").alias("to")
    sent = V.single(rows.where(queries)).mapInArrow(send, "to int, message binary")
    return V.ranked(V.met(rows.select(to, "vec_id", "v"), sent, n, meet, "long" if whole else "double"), k, "desc")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "pmod(vec_id, 50) = 0", 5, scale=256.0)


#: DuckDB SQL of op6_exact_topk.
ORACLE = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as int) rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 5
"""
