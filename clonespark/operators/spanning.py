"""Minimum spanning forests of weighted edge tables: the trees of single linkage, cut at any thresholds.

A spanning forest of least weights has, for every threshold, the same components among its edges up to the threshold as the whole edge table has. So one
pass over the edges serves all thresholds, and a cut reads no more edges than there are nodes.

An edge that is the heaviest of a circle is in no least forest (edges of equal weight are told apart by their ends). So every partition first keeps its own
edges' forest, which is all that is shuffled; then groups (edges that share a column, as all edges of a component do) are dealt to tasks, whose forests are those of
their groups. Groups that have more than ``LARGE`` edges left are split instead: in Boruvka's rounds every node takes its least edge, components of these are contracted
by joins on stored tables, and of the edges between two components the least stays, until none is left; there are as many rounds as the logarithm of the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.operators.components import connected_components, least_labels
from clonespark.plans.lineage import remove, stored

#: Edges of a partition that are reduced at once, and edges of a group that one task may have.
CHUNK, LARGE = 1 << 20, 1 << 22


def least_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of the least spanning forest; ties go to the lesser ends."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.lexsort((b, a, w))
    s, d = ends[: len(a)][order], ends[len(a) :][order]
    label, live, taken = np.arange(len(nodes)), np.arange(len(a)), [np.zeros(0, np.int64)]
    while len(live):
        x, y = label[s[live]], label[d[live]]
        live, x, y = live[x != y], x[x != y], y[x != y]
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        taken.append(np.unique(best[best < len(a)]))
        label = least_labels(len(nodes), label[s[taken[-1]]], label[d[taken[-1]]])[label]
    return order[np.concatenate(taken)]


def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of edges (src, dst, w, ...) that come in batches; what is held is a chunk of edges, and their nodes' forest."""
    waiting: list[pa.RecordBatch] = []
    held, limit = 0, CHUNK

    def forest() -> pa.RecordBatch:
        rows = pa.Table.from_batches(waiting).combine_chunks()
        own = least_forest(*(rows.column(c).to_numpy() for c in ("src", "dst", "w")))
        return rows.take(pa.array(np.sort(own))).combine_chunks().to_batches()[0]

    for b in batches:
        if b.num_rows:
            waiting.append(b)
            held += b.num_rows
            if held > limit:
                waiting = [forest()]
                held = waiting[0].num_rows
                limit = max(CHUNK, 2 * held)
    if waiting:
        yield forest()


def _reduced(edges: DataFrame) -> DataFrame:
    """The forest of each partition's edges."""
    return edges.mapInArrow(reduced, edges.schema)


def _rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Boruvka's rounds over edges (src, dst, w, within): the forest's edges."""
    spark = edges.sparkSession
    left, path = stored(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("w", "src", "dst", "within").alias("e")), "edges")
    found = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        # the edge's present ends go along, as they follow from the edge
        both = left.select(F.col("a").alias("node"), "e", "a", "b").union(left.select("b", "e", "a", "b"))
        best = both.groupBy("node").agg(F.min(F.struct("e", "a", "b")).alias("x"))
        chosen, _ = stored(best.select("x.e", "x.a", "x.b").distinct(), "chosen")
        found = chosen.select("e.*") if found is None else found.union(chosen.select("e.*"))
        roots, _ = stored(connected_components(chosen.select("a", "b")), "roots")
        moved = left.join(roots.toDF("a", "_a"), "a").join(roots.toDF("b", "_b"), "b").where("_a <> _b")
        following, new = stored(moved.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("e").alias("e")), "edges")
        remove(spark, path)
        left, path = following, new
    else:
        raise RuntimeError(f"the forest is not complete after {max_rounds} rounds")
    remove(spark, path)
    return edges.limit(0) if found is None else found.select(edges.columns)


def minimum_forest(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst, w, within), stored: the edges of a minimum spanning forest of edges with these columns (nodes are longs, src < dst).

    within: a long that edges of one component share. Of edges that repeat a pair the least counts; loops and nulls do not.
    """
    slim = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w", "within").where("src < dst and w is not null")
    near, _ = stored(_reduced(slim), "near")
    large, _ = stored(near.groupBy("within").count().where(F.col("count") > LARGE).select("within"), "large")  # few, as they share the table's edges
    out = _reduced(near.join(large, "within", "left_anti").select(slim.columns).repartition("within"))
    if not large.isEmpty():
        out = out.union(_rounds(near.join(large, "within", "left_semi").select(slim.columns), max_rounds))
    return stored(out, "forest")[0]


def cut(forest: DataFrame, thresholds: DataFrame, columns: list[str]) -> DataFrame:
    """(node, and a root for each column), stored: the least nodes of the components at several thresholds.

    thresholds: (within, columns); edges with w up to a column's value are kept for it (null: none). Nodes without any such edge are not returned; a null root is the node itself.
    """
    k = len(columns)
    place = F.explode(F.array_compact(F.array(*[F.when(F.col("w") <= F.col(c), F.lit(i)) for i, c in enumerate(columns)])))
    each = forest.join(thresholds.select("within", *columns), "within").select("src", "dst", "within", place.alias("_k"))
    # one pass over all thresholds: a node is there once for each
    at = lambda c: F.col(c) * k + F.col("_k")
    roots = connected_components(each.select(at("src").alias("a"), at("dst").alias("b"), at("within").alias("group")), within="group")
    spread = roots.select(F.expr(f"node div {k}").alias("node"), F.pmod("node", F.lit(k)).alias("_k"), F.expr(f"root div {k}").alias("root"))
    wide = spread.groupBy("node").agg(*[F.max(F.when(F.col("_k") == i, F.col("root"))).alias(c) for i, c in enumerate(columns)])
    return stored(wide, "cut")[0]
