"""Connected components of an edge table by alternating large and small stars.

First each partition's edges are replaced by a spanning star forest of them. Then each round is two aggregations and two joins on a node; the edges never leave the executors, and a round's
edges are a table in the shared folder, so a lost executor costs one round at most. A hub's edges are
not gathered: its least neighbour comes from an aggregate (combined map-side), is stored, and is joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.plans.lineage import remove, stored


#: Edges of a partition that are contracted at once, edges from which on hubs' partitions are worth splitting, and edges of a group that one task may have.
CHUNK, SPLIT, LARGE = 1 << 20, 1 << 16, 1 << 22


def least_labels(n: int, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The least node of the component of each of the nodes 0..n - 1, for edges (s, d)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[s], label[d])
        new = label.copy()
        np.minimum.at(new, label[s], low)
        np.minimum.at(new, label[d], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes that are not the least of their component: fewer edges, the same components."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = least_labels(len(nodes), ends[: len(a)], ends[len(a) :])
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """A forest of each partition's edges; a task holds a chunk of edges and its partition's nodes. A third column, the same for all nodes of a component, stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        schema, held = None, 0

        def reduced() -> tuple[np.ndarray, ...]:
            columns = [np.concatenate(side) for side in zip(*waiting, strict=True)]
            node, root = forest(*columns[:2])
            if len(columns) == 2:
                return node, root
            nodes, first = np.unique(np.concatenate(columns[:2]), return_index=True)
            return node, root, columns[2][first[np.searchsorted(nodes, node)] % len(columns[2])]

        for b in batches:
            schema = b.schema
            waiting.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
            held += b.num_rows
            if held > CHUNK:
                waiting, held = [reduced()], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(reduced(), schema, strict=True)], schema=schema)

    return edges.mapInArrow(run, edges.schema)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def _with_least(pairs: DataFrame, least: DataFrame, split: bool, others: bool = False) -> tuple[DataFrame, str]:
    """pairs (src, dst) as (dst, the least of src), without loops, and with ``others`` the least neighbours too; a stored table and its path.

    split: the least neighbours are a stored table, so that the join reads both sides as they are shuffled, and adaptive execution splits a hub's partition.
    """
    table, path = stored(least, "least") if split else (least, None)
    moved = pairs.join(table, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    moved = moved.union(table.select("src", F.col("m").alias("dst"))) if others else moved
    out, new = stored(moved.where("src <> dst").distinct(), "star")
    if path:
        remove(pairs.sparkSession, path)
    return out, new


def _large_star(edges: DataFrame, split: bool) -> tuple[DataFrame, str]:
    """Every larger neighbour of a node is linked to the node's least neighbour (or itself)."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return _with_least(both.where("dst > src"), both.groupBy("src").agg(F.least("src", F.min("dst")).alias("m")), split)


def _small_star(edges: DataFrame, split: bool) -> tuple[DataFrame, str]:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    return _with_least(down, down.groupBy("src").agg(F.min("dst").alias("m")), split, others=True)


def connected_components(edges: DataFrame, max_rounds: int = 50, within: str | None = None) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    edges: two columns of one orderable type; direction, repeats, loops and nulls do not matter.
    A node all of whose edges are loops is not returned. within: a third column that edges of one component share; partitions of
    edges are then contracted where they are, and once more dealt by that column, which leaves stars. Only groups that still have more than LARGE edges
    then go through rounds.
    """
    if not within:
        return _by_rounds(_contracted(edges.toDF("src", "dst").where("src <> dst").distinct()), max_rounds)
    near, _ = stored(_contracted(edges.select(*edges.columns[:2], within).toDF("src", "dst", "within").where("src <> dst")), "edges")
    sizes = near.groupBy("within").count().where(F.col("count") > LARGE).select("within")
    large, _ = stored(sizes, "large")  # groups of more than LARGE edges; few, as they share the table's edges
    stars, _ = stored(_contracted(near.join(large, "within", "left_anti").select(near.columns).repartition("within")).select("src", "dst"), "stars")
    out = _with_roots(stars)
    return out if large.isEmpty() else out.union(_by_rounds(near.join(large, "within", "left_semi").select("src", "dst").distinct(), max_rounds))


def _with_roots(stars: DataFrame) -> DataFrame:
    roots = stars.select("dst").distinct()
    return stars.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(roots.select("dst", "dst"))


def _by_rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    spark = edges.sparkSession
    table, path = stored(edges, "edges")
    state = _state(table)
    for _ in range(max_rounds):
        split = state[0] > SPLIT
        large, large_path = _large_star(table, split)
        following, new_path = _small_star(large, split)
        remove(spark, large_path)
        remove(spark, path)
        before, state, table, path = state, _state(following), following, new_path
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return _with_roots(table)
