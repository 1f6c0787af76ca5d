"""All pairs of texts within a distance, by walking a trie with an error budget: for thresholds at which texts share too little to be joined on.

A group's texts are numbered, and each run of ``LEAVES`` numbers makes a trie in flat arrays: for every depth the letters of its nodes, and where each node's children
begin. If numbers follow the texts' order, a run's texts begin alike, so its trie is narrow at the top. Texts are sent to all tries of their group
and walk them in lockstep: a batch of (text, node, errors) goes down one letter at a time, and what has more errors than its text allows is left. A task
holds one trie and one batch, as its rows come sorted with the trie's first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a trie, and (text, node) pairs that walk at once.
LEAVES, WALKERS = 1024, 1 << 20
LINK = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("w", pa.int32()), ("within", pa.int64())])


def letters(texts: list[str]) -> np.ndarray:
    """A row of code points for each text, zeros beyond its end."""
    width = max(map(len, texts), default=0)
    return np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width)


class Trie:
    """A trie of rows of letters; leaves are the rows, by ``ids``."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
        self.ids, rows = ids[order], rows[order]
        fresh = np.zeros(len(rows), bool)
        fresh[:1] = True
        starts = np.flatnonzero(fresh)
        self.children, self.letter = [], []
        for depth in range(rows.shape[1] + 1):
            # one leaf a row, also for rows that are equal
            fresh = np.ones(len(rows), bool) if depth == rows.shape[1] else fresh | np.concatenate([[True], rows[1:, depth] != rows[:-1, depth]])
            new = np.flatnonzero(fresh)
            self.children.append(np.append(np.searchsorted(new, starts), len(new)))
            self.letter.append(rows[new, depth] if depth < rows.shape[1] else None)
            starts = new

    def near(self, queries: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, leaf's id, errors) for all leaves with no more errors than the query's ``most``, by batches."""
        width = max(len(self.letter) - 1, queries.shape[1])
        step = max(1, WALKERS // max(len(self.ids), 1))
        for at in range(0, len(queries), step):
            q = np.arange(at, min(at + step, len(queries)))
            node, errors = np.zeros(len(q), np.int64), np.zeros(len(q), np.int32)
            for depth, (children, letter) in enumerate(zip(self.children, self.letter, strict=True)):
                first = children[node]
                count = children[node + 1] - first
                each = np.repeat(np.arange(len(q)), count)
                node = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + first[each]
                q, errors = q[each], errors[each]
                if letter is None:
                    errors = errors + sum(((queries[q, k] != 0) for k in range(depth, width)), np.zeros(len(q), np.int32)).astype(np.int32)
                else:
                    errors = errors + (letter[node] != (queries[q, depth] if depth < queries.shape[1] else 0))
                kept = errors <= most[q]
                q, node, errors = q[kept], node[kept], errors[kept].astype(np.int32)
            yield q, self.ids[node], errors


def trie_links(nodes: DataFrame) -> DataFrame:
    """(src, dst, w, within): pairs of nodes (node, within, text, t) of a group whose texts differ in w letters, at most t; src < dst.

    Nodes are longs, no less than their group's ``within``, best in the texts' order; t is the same for a group. Where there is a boolean column ``asked``, pairs without an asked node are left out.
    """
    block = F.floor((F.col("node") - F.col("within")) / LEAVES).cast("int")
    asked = F.col("asked") if "asked" in nodes.columns else F.lit(True)
    rows = nodes.select("within", block.alias("block"), "node", "text", "t", asked.alias("asked"))
    blocks = rows.select("within", "block").distinct()  # a row for each LEAVES nodes
    sent = rows.where("asked").drop("block").join(blocks, "within").select(rows.columns)
    both = rows.withColumn("kind", F.lit(0)).unionByName(sent.withColumn("kind", F.lit(1))).select("within", "block", "kind", "node", "text", "t", "asked")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, trie, also = None, [], None, None
        for b in batches:
            within, blocks, kind, node = (b.column(k).to_numpy() for k in range(4))
            cuts = np.flatnonzero((np.diff(within) != 0) | (np.diff(blocks) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if (within[i], blocks[i]) != key:
                    key, waiting, trie = (within[i], blocks[i]), [], None
                texts, marks = b.column(4).slice(i, j - i).to_pylist(), b.column(6).slice(i, j - i).to_numpy(zero_copy_only=False)
                if kind[i] == 0:
                    waiting.append((texts, node[i:j], marks))
                    continue
                if trie is None:
                    ids = np.concatenate([w[1] for w in waiting])
                    trie, also = Trie(letters([t for w in waiting for t in w[0]]), ids), np.sort(ids[np.concatenate([w[2] for w in waiting])])
                for q, leaf, errors in trie.near(letters(texts), b.column(5).to_numpy()[i:j]):
                    src = node[i:j][q]
                    # a pair of two asked nodes is found from both
                    own = (src < leaf) | ((src > leaf) & ~np.isin(leaf, also))
                    src, leaf, errors = src[own], leaf[own], errors[own]
                    if len(src):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(src, leaf)), pa.array(np.maximum(src, leaf)), pa.array(errors, pa.int32()), pa.array(np.full(len(src), key[0], np.int64))], schema=LINK)

    sorted_ = both.repartition("within", "block").sortWithinPartitions("within", "block", "kind", "node")
    return sorted_.mapInArrow(walk, "src long, dst long, w int, within long")
