"""Which precise clusters of a sensitive cluster hang together by the mutation statistic.

The statistic grows with the CDR3 distance, so two alignments with their mutation counts have a largest distance at which their rows are linked, and a pair of rows costs a comparison of
CDR3s and a look-up. A sensitive cluster's rows lie in one task, or, if they are more than ``LOCAL``, in blocks, each of which meets each; a task returns no pairs but a forest of the precise clusters that it
linked. Rows of the largest component so far are compared with rows outside it only. Small clusters are taken together, pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.operators.components import forest, least_labels
from clonespark.operators.pieces import distances, planes

#: Rows of a sensitive cluster that one task may have (twice as many, if it has more), rows of those that are compared pair by pair, pairs at once, and cells of a table at once.
LOCAL, SMALL, CHUNK, CELLS, STEPS = 1 << 16, 256, 1 << 20, 1 << 18, 32
#: Stands for the end of shorter texts; what one text has beyond the other's end differs.
END = "\U0010ffff"
SLACK = 1e-9


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text among the distinct ones, and these ones' bits."""
    found = column.combine_chunks().dictionary_encode()
    texts = found.dictionary.to_pylist()
    n = max(1, max(map(len, texts)))
    return found.indices.to_numpy().astype(np.int64), planes([t.ljust(n, END) for t in texts], n)


def _z(n, differ, n1, n2, cdr3_length, length):
    """``mutations.statistic`` of arrays, with the same operations in the same order."""
    expected = cdr3_length / float(length) * (differ + 1)
    shared = n1 * n2 / float(length)
    return (n - expected) / np.sqrt(expected * (cdr3_length + length) / length) - ((n1 + n2 - differ) / 2.0 - shared) / np.sqrt(shared)


def farthest(differ, n1, n2, t: float, cdr3_length: int, length: int) -> np.ndarray:
    """The largest CDR3 distances at which the statistic is no more than t; -1 if there is none."""
    expected = cdr3_length / float(length) * (differ + 1)
    at_zero = _z(0, differ, n1, n2, cdr3_length, length)
    guess = np.clip(np.floor((t - at_zero) * np.sqrt(expected * (cdr3_length + length) / length)), -1, cdr3_length)
    below = (guess >= 0) & (_z(guess, differ, n1, n2, cdr3_length, length) > t)
    above = (guess < cdr3_length) & (_z(guess + 1, differ, n1, n2, cdr3_length, length) <= t)
    return (guess - below + above).astype(np.int16)


def _cross(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters in which each of the texts a differs from each of b."""
    total = np.zeros((len(a), len(b)), np.int16)
    for word in bits:
        differ = word[0][a][:, None] ^ word[0][b]
        for plane in word[1:]:
            differ |= plane[a][:, None] ^ plane[b]
        total += np.bitwise_count(differ)
    return total


def _kinds(alt: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each row's alignment and mutation count among the distinct ones, and these."""
    both, kind = np.unique(np.stack([alt, m]), axis=1, return_inverse=True)
    return kind.reshape(-1), both[0], both[1].astype(float)


def _large(cdr, alt, cdr_bits, alt_bits, node, m, second, t: float, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes linked among the rows of one cluster, or across its two blocks."""
    names, node = np.unique(node, return_inverse=True)
    kind, kind_alt, kind_m = _kinds(alt, m)
    _, first = np.unique(np.stack([second, node, cdr, kind]), axis=1, return_index=True)
    first = first[np.argsort(kind[first], kind="stable")]  # few kinds at a time
    rows, columns = (first, first) if not second.any() else (first[~second[first]], first[second[first]])
    label, same, done = np.arange(len(names)), not second.any(), 0
    while done < len(rows):
        step = max(1, CELLS // len(columns))
        some, right = rows[done : done + step * STEPS], columns[done:] if same else columns
        now = label[node[first]]
        largest = np.bincount(now).argmax()
        if (now == largest).all():
            break
        inside = label[node[some]] == largest
        ends = []
        for side, others in ((some[inside], right[label[node[right]] != largest]), (some[~inside], right)):
            if not len(others):
                continue
            step = max(1, CELLS // len(others))
            right_kinds, place = np.unique(kind[others], return_inverse=True)
            for at in range(0, len(side), step):
                own = side[at : at + step]
                left_kinds, which = np.unique(kind[own], return_inverse=True)
                differ = _cross(alt_bits, kind_alt[left_kinds], kind_alt[right_kinds])
                most = farthest(differ, kind_m[left_kinds][:, None], kind_m[right_kinds], t + SLACK, n, length)
                x, y = np.nonzero(_cross(cdr_bits, cdr[own], cdr[others]) <= np.take(most, place, axis=1)[which])
                a, b = label[node[own[x]]], label[node[others[y]]]
                ends.append(np.unique(np.stack([a, b])[:, a != b], axis=1))
        found = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
        label = least_labels(len(names), *found)[label]
        done += len(some)
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _small(unit, cdr, alt, cdr_bits, alt_bits, node, m, t, n, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of linked nodes of clusters of few rows each, which follow each other."""
    at = np.arange(len(unit))
    before = at - np.maximum.accumulate(np.where(np.concatenate([[True], unit[1:] != unit[:-1]]), at, 0))
    ends, start = np.cumsum(before), 0
    while start < len(unit):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
        k = before[start:stop]
        i = np.repeat(np.arange(start, stop), k)
        j = i - 1 - (np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k))
        i, j = (x[node[i] != node[j]] for x in (i, j))
        z = _z(distances(cdr_bits, cdr[i], cdr[j]), distances(alt_bits, alt[i], alt[j]), m[i].astype(float), m[j].astype(float), n[i], length)
        near = z <= t[i] + SLACK
        yield node[i[near]], node[j[near]]
        start = stop


def _linked(rows: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Forests of the nodes of whole clusters (or pairs of blocks), which follow each other."""
    group, pair, node, second, m, n, t = (rows.column(c).to_numpy() for c in ("group", "pair", "node", "second", "mutation_count", "cdr3_length", "xy_threshold"))
    (cdr, cdr_bits), (alt, alt_bits) = _coded(rows.column("cdr3")), _coded(rows.column("alt_sequence_alignment"))
    start = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (pair[1:] != pair[:-1])]))
    size = np.diff(np.concatenate([start, [len(group)]]))
    unit = np.repeat(np.arange(len(start)), size)
    few = size <= SMALL
    few[unit[pair > 0]] = False
    found = []
    at = np.flatnonzero(few[unit])
    if len(at):
        found += _small(unit[at], cdr[at], alt[at], cdr_bits, alt_bits, node[at], m[at], t[at], n[at], length)
    for u in np.flatnonzero(~few):
        s = slice(start[u], start[u] + size[u])
        found.append(_large(cdr[s], alt[s], cdr_bits, alt_bits, node[s], m[s], second[s], float(t[s][0]), int(n[s][0]), length))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(a):
        order = np.argsort(node)
        child, root = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(root), pa.array(group[order[np.searchsorted(node[order], child)]])], ["node_a", "node_b", "group"])


def cluster_links(rows: DataFrame, length: int) -> DataFrame:
    """(node_a, node_b, group): links that connect the nodes of a group as all pairs of its rows do whose statistic is no more than the threshold.

    rows: group, node, cdr3, alt_sequence_alignment, mutation_count, cdr3_length, xy_threshold (the last two are a group's). Rows without mutations take no part.
    """
    rows = rows.where("mutation_count > 0").select("group", "node", "cdr3", "alt_sequence_alignment", "mutation_count", "cdr3_length", "xy_threshold")
    large = rows.groupBy("group").agg(F.count("*").alias("_n")).where(F.col("_n") > LOCAL)
    rows = rows.join(large, "group", "left").withColumn("_k", F.coalesce(F.ceil(F.col("_n") / LOCAL), F.lit(1)).cast("int"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("cdr3", "node"), F.col("_k")).cast("int"))
    # a block is the first one of its pairs with itself and later ones, and the second one of those with earlier ones; 0 stands for the only block
    number = lambda x, y: F.when(F.col("_k") == 1, 0).otherwise(1 + x * F.col("_k") + y)
    to = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda k: F.struct(number(F.least("_own", k), F.greatest("_own", k)).alias("pair"), (k < F.col("_own")).alias("second")))
    sent = rows.withColumn("_to", F.explode(to)).select("group", "_to.pair", "_to.second", *[c for c in rows.columns if c[0] != "_" and c != "group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            waiting.append(b)
            held += b.num_rows
            if held >= LOCAL:
                table = pa.Table.from_batches(waiting)
                group, pair = (table.column(c).to_numpy() for c in ("group", "pair"))
                last = int(np.argmax((group == group[-1]) & (pair == pair[-1])))  # the last cluster may go on in the next batch
                if last:
                    yield from _linked(table.slice(0, last), length)
                waiting = table.slice(last).combine_chunks().to_batches()
                held = table.num_rows - last
        if held:
            yield from _linked(pa.Table.from_batches(waiting), length)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "group", "pair").sortWithinPartitions("group", "pair").mapInArrow(run, "node_a long, node_b long, group long")
