"""The least forests of the links of classes that a task can hold.

Texts of one length are dealt by class, so a text is shuffled once whatever its threshold is. In a task, texts at most t letters apart that are cut into t + r pieces
agree in r of them, so the texts are sorted by every choice of r pieces, and those that agree are compared. r is what the number of texts makes cheapest; without pieces (r = 0) all texts
of a class are compared, and so they are where pieces are so frequent that they would make more pairs than that. A task holds at most ``LOCAL`` texts of a class, some classes of together
``CHUNK`` texts, and ``CHUNK`` pairs at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from clonespark.operators.components import least_labels
from clonespark.operators.spanning import least_forest

#: Texts of a class that one task may have, and texts and pairs that it takes at once.
LOCAL, CHUNK = 1 << 16, 1 << 20
#: The most choices of pieces, and what a text costs in a sort against a pair that is compared.
CHOICES, SORTED = 500, 4


def planes(texts: list[str], n: int) -> np.ndarray:
    """Bits of the letters of texts of n letters, as longs of 64 letters: (words, bits of a letter, texts)."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), n)
    used = np.bincount(letters.ravel(), minlength=1) > 0  # a table of code points, so that letters need not be sorted
    codes = (np.cumsum(used) - 1).astype(np.uint64)[letters]
    out = np.zeros((-(-n // 64), max(1, int(used.sum() - 1).bit_length()), len(texts)), np.uint64)
    for i in range(n):
        for k in range(out.shape[1]):
            out[i // 64, k] |= ((codes[:, i] >> np.uint64(k)) & np.uint64(1)) << np.uint64(i % 64)
    return out


def differing(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """For each word a bit for each letter in which the texts a and b (places) differ."""
    for word in bits:
        differ = word[0][a] ^ word[0][b]
        for plane in word[1:]:
            differ |= plane[a] ^ plane[b]
        yield differ


def distances(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters in which the texts a and b (places) differ."""
    total = np.zeros(len(a), np.int32)
    for differ in differing(bits, a, b):
        total += np.bitwise_count(differ)
    return total


def _mask(places: list[int], word: int) -> np.uint64:
    return np.uint64(sum(1 << (i - 64 * word) for i in places if i // 64 == word))


def _first(bits: np.ndarray, a: np.ndarray, b: np.ndarray, pieces: list[list[int]], choice: tuple[int, ...]) -> np.ndarray:
    """Whether the choice is the first of all whose pieces agree in the texts a and b, so that a pair that many choices find counts once."""
    first = np.ones(len(a), bool)
    differ = list(differing(bits, a, b))
    for k in range(max(choice, default=-1) + 1):
        unlike = np.zeros(len(a), bool)
        for w, word in enumerate(differ):
            unlike |= (word & _mask(pieces[k], w)) != 0
        first &= ~unlike if k in choice else unlike
    return first


def _agreeing(bits: np.ndarray, group: np.ndarray, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in an order in which those that agree in a group and at the places follow each other, and how many that agree stand before each; by hashes, so that a few others may be among them."""
    mixed = group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for w, word in enumerate(bits):
        mask = _mask(places, w)
        for plane in word if mask else ():
            mixed = (mixed ^ (mixed >> np.uint64(29)) ^ (plane & mask)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(mixed)  # those that agree may stand in any order
    key, at = mixed[order], np.arange(len(order))
    first = np.concatenate([[True], key[1:] != key[:-1]])
    return order, at - np.maximum.accumulate(np.where(first, at, 0))


def _choices(n: int, t: int, sizes: np.ndarray) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """The places of the pieces, and the choices of them by which texts are sorted: of those with 0, 1, 2, ... pieces the cheapest, if letters were four and random."""
    pairs, best = float((sizes.astype(float) ** 2).sum() / 2), (np.inf, 0)
    for r in range(0, n - t + 1):
        if comb(t + r, r) > CHOICES:
            break
        cost = comb(t + r, r) * (sizes.sum() * SORTED + pairs * 4.0 ** -(r * n // (t + r) if r else 0))
        best = min(best, (cost, r))
    r = best[1]
    pieces = [list(range(i * n // (t + r), (i + 1) * n // (t + r))) for i in range(t + r)]
    return pieces, list(combinations(range(t + r), r))


def forest_of(texts: list[str], node: np.ndarray, group: np.ndarray, t: int) -> tuple[np.ndarray, ...]:
    """(src, dst, w) of the least forest of the links of texts of one length: pairs of a group at most t letters apart."""
    n = len(texts[0])
    bits = planes(texts, n)
    sizes = np.unique(group, return_counts=True)[1]
    every = int((sizes * (sizes - 1) // 2).sum())
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    seen, (pieces, waiting) = 0, _choices(n, min(t, n), sizes)
    while waiting:
        choice = waiting.pop()
        order, before = _agreeing(bits, group, sum((pieces[k] for k in choice), []))
        ends = np.cumsum(before)
        seen += int(ends[-1])
        if waiting and seen > every:  # pieces are too frequent: all pairs instead
            waiting = [()]
            continue
        start = 0
        while start < len(order):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
            k = before[start:stop]
            later = np.repeat(np.arange(start, stop), k)
            earlier = later - 1 - (np.arange(len(later)) - np.repeat(np.cumsum(k) - k, k))
            a, b = order[later], order[earlier]
            w = distances(bits, a, b)
            near = np.flatnonzero((w <= t) & (group[a] == group[b]))
            near = near[_first(bits, a[near], b[near], pieces, choice)]
            x, y = node[a[near]], node[b[near]]
            held = [np.concatenate(c) for c in zip(held, (np.minimum(x, y), np.maximum(x, y), w[near]), strict=True)]
            if len(held[0]) > max(CHUNK, 4 * len(node)):
                held = _least(held)
            start = stop
    return tuple(_least(held))


def _least(edges: list[np.ndarray]) -> list[np.ndarray]:
    kept = np.sort(least_forest(*edges)) if len(edges[0]) else np.zeros(0, np.int64)
    return [c[kept] for c in edges]


def _forests(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The forests of whole classes (node, within, text, t, n)."""
    node, within, t, n = (rows.column(c).to_numpy() for c in ("node", "within", "t", "n"))
    for kind in np.unique(n.astype(np.int64) << 32 | t):
        at = np.flatnonzero((n == kind >> 32) & (t == kind & 0xFFFFFFFF))
        src, dst, w = forest_of(rows.column("text").take(pa.array(at)).to_pylist(), node[at], within[at], int(kind & 0xFFFFFFFF))
        order = np.argsort(node[at])
        group = within[at][order[np.searchsorted(node[at][order], src)]]
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(w, pa.int32()), pa.array(group)], ["src", "dst", "w", "within"])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        waiting.append(b)
        held += b.num_rows
        if held >= LOCAL:
            rows = pa.Table.from_batches(waiting)
            within = rows.column("within").to_numpy()
            last = int(np.argmax(within == within[-1]))  # the last class may go on in the next batch
            if last:
                yield from _forests(rows.slice(0, last))
            waiting = rows.slice(last).combine_chunks().to_batches()
            held = rows.num_rows - last
    if held:
        yield from _forests(pa.Table.from_batches(waiting))


def local_forest(texts: DataFrame) -> DataFrame:
    """(src, dst, w, within): the least forests of the links of classes of at most LOCAL texts of one length. texts: (node, within, text, t), t more than 0 and the same in a class."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select("node", "within", "text", "t", F.length("text").cast("int").alias("n"))
    return rows.repartition(parts, "within").sortWithinPartitions("within").mapInArrow(_run, "src long, dst long, w int, within long")


def _starts(rows: pa.Table) -> np.ndarray:
    """Where classes start, whose rows follow each other."""
    of = rows.column("_class").to_numpy()
    return np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)


def _named(rows: pa.Table, names: list[str], inclusive: bool, keep: list[str]) -> pa.Table:
    """The columns ``keep`` of rows of whole classes with the labels by the thresholds ``_t0``, ``_t1``, ..."""
    # ids are put in order here: a sort by class alone compares numbers only
    rows = rows.take(pc.sort_indices(rows, [("_class", "ascending"), ("sequence_id", "ascending")], null_placement="at_start"))
    count, start = rows.num_rows, _starts(rows)
    group = np.repeat(np.arange(len(start)), np.diff(np.concatenate([start, [count]])))
    text = rows.column("cdr3").combine_chunks()
    code = text.dictionary_encode().indices.to_numpy().astype(np.int64)
    # a node is the first row of those with its text, so the least row of a component has the least id
    _, first, inverse = np.unique(group * (code.max() + 1) + code, return_index=True, return_inverse=True)
    own = first[inverse]
    given = [rows.column(f"_t{k}").to_numpy() for k in range(len(names))]  # null: nan
    limits = [np.where(np.isnan(t), -1, t).astype(np.int64) - (not inclusive) for t in given]
    most, n = np.max(limits, axis=0)[first], pc.utf8_length(text).to_numpy()[first].astype(np.int64)
    kinds = np.where(most > 0, n << 32 | most, -1)
    edges = [np.zeros((3, 0), np.int64)]
    for kind in np.unique(kinds[kinds >= 0]):
        at = np.flatnonzero(kinds == kind)
        edges.append(np.stack(forest_of(text.take(pa.array(first[at])).to_pylist(), first[at], group[first[at]], int(kind & 0xFFFFFFFF))))
    src, dst, w = np.concatenate(edges, axis=1)
    ids, out = rows.column("sequence_id").combine_chunks(), rows.select(keep)
    for name, t, limit in zip(names, given, limits, strict=True):
        near = w <= limit[src]
        root = least_labels(count, src[near], dst[near])[own]
        root = np.where(t < 0, np.arange(count), root)
        out = out.append_column(name, ids.take(pa.array(root, mask=np.isnan(t))))
    return out


def local_labels(records: DataFrame, names: list[str], inclusive: bool, parts: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of records of classes of at most LOCAL rows with their labels: the least sequence_id of the row's cluster at the thresholds ``_t0``, ``_t1``, ... (doubles, the same in a class).

    A class has a number, ``_class``. A row is shuffled once, and its class is clustered and labelled in one task, so nothing is numbered over the rows or joined.
    """
    schema = StructType([*[records.schema[c] for c in keep], *[StructField(name, records.schema["sequence_id"].dataType) for name in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            waiting.append(b)
            held += b.num_rows
            if held >= LOCAL:
                rows = pa.Table.from_batches(waiting)
                last = int(_starts(rows)[-1])  # the last class may go on in the next batch
                if last:
                    yield from _named(rows.slice(0, last), names, inclusive, keep).to_batches(10_000)
                waiting = rows.slice(last).combine_chunks().to_batches()
                held = rows.num_rows - last
        if held:
            yield from _named(pa.Table.from_batches(waiting), names, inclusive, keep).to_batches(10_000)

    read = list(dict.fromkeys(["_class", "sequence_id", "cdr3", *[f"_t{k}" for k in range(len(names))], *keep]))
    return records.select(*read).repartition(parts, "_class").sortWithinPartitions("_class").mapInArrow(run, schema)
