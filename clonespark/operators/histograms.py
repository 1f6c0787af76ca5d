"""How many pairs of the texts of a class are at each distance, for classes that a task holds.

The distinct texts of a class lie in one task, where each is compared with each by the bits of their letters, and only the counts leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.operators.pieces import planes
from clonespark.operators.resolve import END, _cross

#: Distinct texts of a class that one task may have, texts that a task takes at once (those of one class more), and pairs at once.
LOCAL, ROWS, CELLS = 1 << 13, 1 << 15, 1 << 18


def _counts(rows: pa.Table) -> pa.RecordBatch:
    """(class_id, cdr3_length, d, n) of whole classes, which follow each other."""
    texts = rows.column("cdr3").to_pylist()
    length = max(1, max(map(len, texts)))
    bits = planes([t.ljust(length, END) for t in texts], length)  # what one text has beyond the other's end differs
    of, own, k = (rows.column(c).to_numpy() for c in ("class_id", "cdr3_length", "k"))
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    out = []
    for a, b in zip(start, np.append(start[1:], len(of)), strict=True):
        every, step = np.zeros(length + 1, np.int64), max(1, CELLS // (b - a))
        for at in range(a, b, step):
            d = _cross(bits, np.arange(at, min(at + step, b)), np.arange(a, b))
            both = None if (k[a:b] == 1).all() else np.outer(k[at : at + step][: len(d)], k[a:b]).ravel()
            every += np.bincount(d.ravel(), both, length + 1).astype(np.int64)
        every[0] = 0  # the texts are distinct, so that is each with itself
        found = np.flatnonzero(every)
        out.append(np.stack([np.full(len(found), of[a]), np.full(len(found), own[a]), found, every[found] // 2]))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(np.concatenate(out, axis=1), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["class_id", "cdr3_length", "d", "n"])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        waiting.append(b)
        held += b.num_rows
        if held >= ROWS:
            rows = pa.Table.from_batches(waiting)
            of = rows.column("class_id").to_numpy()
            last = int(np.argmax(of == of[-1]))  # the last class may go on in the next batch
            if last:
                yield _counts(rows.slice(0, last))
            waiting = rows.slice(last).combine_chunks().to_batches()
            held = rows.num_rows - last
    if held:
        yield _counts(pa.Table.from_batches(waiting))


def local_histogram(counts: DataFrame) -> DataFrame:
    """(class_id, cdr3_length, d, n): the pairs of different texts of classes of at most LOCAL distinct ones. counts: (class_id, cdr3_length, cdr3, k), a row for each distinct text and how many have it."""
    # a number of its own, as partitions of few bytes would be put together, whatever the work on them
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counts.select(F.col("class_id").cast("int").alias("class_id"), F.col("cdr3_length").cast("int").alias("cdr3_length"), "cdr3", "k").where("cdr3 is not null")
    return rows.repartition(parts, "class_id").sortWithinPartitions("class_id").mapInArrow(_run, "class_id int, cdr3_length int, d int, n long")
