"""Vectors in blocks: what the two searches share.

Every row is a candidate in a block; batches of queries are sent to blocks, a block answers each query with its own
best rows, and the answers of all blocks are merged. So no task holds more than one block and one batch of queries at a time, and
blocks follow the bytes of the table (``BLOCK``), with at least one for each shuffle partition.

Rows with a null id, or a null vector, or a vector with a null or non-finite component take no part. Rows that repeat an
id and its vector count once (a batch's are dropped before they are sent, the others where they meet); where an id has several vectors,
each is a candidate, and the least (as bytes) is the query. A query's own rows are those of its id. Vectors of another dimension
are no candidates of a query. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonespark.llm import arrowtext as A
from clonespark.llm import exchange as X

#: Queries in one message to a block, and the bytes of vectors that a block should have.
BATCH, BLOCK = 256, 1 << 26
FOUND = "query_id long, vec_id long, key long, score {}"


def _vectors(column: pa.ListArray, scale: float | None, zero: bool) -> tuple[np.ndarray, pa.Array]:
    """(whether each row takes part, the vectors as bytes)."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    if scale is not None:
        with np.errstate(over="ignore", invalid="ignore"):
            flat = np.floor(scale * flat.astype(np.float64))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    if not zero:
        some = np.concatenate([[0], np.cumsum(flat != 0)])
        ok &= some[offsets[1:]] > some[offsets[:-1]]
    flat = np.ascontiguousarray(flat)
    raw = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets * flat.itemsize), pa.py_buffer(flat)])
    return ok, raw


def usable(table: DataFrame, scale: float | None = None, zero: bool = True, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, str]:
    """((vec_id, v), the type of v's numbers): v is the bytes of each vector that takes part.

    scale: components become floor(scale * x); zero: whether zero vectors take part. Floats stay floats, other numbers are doubles.
    """
    single = scale is None and table.schema[vector].dataType.simpleString() == "array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, raw = _vectors(b.column(1), scale, zero)
            ids, raw = b.column(0).filter(pa.array(ok)), raw.filter(pa.array(ok)).cast(pa.binary())
            number = np.asarray(ids).view(np.uint64)
            _, first, back = np.unique(A.mix64(keys_of(raw) ^ A.mix64(number)), return_index=True, return_inverse=True)
            fresh = first[back] == np.arange(len(ids))
            twin = np.flatnonzero(~fresh)
            same = np.asarray(pc.equal(raw.take(pa.array(twin)), raw.take(pa.array(first[back][twin])))) if len(twin) else np.zeros(0, bool)
            fresh[twin] = ~(same & (number[twin] == number[first[back][twin]]))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(fresh)), raw.filter(pa.array(fresh))], names=["vec_id", "v"])

    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v")).where("vec_id is not null and v is not null")
    return rows.mapInArrow(run, "vec_id long, v binary"), "<f4" if single else "<f8"


def keys_of(vectors: pa.Array) -> np.ndarray:
    """A 64-bit hash of each vector."""
    data, offsets = A.column_bytes(vectors)
    return A.hash_spans(data, offsets[:-1], offsets[1:])


def matrix(vectors: list[bytes] | pa.Array, dtype: str) -> np.ndarray:
    """Vectors of one dimension as doubles."""
    data = b"".join(vectors) if isinstance(vectors, list) else A.column_bytes(vectors)[0].tobytes()
    return np.frombuffer(data, dtype).astype(np.float64).reshape(len(vectors), -1) if data else np.zeros((len(vectors), 0))


def blocks_of(rows: DataFrame, copies: int = 1) -> tuple[int, int]:
    """(blocks, rows) for a table (vec_id, v) of which each row is sent ``copies`` times."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("v")), F.lit(0))).first()
    return max(X.parts(rows.sparkSession), -(-copies * size // BLOCK)), n


def single(queries: DataFrame) -> DataFrame:
    """One vector for each id, in as many partitions as a shuffle has (queries are few, but each is work)."""
    return queries.repartition(X.parts(queries.sparkSession), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))


def by_dimension(ids: np.ndarray, vectors: pa.Array, group: np.ndarray, dtype: str) -> dict[int, tuple]:
    """{dimension: (ids, keys, group, matrix)} in the order of (group, id, key), repeats of an id's vector in a group once."""
    sizes = np.diff(A.column_bytes(vectors)[1]) // np.dtype(dtype).itemsize
    keys, out = keys_of(vectors), {}
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        own = own[np.lexsort((keys[own], ids[own], group[own]))]
        i, k, g, x = ids[own], keys[own], group[own], matrix(vectors.take(pa.array(own)), dtype)
        fresh = np.ones(len(own), bool)
        twin = np.flatnonzero((i[1:] == i[:-1]) & (k[1:] == k[:-1]) & (g[1:] == g[:-1])) + 1
        fresh[twin] = ~(x[twin] == x[twin - 1]).all(1)
        out[d] = (i, k, g, x) if fresh.all() else (i[fresh], k[fresh], g[fresh], x[fresh])
    return out


def pack(*columns: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns), names=[str(i) for i in range(len(columns))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(message: pa.BinaryScalar) -> list[pa.Array]:
    return [c.combine_chunks() for c in pa.ipc.open_stream(message.as_buffer()).read_all().columns]


def met(blocks: DataFrame, messages: DataFrame, n: int, meet: Callable[[pa.Table, pa.Table], list[tuple]], score: str) -> DataFrame:
    """What blocks (to, ...) and messages (to, message) give where they meet: meet returns (query_id, ids, keys, scores) by query."""
    schema = FOUND.format(score)

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        found = meet(rows, sent) if rows.num_rows and sent.num_rows else []
        join = lambda k, kind: np.concatenate([np.zeros(0, kind), *(f[k] for f in found)])
        query = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
        A.release()
        return pa.table([pa.array(query), pa.array(join(1, np.int64)), pa.array(join(2, np.uint64).view(np.int64)), pa.array(join(3, np.int64 if score == "long" else np.float64))], ["query_id", "vec_id", "key", "score"])

    return blocks.repartitionById(n, "to").groupBy("to").cogroup(messages.repartitionById(n, "to").groupBy("to")).applyInArrow(run, schema)


def ranked(found: DataFrame, k: int, best: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all blocks' answers, a vector that several answers have once."""
    once = found.groupBy("query_id", "vec_id", "key").agg(F.first("score").alias("score"))
    order = F.col("score").asc() if best == "asc" else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sample(rows: DataFrame, n: int, dtype: str) -> np.ndarray:
    """At most n rows by the least hashes of their ids, of the dimension that most of them have."""
    some = [bytes(r["v"]) for r in rows.orderBy(F.xxhash64("vec_id"), "v").limit(n).collect()]
    sizes = [len(v) for v in some]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s)) if some else 0
    return matrix([v for v in some if len(v) == size], dtype)


def every(step: int) -> Column:
    return F.pmod(F.col("vec_id"), F.lit(step)) == 0
