"""Vectors compressed to short codes: each of their equal parts is replaced by the index of the nearest entry of that part's codebook.

Vectors become blocks of integers, stored by part and dimension, so that a block's distances to all entries accumulate dimension by
dimension over whole columns. Codebooks start at the vectors of the least ids, and are refined in rounds: every block adds its parts to int64
tensors of sums and counts (``np.add.at``), one pair for each task, and ``treeAggregate`` merges these in levels. Sums are integers, so the order of merging does not
matter, and a lost task's share is made again from the stored blocks. The driver holds the codebooks and the last few tensors, whose
size is ``entries`` times the dimension, whatever the number of vectors.

Rows with a null vector, or with a null or non-finite component, take no part. A component x becomes floor(scale * x), held within a limit that keeps
distances below 2^62 (for 64 dimensions, 2^27). Vectors are filled up with zeros to the longest one's dimension, and to a multiple of the parts; so vectors of
several dimensions, and empty ones, have codes too. Codebooks start with distinct ids: one that is repeated starts with its least vector, null ids count as one,
after all others, and fewer ids than entries make smaller codebooks. Ties go to the lower entry. Repeated rows count as often as they are there. An empty table has no codes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.llm import arrowtext as A
from clonespark.plans.lineage import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Vectors in a block, and the branching of the reduction tree at most.
BLOCK, BRANCHES = 4096, 32
_FAR = float(1 << 62)


@dataclass
class Codebooks:
    """entries: integers by part, entry and position within the part."""

    entries: np.ndarray
    scale: float = SCALE

    def digest(self) -> str:
        """SHA-256 of all components as decimals, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every part of a block (part, position, vector)."""
        codes, error = np.empty((2, len(block), block.shape[2]), np.int64)
        for p, (columns, book) in enumerate(zip(block, self.entries, strict=True)):
            d = np.zeros((len(book), block.shape[2]), np.int64)
            for x, c in zip(columns, book.T, strict=True):
                step = x[None, :] - c[:, None]
                step *= step
                d += step
            codes[p] = d.argmin(0)
            error[p] = np.take_along_axis(d, codes[p][None, :], 0)[0]
        return codes, error

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The vectors (one a row) that codes (vector, part) stand for."""
        return self.entries[np.arange(codes.shape[1]), codes].reshape(len(codes), -1) / self.scale


def blocks_of(table: DataFrame, scale: float = SCALE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(ids, labels, dim, form, x): runs of vectors that take part; x holds their integers by dimension, ``form`` is their type, the smallest that holds them."""
    rows = table.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("v is not null")
    kind = rows.schema["label"].dataType.simpleString()
    names = ["ids", "labels", "dim", "form", "x"]

    def packed(ids: pa.Array, labels: pa.Array, v: pa.ListArray) -> pa.RecordBatch | None:
        offsets = np.asarray(v.offsets).astype(np.int64)
        flat = v.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        good = np.flatnonzero(bad[offsets[1:]] == bad[offsets[:-1]])
        if not len(good):
            return None
        size = np.diff(offsets)[good]
        x = np.zeros((int(size.max()), len(good)), np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.clip(np.floor(scale * flat), -_FAR, _FAR)
        if size.min() == size.max():
            x[:] = whole[offsets[good][:, None] + np.arange(len(x))].T
        else:
            for k, (i, n) in enumerate(zip(offsets[good].tolist(), size.tolist(), strict=True)):
                x[:n, k] = whole[i : i + n]
        most = int(np.abs(x).max()) if x.size else 0
        form = next(f for f, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if most < top)
        run = lambda a: pa.ListArray.from_arrays(pa.array([0, len(good)], pa.int32()), a.take(pa.array(good)))
        return pa.RecordBatch.from_arrays([run(ids), run(labels), pa.array([len(x)], pa.int32()), pa.array([form]), pa.array([x.astype(form).tobytes()], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                if (out := packed(*b.slice(i, BLOCK).columns)) is not None:
                    yield out
        A.release()

    return rows.mapInArrow(run, f"ids array<bigint>, labels array<{kind}>, dim int, form string, x binary")


def _opened(x: bytes, form: str, dim: int, n: int, width: int, parts: int) -> np.ndarray:
    """A block of n vectors as integers by part, position and vector."""
    out = np.zeros((width, n), np.int64)
    out[:dim] = np.frombuffer(x, form).reshape(dim, n)
    limit = math.isqrt((1 << 62) // max(width, 1)) // 2
    return np.clip(out, -limit, limit).reshape(parts, width // parts, n)


def _least(ids: np.ndarray, x: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """The least distinct ids (two columns: whether it is null, the id) of vectors (one a row), each with its least vector."""
    order = np.lexsort((*x.T[::-1], ids[:, 1], ids[:, 0]))
    ids, x = ids[order], x[order]
    fresh = np.flatnonzero(np.concatenate([np.ones(min(len(ids), 1), bool), (ids[1:] != ids[:-1]).any(1)]))[:entries]
    return ids[fresh], x[fresh]


def _depth(blocks: RDD) -> int:
    """Levels of the reduction tree: none of its nodes merges more than about BRANCHES others."""
    return max(2, math.ceil(math.log(max(blocks.getNumPartitions(), 2), BRANCHES)))


def _start(blocks: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """The vectors of the least ids by part, entry and position."""
    merge = lambda a, b: b if a is None else a if b is None else _least(*(np.concatenate(s) for s in zip(a, b, strict=True)), entries)

    def add(known, row):
        ids = np.array([(i is None, i or 0) for i in row["ids"]], np.int64).reshape(-1, 2)
        x = _opened(bytes(row["x"]), row["form"], row["dim"], len(ids), width, parts).reshape(width, len(ids)).T
        some = np.unique(ids, axis=0)[:entries]
        near = (ids[:, 0] < some[-1, 0]) | ((ids[:, 0] == some[-1, 0]) & (ids[:, 1] <= some[-1, 1]))
        return merge(known, _least(ids[near], x[near], entries))

    rows = blocks.select("ids", "dim", "form", "x").rdd
    found = rows.treeAggregate(None, add, merge, _depth(rows))
    x = found[1] if found is not None else np.zeros((0, width), np.int64)
    return np.ascontiguousarray(x.reshape(len(x), parts, width // parts).transpose(1, 0, 2))


def _refined(blocks: DataFrame, books: Codebooks, width: int, parts: int) -> Codebooks:
    """Every entry replaced by the floor of the mean of the parts that are nearest to it, if there are any."""
    context = blocks.sparkSession.sparkContext
    shape = books.entries.shape
    sent = context.broadcast(books)

    def add(known, row):
        block = _opened(bytes(row["x"]), row["form"], row["dim"], row["n"], width, parts)
        codes, _ = sent.value.nearest(block)
        sums, counts = known or (np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64))
        part = np.broadcast_to(np.arange(parts)[:, None], codes.shape)
        np.add.at(sums, (part, codes), block.transpose(0, 2, 1))
        np.add.at(counts, (part, codes), 1)
        return sums, counts

    def merge(a, b):
        return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

    rows = blocks.select("dim", "form", "x", F.size("ids").alias("n")).rdd
    total = rows.treeAggregate(None, add, merge, _depth(rows))
    sent.unpersist()
    if total is None:
        return books
    sums, counts = total
    return Codebooks(np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books.entries), books.scale)


def fit_codebooks(blocks: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> Codebooks:
    """Codebooks of stored blocks."""
    if parts < 1 or not 1 <= entries <= 256:
        raise ValueError("at least one part, and 1 to 256 entries")
    dim = blocks.agg(F.max("dim")).first()[0] or 0
    width = -(-dim // parts) * parts
    books = Codebooks(_start(blocks, width, parts, entries), scale)
    for _ in range(rounds):
        books = _refined(blocks, books, width, parts)
    return books


def encoded(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of every vector: a byte for each part's entry, and the squared distances of all parts together."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)
    kind = blocks.schema["labels"].dataType.elementType.simpleString()
    parts, _, each = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, labels, dim, form, x = (c[i] for c in b.columns)
                n = len(ids)
                codes, error = sent.value.nearest(_opened(x.as_py(), form.as_py(), dim.as_py(), n, parts * each, parts))
                code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), n, [None, pa.py_buffer(np.ascontiguousarray(codes.T.astype(np.uint8)))])
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, code.cast(pa.binary()), pa.array(error.sum(0))], names=["vec_id", "label", "code", "error"])
        A.release()

    return blocks.select("ids", "labels", "dim", "form", "x").mapInArrow(run, f"vec_id bigint, label {kind}, code binary, error bigint")


def decoded(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """codes with ``vector``, what each code stands for (null for a null code)."""
    sent = codes.sparkSession.sparkContext.broadcast(books)
    if "vector" in codes.columns:
        raise ValueError("there is a column named vector")
    names = [*codes.columns, "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(names.index(code))
            got = iter(sent.value.vectors(np.frombuffer(b"".join(raw.drop_null().to_pylist()), np.uint8).reshape(-1, len(sent.value.entries))).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([next(got) if ok else None for ok in raw.is_valid().to_pylist()], pa.list_(pa.float64()))], names=names)

    return codes.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields) + ", vector array<double>")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes (stored) with label_error: the errors of equal labels together, null labels too; at most 2^63 - 1.

    A frequent label is summed up before it is shuffled. The table of labels is broadcast only if Spark finds it small; otherwise adaptive execution splits a frequent one.
    """
    sums = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums, _ = stored(sums.withColumnRenamed("label", "_label"), "label-errors")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, **columns: str) -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code, error), codebooks) of a table; columns: the names of vec_id, vector and label."""
    blocks, _ = stored(blocks_of(table, scale, **columns), "vector-blocks")
    books = fit_codebooks(blocks, parts, entries, rounds, scale)
    return encoded(blocks, books), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes = with_label_errors(stored(codes, "vector-codes")[0])
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    assign = lambda k: f"a{k} as (select r, x.p, min(list_sum(list_transform(list_zip(w, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint * {ENTRIES} + e) m from x join c{k} using (p) group by r, x.p)"
    refine = lambda k: f"""s{k} as (select p, m % {ENTRIES} e, list(f order by i) f from (select x.p, a.m % {ENTRIES} m, i, cast(floor(sum(w[i])::double / count(*)) as bigint) f from x join a{k} a using (r, p), unnest(range(1, len(w) + 1)) t(i) group by all) group by all),
c{k + 1} as (select p, e, coalesce(f, c) c from c{k} left join s{k} using (p, e))"""  # noqa: E731
    return f"""
with v as (select row_number() over (order by vec_id) r, vec_id, label, list_transform(embedding, lambda q: cast(floor({SCALE} * q::double) as bigint)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda q: q is null or not isfinite(q))) = 0),
x as (select r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] w from v, unnest(range(0, {PARTS})) t(p)),
c0 as (select p, r - 1 e, w c from x where r <= {ENTRIES}), {", ".join(f"{assign(k)}, {refine(k)}" for k in range(ROUNDS))}, {assign(ROUNDS)},
o as (select r, string_agg(printf('%02x', m % {ENTRIES}), '' order by p) code, cast(sum(m // {ENTRIES}) as bigint) error from a{ROUNDS} group by r),
h as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) codebooks_sha256 from c{ROUNDS})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, codebooks_sha256 from o join v using (r), h
"""


#: DuckDB SQL of op11_vector_codes.
ORACLE = _oracle()
