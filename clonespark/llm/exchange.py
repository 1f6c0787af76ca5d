"""Exact look-ups of huge key sets: columnar requests from blocks of rows to key buckets and back.

Documents are dealt into blocks by a hash of the row, packed and compressed by the batch. A block sends each bucket of the key
space one packed array of its distinct keys (sorted, delta coded), and each bucket answers every block with one
array. A key that millions of rows share is one entry for each block, so no key is hot. Nothing
is sent to the driver. Requests do not depend on the order of a block's rows, so lost partitions can
be made again in any order.

There are as many blocks, and buckets, as the texts' bytes ask for (``BLOCK_BYTES`` each), and at least one for each shuffle partition; so
what a task holds does not grow with the table.

Up to ``DIRECT`` blocks, a block writes one message to each bucket. Beyond that, n x n messages would be too many and too small: blocks
then ask relays (``Route``). Buckets form some sqrt(n) groups and blocks some sqrt(n) slices, and a relay stands between one slice and one group: it merges what its
slice's blocks ask of its group's buckets into one request of distinct keys, asks each bucket once, and tells every block its
own part of the answers. A relay holds about as many keys as a block or a bucket does, and messages are 2 n sqrt(n) each way. Answers are the same
either way.

Rows that are equal in all columns are dealt to one block up to ``COPIES`` of them for each partition of the table; further ones are dealt by their
number and partition. A million copies of one row are so spread over the blocks, and as equal rows can stand for one another, a partition may be
made again in another order of its rows, but has to have the same rows, as all of Spark's sources and shuffles by key do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.llm import arrowtext as A

U64 = np.uint64
#: Bytes of texts that a block should have. A block's task needs some 40 times as much memory.
BLOCK_BYTES = 1 << 23
#: Blocks that ask the buckets themselves; more of them ask relays.
DIRECT = 4096
#: Equal rows of a partition that lie in one block.
COPIES = 4


@dataclass(frozen=True)
class Route:
    """How n blocks reach the buckets: by themselves (no relays: ``groups`` is 0), or by groups x slices relays.

    Group g has the buckets g * width up to (g + 1) * width; slice s has the blocks s * depth up to (s + 1) * depth.
    """

    blocks: int
    groups: int = 0
    width: int = 0
    depth: int = 0

    @classmethod
    def of(cls, n: int, direct: int | None = None) -> Route:
        if n <= (DIRECT if direct is None else direct):
            return cls(n)
        groups = math.isqrt(n - 1) + 1
        return cls(n, groups, -(-n // groups), -(-n // groups))

    @property
    def first(self) -> int:
        """Ranges of keys that a block writes messages to."""
        return self.groups or self.blocks

    @property
    def buckets(self) -> int:
        return self.groups * self.width or self.blocks

    @property
    def relays(self) -> int:
        return self.groups * -(-self.blocks // self.depth)

    def relay(self, group: str = "bucket", block: str = "block") -> Column:
        return (F.col(group) + self.groups * F.floor(F.col(block) / self.depth)).cast("int")


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def blocks_for(docs: DataFrame, text: str = "text", each: int = BLOCK_BYTES) -> int:
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(parts(docs.sparkSession), -(-size // each))


class _Copies:
    """Numbers equal rows, by their hashes, over the batches of a partition."""

    def __init__(self) -> None:
        self.keys, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """By row, how many equal ones came before it."""
        own, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.argsort(back, kind="stable")
        out = np.empty(len(keys), np.int64)
        out[order] = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == own[inside]
        before = np.zeros(len(own), np.int64)
        before[known] = self.seen[at[known]]
        self.seen[at[known]] += count[known]
        merged = np.concatenate([self.keys, own[~known]])
        by_key = np.argsort(merged, kind="stable")
        self.keys, self.seen = merged[by_key], np.concatenate([self.seen, count[~known]])[by_key]
        return out + before[back]


def deal(keys: np.ndarray, number: np.ndarray, part: int, n: int) -> np.ndarray:
    """The blocks of rows, from their hashes and their numbers among equal rows of their partition."""
    turn = (number // COPIES).astype(U64)
    own = U64(part * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    further = A.mix64(keys.view(U64) + turn * U64(0x9E3779B97F4A7C15) + own)
    return np.where(turn > 0, further % U64(n), np.mod(keys, n).astype(U64)).astype(np.int32)


def in_blocks(df: DataFrame, n: int) -> DataFrame:
    """(block, rows): rows dealt evenly into n blocks by a hash of all columns and their number among equal rows, in compressed runs; rows_of() has them back."""
    names = df.columns
    hashed = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    dealt = df.select(F.xxhash64(*hashed).alias("_to"), *[F.col(f"`{c}`") for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        copies, part = _Copies(), TaskContext.get().partitionId()
        for b in batches:
            keys = np.asarray(b.column(0))
            to = deal(keys, copies.numbers(keys), part, n)
            order = np.argsort(to, kind="stable")
            rows = pa.RecordBatch.from_arrays(b.columns[1:], names=names).take(pa.array(order))
            blocks, first = np.unique(to[order], return_index=True)
            packed = []
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(to)], strict=True):
                with pa.ipc.new_stream(sink := pa.BufferOutputStream(), rows.schema, options=options) as stream:
                    stream.write_batch(rows.slice(i, j - i))
                packed.append(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([x.to_pybytes() for x in packed], pa.binary())], names=["block", "rows"])
        A.release()

    return dealt.mapInArrow(run, "block int, rows binary").repartitionById(n, "block")


def rows_of(column: pa.ChunkedArray) -> pa.Table:
    """The rows that the messages of a block hold."""
    return pa.concat_tables([pa.ipc.open_stream(m.as_buffer()).read_all() for m in column])


def pack(values: np.ndarray) -> bytes:
    """Bytes by place rather than by value, so that compression finds the places that are empty or take few values."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes() if len(values) else b""


def unpack(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(data, np.uint8)
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=U64)


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data) if data else b""


def opened(data: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def by_bucket(keys: np.ndarray, n: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Limits of the buckets start..stop, of 0..n, in sorted keys, which are all of these; a bucket is a range of the upper 32 bits."""
    edges = np.array([-(-(b << 32) // n) for b in range(start + 1, n if stop is None else stop)], U64) << U64(32)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


#: keys: runs of sorted keys, delta coded; runs: their lengths; a, b: payloads, aligned with the keys or not.
REQUEST = "bucket int, block int, keys binary, runs array<long>, a binary, b binary"
#: x: one value for each key, in the request's order; m, n: of the bucket.
ANSWER = "block int, bucket int, level int, x binary, m long, n long"
_REQUEST = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("runs", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("level", pa.int32()), ("x", pa.binary()), ("m", pa.int64()), ("n", pa.int64())])
#: What a block asks for: sorted runs of keys, each with arrays aligned with it by payload.
Runs = list[tuple[np.ndarray, dict[str, np.ndarray]]]


def _requests(origin: int, runs: Runs, n: int, start: int = 0, stop: int | None = None) -> Iterator[pa.RecordBatch]:
    """What a block, or a relay, asks of the buckets start..stop, of 0..n."""
    stop = n if stop is None else stop
    cuts = [by_bucket(keys, n, start, stop) for keys, _ in runs]
    made: dict[str, list] = {c: [] for c in ("keys", "runs", "a", "b")}
    for i in range(stop - start):
        spans = [slice(c[i], c[i + 1]) for c in cuts]
        made["keys"].append(squeezed(b"".join(pack_sorted(keys[s]) for (keys, _), s in zip(runs, spans, strict=True))))
        made["runs"].append([s.stop - s.start for s in spans])
        for c in "ab":
            made[c].append(squeezed(pack(np.concatenate([more[c][s] for (_, more), s in zip(runs, spans, strict=True)]))) if c in runs[0][1] else None)
    cols = [np.arange(start, stop, dtype=np.int32), np.full(stop - start, origin, np.int32), *made.values()]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _REQUEST, strict=True)], schema=_REQUEST)


def in_bucket_order(runs: Runs, values: list[np.ndarray], n: int) -> list[np.ndarray]:
    """By run, the values that the answers of the buckets 0..n hold, one array each: as the run's keys are ordered."""
    cuts = [by_bucket(keys, n) for keys, _ in runs]
    out = [[] for _ in runs]
    for i, x in enumerate(values):
        at = 0
        for own, c in zip(out, cuts, strict=True):
            own.append(x[at : (at := at + c[i + 1] - c[i])])
    return [np.concatenate(own) for own in out]


def by_level(answers: pa.Table) -> dict[int, list[dict]]:
    """The answers of each level, in the order of buckets."""
    out: dict[int, list[dict]] = {}
    for r in sorted(answers.to_pylist(), key=lambda r: (r["level"], r["bucket"])):
        out.setdefault(r["level"], []).append(r | {"x": opened(r["x"])})
    return out


def ask(blocks: DataFrame, request: Callable[[pa.Table], Runs], n: int) -> DataFrame:
    """One row for each block and range of keys 0..n, of what request(rows) asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got)
            yield from _requests(table["block"][0].as_py(), request(rows_of(table["rows"])), n)
            A.release()

    return blocks.mapInArrow(run, REQUEST)


def ask_again(blocks: DataFrame, answers: DataFrame, request: Callable[[pa.Table, pa.Table], Runs], n: int) -> DataFrame:
    """The same from a block's rows and the answers to what it asked before: request(rows, answers)."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        A.release()
        if not rows.num_rows:
            return _REQUEST.empty_table()
        return pa.Table.from_batches(_requests(rows["block"][0].as_py(), request(rows_of(rows["rows"]), known), n), _REQUEST)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, REQUEST)


def finish(blocks: DataFrame, answers: DataFrame, make: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """make(rows, answers) for every block."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        A.release()
        return make(rows_of(rows["rows"]), known) if rows.num_rows else to_arrow_schema(kind).empty_table()

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, kind)


class Replies(Protocol):
    """What is said about keys. A request has its keys and the payloads a and b; a relay's request is made of its blocks' requests."""

    def merge(self, keys: list[np.ndarray], rows: list[dict]) -> tuple[np.ndarray, dict[str, np.ndarray], list[np.ndarray]]:
        """(the distinct keys of all requests, sorted; their payloads as a request has them, a being what is answered; each request's places among them)."""

    def totals(self, keys: np.ndarray, values: np.ndarray) -> tuple[int, int]:
        """m and n of a bucket, which relays add up."""

    def tell(self, values: np.ndarray) -> bytes:
        """The answer to a request of keys with these values."""

    def told(self, x: bytes, count: int) -> np.ndarray:
        """The values of an answer to a request of so many keys."""


def _opened(rows: list[dict]) -> tuple[list[np.ndarray], list[dict]]:
    """(keys, requests) of requests as they come; payloads are unpacked."""
    keys = []
    for r in rows:
        at = np.cumsum([0, *r["runs"]]) * 8
        run = opened(r["keys"])
        keys.append(np.concatenate([unpack_sorted(run[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]))
    return keys, [r | {"keys": None, "a": opened(r["a"]), "b": opened(r["b"])} for r in rows]


def _answers(rows: list[dict], values: np.ndarray, places: list[np.ndarray], replies: Replies, level: int, m: int, n: int) -> pa.RecordBatch:
    made = [{"block": r["block"], "bucket": r["bucket"], "level": level, "x": squeezed(replies.tell(values[p])), "m": m, "n": n} for r, p in zip(rows, places, strict=True)]
    return pa.RecordBatch.from_pylist(made, schema=_ANSWER)


def _answer(requests: DataFrame, replies: Replies, level: int) -> DataFrame:
    """The answers to the requests of each partition, which is a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = _opened([r for b in batches for r in b.to_pylist()])
        if rows:
            distinct, more, places = replies.merge(keys, rows)
            yield _answers(rows, more["a"], places, replies, level, *replies.totals(distinct, more["a"]))
            A.release()

    return requests.mapInArrow(run, ANSWER)


def look_up(requests: DataFrame, replies: Replies, route: Route, level: int = 0) -> DataFrame:
    """An answer for each request of a block (made for ``route.first`` ranges), by block."""
    n = route.blocks
    if not route.groups:
        return _answer(requests.repartitionById(n, "bucket"), replies, level).repartitionById(n, "block")
    relayed = requests.withColumn("relay", route.relay()).repartitionById(route.relays, "relay")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = _opened([r for b in batches for r in b.to_pylist()])
        if rows:
            distinct, more, _ = replies.merge(keys, rows)
            start = rows[0]["bucket"] * route.width
            yield from _requests(rows[0]["relay"], [(distinct, more)], route.buckets, start, start + route.width)
            A.release()

    def down(asked: pa.Table, told: pa.Table) -> pa.Table:
        A.release()
        keys, rows = _opened(asked.to_pylist())
        if not rows:
            return _ANSWER.empty_table()
        distinct, _, places = replies.merge(keys, rows)
        start = rows[0]["bucket"] * route.width
        counts = np.diff(by_bucket(distinct, route.buckets, start, start + route.width)).tolist()
        told = sorted(told.to_pylist(), key=lambda r: r["bucket"])
        values = np.concatenate([replies.told(opened(r["x"]), c) for r, c in zip(told, counts, strict=True)])
        return pa.Table.from_batches([_answers(rows, values, places, replies, level, sum(r["m"] for r in told), sum(r["n"] for r in told))])

    asked = relayed.mapInArrow(up, REQUEST).repartitionById(route.buckets, "bucket")
    told = _answer(asked, replies, level).repartitionById(route.relays, "block")
    return relayed.groupBy("relay").cogroup(told.groupBy("block")).applyInArrow(down, ANSWER).repartitionById(n, "block")


def totals(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys, sums, each request's places among them)."""
    every = np.concatenate(keys)
    distinct, back = np.unique(every, return_inverse=True)
    sums = np.bincount(back, np.concatenate(values).astype(np.float64), len(distinct)).astype(np.int64) if len(every) else np.zeros(0, np.int64)
    return distinct, sums, np.split(back, np.cumsum([len(k) for k in keys])[:-1])
