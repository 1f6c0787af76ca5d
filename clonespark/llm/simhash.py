"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart have a common variant at most r bits from each. So every
distinct fingerprint emits all its variants within r bits (r = 2: 2,081), variants are shuffled, and
fingerprints that collide on a variant are linked. Fingerprints that share a variant are at most 2r
apart pairwise, so a star to one of them, verified, keeps every link's effect and makes no group's pairs.

Shuffle: a variant's bucket is a linear hash (its parities under a few masks), so the bucket of x ^ e follows from those of
x and e. A fingerprint is sent once to each bucket that has variants of it, and the bucket makes just these
variants itself: 8 bytes a bucket in place of up to 33 variants. Buckets grow in number with the
fingerprints, and a bucket works through its variants in slices of bounded size.

A text that very many rows share is one fingerprint with many rows, and a large component one root with many fingerprints. Both are joined with
a stored table that has one row for each, so Spark broadcasts that table or splits the hot partitions (adaptive skew joins).

Null and empty texts, and texts of white space only, have fingerprint zero and link like any other. Texts of fewer than
four words have one shingle, all their words. Repeated rows share a fingerprint; a null doc_id is never
the smallest unless its component has no other (then component_id is null). Texts are hashed whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.llm import arrowtext as A
from clonespark.llm import exchange as X
from clonespark.llm.columns import slim, whole
from clonespark.operators.components import connected_components, forest
from clonespark.plans.lineage import stored

U64 = np.uint64
SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Variants that a task handles at once, and that a bucket should have altogether.
SLICE, BUCKET = 1 << 20, 1 << 26
#: Bytes of text handled at once.
CHUNK = 1 << 21


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each document."""
    out = np.zeros(len(offsets) - 1, U64)
    for i, j in A.chunks(offsets, CHUNK):
        words = A.split_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        joined, at = A.joined_words(words)
        sizes, has = words.ends - words.starts, words.counts > 0
        # a document's words follow each other in the joined text with one space between
        start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) - np.repeat(np.cumsum(has) - has, words.counts) if len(sizes) else sizes
        last = np.minimum(np.arange(len(sizes)) + shingle, np.repeat(words.first[1:], words.counts)) - 1
        offset = np.arange(len(sizes)) - np.repeat(words.first[:-1], words.counts)
        begins = (offset == 0) | (offset + shingle <= np.repeat(words.counts, words.counts))
        h = A.xxh64_spans(joined, start[begins], (start + sizes)[last[begins]], seed)
        n = np.where(has, np.maximum(words.counts - shingle + 1, 1), 0)
        first = np.concatenate([[0], np.cumsum(n)])
        out[i:j][has] = _majority(h, first[:-1][has], n[has])
    return out


def _majority(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n), U64)
    lowest = U64(0x0101010101010101)
    for shift in range(8):  # bits shift, shift + 8, ...: one byte lane each
        lanes = ((h >> U64(shift)) & lowest).view(np.uint8).reshape(-1, 8)
        votes = np.add.reduceat(lanes, first, axis=0, dtype=np.int32)
        won = np.ascontiguousarray(2 * votes > n[:, None]).view(np.uint8)
        out |= won.astype(np.uint8).reshape(-1).view(U64) << U64(shift)
    return out


def _fingerprints(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text)
            prints = fingerprints_of(*A.column_bytes(b.column(i))).view(np.int64)
            names = [x for x in b.schema.names if x != text]
            yield pa.RecordBatch.from_arrays([b[x] for x in names] + [pa.array(prints)], names=[*names, "_fp"])
        A.release()

    return run


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of docs with the fingerprint ``_fp`` (long) in place of the text."""
    kept = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(_fingerprints(text), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "_fp long"]))


def ball(radius: int) -> np.ndarray:
    """All 64-bit words of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)], U64)


#: Random masks of the linear hash: bit k of a bucket is the parity of the word under mask k.
_PARITY = A.mix64(np.arange(1, 33, dtype=U64) * U64(0x9E3779B97F4A7C15))


def syndrome(x: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for k in range(bits):
        out |= (np.bitwise_count(x & _PARITY[k]) & 1).astype(np.int64) << k
    return out


def messages(x: np.ndarray, bits: int, radius: int, slice_: int = SLICE) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(buckets, packed fingerprints of x that have variants in each), over and over; about ``slice_`` of them at once."""
    reach = np.unique(syndrome(ball(radius), bits))
    own = syndrome(x, bits)
    step = max(1, slice_ // max(len(x), 1))
    for i in range(0, len(reach) if len(x) else 0, step):
        bucket = (own[:, None] ^ reach[None, i : i + step]).ravel()
        order = np.argsort(bucket, kind="stable")
        ranked = bucket[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        which = x[order // min(step, len(reach) - i)].tobytes()
        ends = np.append(first[1:], len(ranked)).tolist()
        yield ranked[first], [which[8 * j : 8 * k] for j, k in zip(first.tolist(), ends, strict=True)]


def _emit(bits: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for buckets, packed in messages(np.asarray(b.column(0)).view(U64), bits, radius):
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "fps"])

    return run


def links_in_bucket(x: np.ndarray, bucket: int, bits: int, radius: int, slice_: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), a < b, between fingerprints of x that share a variant in the bucket: a star for each variant, distinct."""
    x, balls = np.unique(x), ball(radius)
    finer = max(0, int(len(x) * len(balls) >> bits) // slice_).bit_length()
    own, each = syndrome(x, bits + finer), syndrome(balls, bits + finer)
    order = np.argsort(own, kind="stable")
    x, own = x[order], own[order]
    classes, first = np.unique(own, return_index=True)
    ends = np.append(first[1:], len(x))
    e_order = np.argsort(each, kind="stable")
    balls, each = balls[e_order], each[e_order]
    pairs = [np.zeros((0, 2), U64)]
    for part in range(1 << finer):
        target = bucket | part << bits
        low, high = np.searchsorted(each, classes ^ target, "left"), np.searchsorted(each, classes ^ target, "right")
        some = [(i, j, k, m) for i, j, k, m in zip(first, ends, low, high, strict=True) if m > k]
        if not some:
            continue
        variants = np.concatenate([(x[i:j, None] ^ balls[None, k:m]).ravel() for i, j, k, m in some])
        ranked = np.sort(variants)
        shared = ranked[1:][ranked[1:] == ranked[:-1]]
        if not len(shared):
            continue
        shared = np.unique(shared)
        hit = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, variants), len(shared) - 1)] == variants)
        owner = np.concatenate([np.repeat(x[i:j], m - k) for i, j, k, m in some])[hit]
        v = variants[hit]
        o = np.lexsort((owner, v))
        v, owner = v[o], owner[o]
        head = np.concatenate([[True], v[1:] != v[:-1]])
        star = owner[np.flatnonzero(head)[np.cumsum(head) - 1]]
        both = np.stack([star, owner], 1)[~head]
        both = both[np.bitwise_count(both[:, 0] ^ both[:, 1]) <= 2 * radius]
        pairs.append(np.unique(both, axis=0))
    found = np.unique(np.concatenate(pairs), axis=0)
    return found[:, 0], found[:, 1]


def _collide(bits: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(k, []).append(v)
        for k in sorted(by):
            node, root = forest(*links_in_bucket(np.frombuffer(b"".join(by[k]), U64), k, bits, radius))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], names=["src", "dst"])
        A.release()

    return run


def bits_for(n: int, radius: int) -> int:
    """The bits that number the buckets of n fingerprints."""
    return max(6, int(n * len(ball(radius)) // BUCKET).bit_length())


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (src, dst) whose components are those of all links of ``max_bits`` or fewer between the distinct fingerprints ``_fp``."""
    radius = (max_bits + 1) // 2
    bits = bits_for(distinct.count(), radius)
    sent = distinct.select("_fp").mapInArrow(_emit(bits, radius), "bucket int, fps binary")
    return sent.repartitionById(1 << bits, "bucket").mapInArrow(_collide(bits, radius), "src long, dst long")


def _components(prints: DataFrame, max_bits: int = MAX_BITS, doc_id: str = "doc_id") -> DataFrame:
    """(_fp, root, component_id) of the distinct fingerprints: root is a fingerprint that names the component."""
    distinct, _ = stored(prints.groupBy("_fp").agg(F.min(doc_id).alias("least")), "distinct-fingerprints")
    if max_bits % 2:
        raise ValueError("an odd number of bits would need two radii")
    roots = connected_components(near_links(distinct, max_bits))
    named = distinct.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", "least", F.coalesce("root", "_fp").alias("root"))
    # a stored table, so that the join can split the partition of a root with very many fingerprints
    smallest, _ = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    return named.join(smallest, "root").select("_fp", "root", "component_id")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, _fp, component_id) of every row of docs; component_id is the least doc_id that links lead to."""
    prints, _ = stored(fingerprints(docs.select(doc_id, text), text), "fingerprints")
    components, _ = stored(_components(prints, max_bits, doc_id).select("_fp", "component_id"), "components")
    return prints.join(components, "_fp").select(doc_id, "_fp", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """documents without near copies: of each component one row stays, that of the least doc_id; rows without an id come after all others.

    Of several rows of that id in the component the least hash of the text stays, and of rows that are equal in id and text the first
    as JSON. An id that repeats with different texts may stay once in each of several components.
    """
    key = F.xxhash64("text").alias("_key")  # with the id, it tells which row a fingerprint is of
    prints, _ = stored(fingerprints(docs.select("doc_id", "text", key)), "fingerprints")
    components, _ = stored(_components(prints).select("_fp", "root"), "components")
    best = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_key"))
    own = prints.join(components, "_fp").groupBy("root").agg(best.alias("_best")).select(F.col("_best.doc_id").alias("_id"), F.col("_best._key").alias("_own"))
    rows = slim(docs, "doc_id", "text").withColumn("_key", key)
    kept = rows.join(own.distinct(), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_own")), "left_semi")
    # aggregated before it is shuffled, as very many rows may be equal
    row = F.struct(*[c for c in kept.columns if c != "_key"])
    one = kept.groupBy("doc_id", "_key").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return whole(one, docs.columns)


def brute_force(rows: list[tuple], max_bits: int = MAX_BITS) -> list[tuple]:
    """(doc_id, fingerprint, component_id) by comparing all pairs of distinct fingerprints, for tests."""
    import re

    import xxhash

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    prints = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + SHINGLE]).encode(), SEED) for i in range(max(1, len(w) - SHINGLE + 1))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    distinct = np.unique(np.array(prints, U64))
    pairs = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :][np.bitwise_count(distinct[i + 1 :] ^ a) <= max_bits]]
    up = {int(x): int(x) for x in distinct}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(int(a))] = find(int(b))
    least: dict = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            r = find(p)
            least[r] = min(least.get(r, i), i)
    return [(i, f"{p:016x}", least.get(find(p))) for (i, _), p in zip(rows, prints, strict=True)]
