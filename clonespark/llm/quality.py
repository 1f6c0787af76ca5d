"""Document quality by histogram gradient-boosted trees over statistics of the text.

The statistics come from whole texts, vectorised over a batch (no label, language, source or id is among them). Trees
are grown on the driver from a bounded sample of labelled documents (at most ``SAMPLE`` ids, and as many distinct rows of theirs, by
the least hashes): features are cut
into at most 64 bins at their quantiles, each level's gradient and Hessian sums are one histogram over (node, feature, bin), and
the best split of each node is read off its cumulative sums. A tree is a complete binary tree in flat arrays, so
scoring is a few gathers per level for all documents of a batch.

Null and empty texts have statistics of zero and get a score as any other; texts are scored whole, whatever their length. Repeated rows get equal
scores, and are learnt from once. Labels that are null are not learnt from; of
repeated labels of an id the largest counts. Without labels of both kinds every score is the share of label 1
(0.5 without labels at all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.llm import arrowtext as A
from clonespark.llm.columns import rest, slim, whole
from clonespark.llm.lm_scoring import fold

#: The bound of the sample of labelled rows that the trees are grown from.
SAMPLE = 20_000
#: Bytes of text handled at once.
CHUNK = 1 << 20
CUT = 0.3
_KIND = np.zeros(256, np.uint8)  # 0 others, 1 upper case, 2 lower case, 3 digit, 4 ASCII sign, 5 beyond ASCII, 6 white space
_KIND[0x21:0x7F] = 4
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 3, 5
_KIND[[0x20, *range(0x09, 0x0E)]] = 6
NAMES = ["log_words", "word_bytes", "word_bytes_sd", "upper", "lower", "digit", "sign", "beyond_ascii", "white", "lines", "distinct_words", "top_word", "distinct_pairs", "sign_end", "sign_end_3", "upper_words", "sign_words", "capital_words", "long_words", "short_words", "entropy", "distinct_lines", "line_words"]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """By document: the number of distinct items, and of the most frequent one."""
    keys, at, n = np.unique(A.mix64(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, doc[at], n)
    return np.bincount(doc[at], minlength=docs), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each document."""
    return np.concatenate([np.zeros((0, len(NAMES))), *(_statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in A.chunks(offsets, CHUNK))])


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    docs, size = len(offsets) - 1, np.diff(offsets)
    words = A.split_words(data, offsets)
    n, length = words.counts, (words.ends - words.starts).astype(np.float64)
    doc = np.repeat(np.arange(docs), n)
    byte_doc = np.repeat(np.arange(docs), size)
    by = lambda x: np.bincount(doc, x, docs)
    histogram = np.bincount(byte_doc * 256 + data, minlength=docs * 256).reshape(docs, 256)
    share = histogram / np.maximum(size, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(1)
    kinds = np.stack([share[:, _KIND == k].sum(1) for k in range(1, 7)], 1)
    mean = _ratio(by(length), n)
    sd = np.sqrt(np.maximum(_ratio(by(length**2), n) - mean**2, 0))
    h = A.hash_spans(data, words.starts, words.ends)
    distinct, top = _distinct(h, doc, docs)
    at, pair = A.window_hashes(h, words.first, 2)
    pairs, _ = _distinct(pair, doc[at], docs)
    kind = _KIND[data]
    sign = kind == 4
    last = words.ends - 1
    upto = np.concatenate([[0], np.cumsum(sign)])
    capitals = np.concatenate([[0], np.cumsum(kind == 1)])
    signs_in, capitals_in = upto[words.ends] - upto[words.starts], capitals[words.ends] - capitals[words.starts]
    tail = upto[words.ends] - upto[np.maximum(words.ends - 3, words.starts)] >= 3
    line = np.cumsum(data == 0x0A)  # the lines that words stand in
    starts_line = np.ones(len(doc), bool)
    starts_line[1:] = (line[words.starts[1:]] != line[words.starts[:-1]]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(starts_line)
    lines = np.bincount(doc[first], minlength=docs)
    line_hash = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(first, np.diff(np.append(first, len(h)))).astype(np.uint64) + np.uint64(1)), first) if len(first) else h
    line_distinct, _ = _distinct(line_hash, doc[first], docs)
    columns = [
        np.log1p(n), mean, sd, *kinds.T, _ratio(lines, n), _ratio(distinct, n), _ratio(top, n), _ratio(pairs, n - 1), _ratio(by(sign[last]), n), _ratio(by(tail), n),
        _ratio(by((capitals_in == length) & (length > 1)), n), _ratio(by(signs_in == length), n), _ratio(by(kind[words.starts] == 1), n), _ratio(by(length > 15), n), _ratio(by(length < 3), n), entropy, _ratio(line_distinct, lines), np.log1p(_ratio(n, lines)),
    ]
    return np.stack(columns, 1)


@dataclass
class BoostedTrees:
    """Complete trees of one depth in flat arrays: inner node i has the children 2i + 1 and 2i + 2."""

    base: float
    depth: int
    feature: np.ndarray  # (trees, inner nodes)
    limit: np.ndarray  # go right above it
    value: np.ndarray  # (trees, leaves)

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            margin += value[node - len(feature)]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> BoostedTrees:
    """Boosted trees for the log loss. least: the Hessian that each side of a split has at least."""
    inner, share = (1 << depth) - 1, (y.mean() if len(y) else 0.5)
    if not (len(y) and 0 < share < 1):
        share = min(max(share, 1e-6), 1 - 1e-6)
        trees = 0
    base = float(np.log(share / (1 - share)))
    feature, limit, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if not trees:
        return BoostedTrees(base, depth, feature, limit, value)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)  # bin b: at most edge b
    f = x.shape[1]
    cell = binned + np.arange(f) * bins
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, start = 1 << level, (1 << level) - 1
            at = (cell + ((node - start) * f * bins)[:, None]).ravel()
            sums = [np.bincount(at, np.repeat(v, f), width * f * bins).reshape(width, f, bins).cumsum(2) for v in (g, h)]
            total = [s[:, :1, -1:] for s in sums]
            gain = sums[0] ** 2 / (sums[1] + ridge) + (total[0] - sums[0]) ** 2 / (total[1] - sums[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
            gain[(sums[1] < least) | (total[1] - sums[1] < least)] = 0
            flat = gain.reshape(width, -1)
            best = flat.argmax(1)
            for k in np.flatnonzero(flat[np.arange(width), best] > 1e-9):
                feature[t, start + k], b = divmod(int(best[k]), bins)
                limit[t, start + k] = edges[feature[t, start + k]][b]
            own = node
            node = 2 * own + 1 + (x[np.arange(len(y)), feature[t, own]] > limit[t, own])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[t, leaf]
    return BoostedTrees(base, depth, feature, limit, value)


def _mapped(docs: DataFrame, text: str, new: str, columns, keep_text: bool = False):
    """docs, without the text unless it is kept, and with what ``columns`` makes of a batch's statistics."""
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(*A.column_bytes(b[text]))
            names, arrays = columns(x)
            yield pa.RecordBatch.from_arrays([b[f.name] for f in kept] + arrays, names=[f.name for f in kept] + names)
        A.release()

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), new]))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", sample: int = SAMPLE) -> BoostedTrees:
    """Trees grown from at most ``sample`` distinct rows of at most ``sample`` labelled ids; their statistics are all that the driver gets."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id").select("doc_id", "_label", text)
    seen = _mapped(rows, text, "_x binary", lambda x: (["_x"], [pa.array([r.tobytes() for r in x], pa.binary())])).distinct()
    got = sorted(seen.orderBy(F.xxhash64("doc_id", "_x"), "doc_id", "_x").limit(sample).collect(), key=lambda r: (r["doc_id"], r["_x"]))
    x = np.stack([np.frombuffer(r["_x"]) for r in got]) if got else np.zeros((0, len(NAMES)))
    return fit(x, np.array([float(r["_label"]) for r in got]))


def score_quality(docs: DataFrame, trees: BoostedTrees, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with ``score``, and without the text unless it is kept."""
    return _mapped(docs, text, "score double", lambda x: (["score"], [pa.array(trees.predict(x))]), keep_text)


def _trees(spark: SparkSession, docs: DataFrame, sf_dir: str) -> BoostedTrees:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold() != 0)
    return fit_quality(docs, labels)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_quality(docs, _trees(spark, docs, sf_dir))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents that the classifier does not reject."""
    kept = score_quality(slim(docs, "text"), _trees(spark, docs, sf_dir), keep_text=True).where(F.col("score") >= CUT)
    return whole(kept.select("text", *rest(kept)), docs.columns)
