"""Cosine matches among the texts of one table, block against block.

N-grams are numbered rarest first and texts by id. A text is one row with its n-grams' numbers and how often it has them, and is sent once to each pair of blocks of texts, where its weights are
made again from these and a table of the idf of each number of texts. What a pair of texts has in common is added up where the two blocks meet, so that no candidate is shuffled: n-grams of few texts for every
pair, and the others, whose products are bounded by the lengths of what they make of the two texts, for pairs that can reach the bound only. A task holds two blocks of at
most some ``POSTINGS`` weights each and ``CELLS`` sums at a time, whatever the table's size; the number of blocks grows with the table, and with it how often a text is sent. Smaller tables have ``BLOCKS`` blocks,
of ``FEWEST`` weights at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonespark.operators.numbering import numbered
from clonespark.plans.lineage import stored

#: Weights of a block, sums that a task holds, and products that it makes at once.
POSTINGS, CELLS, CHUNK = 1 << 22, 1 << 22, 1 << 21
#: Sums that are made at once, few enough for a processor's own memory; pairs that wait to be compared; parts of the products, each half of the next, by which tails are cut off.
SWEEP, PAIRS, CUTS = 1 << 19, 1 << 19, 8
#: Blocks that a table has for the sake of parallel tasks, if they have so many weights.
BLOCKS, FEWEST = 6, 1 << 19
#: What rounding may take from a bound.
SLACK = 1 - 1e-6


class Block:
    """Texts' n-grams and weights, text by text, the rarest first."""

    def __init__(self, rows: pa.Table) -> None:
        lists = rows.column("g").combine_chunks()
        self.n = rows.column("n").to_numpy()
        self.start = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        self.g, self.v = lists.flatten().to_numpy(), rows.column("v").combine_chunks().flatten().to_numpy()
        self.row = np.repeat(np.arange(len(self.n)), np.diff(self.start))

    @cached_property
    def by_gram(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The weights n-gram by n-gram: their n-grams, texts and values."""
        order = np.argsort(self.g, kind="stable")
        return self.g[order], self.row[order], self.v[order]

    def tails(self, cuts: np.ndarray) -> np.ndarray:
        """For each of some numbers (rising, the last one above all n-grams) and each text, the length of what its n-grams from that number on make."""
        at = np.searchsorted(cuts, self.g, "right")  # how many of the cuts leave a weight in the tail
        squares = np.bincount(at * len(self.n) + self.row, self.v * self.v, (len(cuts) + 1) * len(self.n)).reshape(-1, len(self.n))
        return np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1][1:])


def weighted(rows: pa.Table, first: np.ndarray, idf: np.ndarray) -> pa.Table:
    """Rows (n, g, v) of texts with their n-grams' numbers g, how often they have them (f), and the length of what these and the idf make; idf[k] is that of the numbers from first[k] on."""
    lists = rows.column("g").combine_chunks()
    count = lists.value_lengths().to_numpy()
    own = idf[np.searchsorted(first, lists.flatten().to_numpy(), "right") - 1]
    v = rows.column("f").combine_chunks().flatten().to_numpy() * own / np.repeat(rows.column("size").to_numpy(), count)
    return pa.table({"n": rows.column("n"), "g": lists, "v": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), v)})


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each, ``count`` of them."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _slices(count: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of at least one entry whose counts sum up to ``most``, or to that of a single one."""
    ends, at = np.cumsum(count), 0
    while at < len(count):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, stop)
        at = stop


def _products(a: Block, b: Block, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The products of the texts x of a and y of b (places)."""
    width = int(max(a.g.max(), b.g.max())) + 1
    keys, out = b.row * width + b.g, np.zeros(len(x))
    count = np.diff(a.start)[x]
    for s in _slices(count, CHUNK):
        at, pair = _spread(a.start[x[s]], count[s]), np.repeat(np.arange(s.start, s.stop), count[s])
        wanted = y[pair] * width + a.g[at]
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        both = keys[place] == wanted
        out[s] = np.bincount(pair[both] - s.start, a.v[at[both]] * b.v[place[both]], s.stop - s.start)
    return out


def _cuts(a: Block, b: Block) -> np.ndarray:
    """Numbers of n-grams below which a half, a quarter, ... of the products of two blocks lie, rising, and one above all."""
    width = int(max(a.g.max(initial=0), b.g.max(initial=0))) + 1
    products = np.cumsum(np.bincount(a.g, minlength=width) * np.bincount(b.g, minlength=width).astype(float))
    return np.unique(np.append(np.searchsorted(products, products[-1] * 0.5 ** np.arange(CUTS, 0, -1), "right"), width))


def _near(a: Block, b: Block, cut: int, rows: np.ndarray, columns: np.ndarray, tails: tuple[np.ndarray, np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts of a and b (places) among some (masks) whose products can reach ``least``: those of the n-grams below a cut, and the tails, which add no more than the product of their lengths."""
    g, other, w = b.by_gram
    stop = np.searchsorted(g, cut)
    kept = np.flatnonzero(columns[other[:stop]])
    column = np.cumsum(columns) - 1
    g, other, w = g[kept], column[other[kept]], w[kept]
    size, names = int(columns.sum()), np.flatnonzero(columns)
    found = np.bincount(g, minlength=cut)
    start = np.cumsum(found) - found
    at = np.flatnonzero(rows[a.row] & (a.g < cut))
    at = at[found[a.g[at]] > 0]
    own, count, first, v = a.row[at], found[a.g[at]], start[a.g[at]], a.v[at]
    ta, tb = tails[0], tails[1][names]
    # the tails' largest product decides first, so that most pairs are compared with one number of their row
    bound = np.maximum(least * SLACK - ta * tb.max(), np.finfo(float).tiny)
    line, begin, place_of = np.unique(own, return_index=True, return_inverse=True)
    cells, ends, stops = min(CELLS, SWEEP), np.cumsum(count), np.append(begin, len(own))[1:]
    done = 0
    while done < len(line):
        before = ends[begin[done] - 1] if begin[done] else 0
        top = max(done + 1, min(done + cells // size, int(np.searchsorted(ends[stops - 1], before + CHUNK, "right"))))
        s = slice(begin[done], stops[top - 1])
        place = _spread(first[s], count[s])
        cell = np.repeat((place_of[s] - done) * size, count[s]) + other[place]
        sums = np.bincount(cell, np.repeat(v[s], count[s]) * w[place], (top - done) * size)
        near = np.flatnonzero(sums.reshape(-1, size) >= bound[line[done:top], None])
        x, y = line[done + near // size], near % size
        near = sums[near] + ta[x] * tb[y] >= least * SLACK
        yield x[near], names[y[near]]
        done = top


def matches(a: Block, b: Block, least: float, rest: float, same: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, sim) of the pairs of texts with a product above ``least``; same: of one block, each pair once.

    A text belongs to the first cut from which on its tail is no longer than the square root of ``rest``, and a pair of texts to the larger one of theirs, so its tails add ``rest`` at most.
    """
    if not len(a.g) or not len(b.g):
        return
    cuts = _cuts(a, b)
    tails = a.tails(cuts), b.tails(cuts)
    of = [np.argmax(t * t <= rest * (1 + 1e-9), axis=0) for t in tails]  # the last tails are zero
    held, waiting = 0, []

    def compared() -> Iterator[pa.RecordBatch]:
        x, y = (np.concatenate(ends) for ends in zip(*waiting, strict=True))
        order = np.lexsort((x, y))
        x, y = x[order], y[order]
        sim = _products(a, b, x, y)
        kept = sim > least
        yield pa.RecordBatch.from_arrays([pa.array(a.n[x[kept]]), pa.array(b.n[y[kept]]), pa.array(sim[kept])], ["a", "b", "sim"])

    for k, cut in enumerate(cuts):
        for rows, columns in ((of[0] <= k, of[1] == k), (of[0] == k, of[1] < k)):
            if not rows.any() or not columns.any():
                continue
            for x, y in _near(a, b, int(cut), rows, columns, (tails[0][k], tails[1][k]), least):
                if same:
                    x, y = x[a.n[x] < b.n[y]], y[a.n[x] < b.n[y]]
                waiting.append((x, y))
                held += len(x)
                if held > PAIRS:
                    yield from compared()
                    held, waiting = 0, []
    if held:
        yield from compared()


def block_matches(w: DataFrame, least: float, rest: float) -> DataFrame:
    """(i, j, sim), i before j: the pairs of texts whose weights w (id, gram, w, df, tf, idf, size) have a product above ``least``. What is not added up for every pair is ``rest`` at most."""
    numbers = numbered(w.select("df", "idf", "gram").distinct(), ["df", "idf", "gram"], "g", 0)
    return _matched(w.select("id", "gram", "tf"), numbers, least, rest)


def list_matches(lists: DataFrame, least: float, rest: float) -> DataFrame:
    """block_matches of the texts of a stored table (id, gram, tf) with arrays of each text's distinct n-grams and how often it has them."""
    total = lists.where(F.size("gram") > 0).agg(F.count("id").cast("double")).first()[0]
    df = lists.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    numbers = numbered(df.withColumn("idf", F.ln((1 + F.lit(total)) / (1 + F.col("df"))) + 1), ["df", "idf", "gram"], "g", 0)
    rows = lists.select("id", F.explode(F.arrays_zip("gram", "tf")).alias("_p")).select("id", "_p.gram", "_p.tf")
    return _matched(rows, numbers, least, rest)


def _matched(rows: DataFrame, numbers: DataFrame, least: float, rest: float) -> DataFrame:
    """The matches of texts by their n-grams rows (id, gram, tf) and the table numbers (gram, df, idf, g)."""
    numbers, _ = stored(numbers.withColumn("g", F.col("g").cast("int")), "grams")
    # a row for each number of texts that an n-gram has, so no more than the square root of twice the weights
    steps = numbers.groupBy("df", "idf").agg(F.min("g").alias("g")).orderBy("g").collect()
    first, idf = np.array([r["g"] for r in steps], np.int64), np.array([r["idf"] for r in steps])
    weight = F.col("tf") * F.col("idf")
    pairs = F.array_sort(F.collect_list(F.struct("g", F.col("tf").cast("int").alias("tf"))))
    lists = rows.where("id is not null").join(numbers.select("gram", "g", "idf"), "gram").groupBy("id").agg(pairs.alias("p"), F.sqrt(F.sum(weight * weight)).alias("size"))
    lists, _ = stored(lists.select("id", F.col("p.g").alias("g"), F.col("p.tf").alias("f"), "size"), "lists")
    ids, _ = stored(numbered(lists.select("id"), ["id"], "n", 0), "numbers")
    vectors, _ = stored(lists.join(ids, "id").select("n", "g", "f", "size"), "vectors")
    texts, weights = vectors.agg(F.count("*"), F.sum(F.size("g"))).first()
    postings = min(POSTINGS, max(FEWEST, (weights or 0) // BLOCKS))
    each = max(1, postings * texts // max(1, weights or 0))
    blocks = max(1, -(-texts // each))
    own = F.expr(f"cast(n div {each} as int)")
    # a block is the first one of its pairs with itself and later ones, and the second one of those with earlier ones
    to = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct((F.least(own, k) * blocks + F.greatest(own, k)).alias("pair"), (k < own).alias("second")))
    sent = vectors.select("n", "g", "f", "size", F.explode(to).alias("to")).select("to.pair", "to.second", "n", "g", "f", "size")

    def run(group: pa.Table) -> pa.Table:
        second = group.column("second")
        a = Block(weighted(group.filter(pc.invert(second)).sort_by("n"), first, idf))
        other = group.filter(second).sort_by("n")
        same = group.column("pair")[0].as_py() % (blocks + 1) == 0
        found = list(matches(a, a if same else Block(weighted(other, first, idf)), least, rest, same))
        return pa.Table.from_batches(found, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())]))

    found, _ = stored(sent.repartition(blocks * (blocks + 1) // 2, "pair").groupBy("pair").applyInArrow(run, "a long, b long, sim double"), "block-matches")
    return found.join(ids.select(F.col("n").alias("a"), F.col("id").alias("i")), "a").join(ids.select(F.col("n").alias("b"), F.col("id").alias("j")), "b").select("i", "j", "sim")


def best_of(a: Block, b: Block, k: int) -> Iterator[pa.RecordBatch]:
    """(a, b, sim) of each text of a with those of b that are among its k best, and those that are no less but for rounding; products are above zero."""
    order = np.argsort(b.g, kind="stable")
    grams, size = b.g[order], len(b.n)
    low, high = np.searchsorted(grams, a.g, "left"), np.searchsorted(grams, a.g, "right")
    tall = max(1, CELLS // size)
    for top in range(0, len(a.n), tall):
        rows = min(tall, len(a.n) - top)
        s = slice(a.start[top], a.start[top + rows])
        sums = np.zeros(rows * size)
        first, count, row, v = low[s], high[s] - low[s], a.row[s] - top, a.v[s]
        for t in _slices(count, CHUNK):
            other = order[_spread(first[t], count[t])]
            sums += np.bincount(np.repeat(row[t] * size, count[t]) + b.row[other], np.repeat(v[t], count[t]) * b.v[other], len(sums))
        table = sums.reshape(rows, size)
        least = np.partition(table, size - k, axis=1)[:, size - k] if size > k else np.zeros(rows)
        x, y = np.nonzero((table > 0) & (table >= least[:, None] - 2e-9))
        yield pa.RecordBatch.from_arrays([pa.array(a.n[x + top]), pa.array(b.n[y]), pa.array(table[x, y])], ["a", "b", "sim"])


def block_best(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(i, j, sim): the k texts j of the right side with the largest products for each text i of the left one, of those above zero; products are compared to nine places, ties go to the lesser j.

    Every block of the left side meets every block of the right one, so this is for a right side of few blocks (a block has some 28,000 windows of 150 letters).
    """
    grams, _ = stored(numbered(right.select("gram").distinct(), ["gram"], "g", 0).select("gram", F.col("g").cast("int").alias("g")), "grams")
    return _best(*(w.join(grams, "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("g", F.col("w").alias("v")))).alias("p")) for w in (left, right)), k)


def list_best(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """block_best of the texts of two stored tables (id, gram, tf) with arrays of each text's distinct n-grams and how often it has them; the weights are of both tables' texts."""
    left, right = (side.where("id is not null") for side in (left, right))
    total = float(sum(side.where(F.size("gram") > 0).count() for side in (left, right)))
    df = left.select("gram").unionByName(right.select("gram")).select(F.explode("gram").alias("gram")).groupBy("gram").agg((F.ln((1 + F.lit(total)) / (1 + F.count("*"))) + 1).alias("idf"))
    own = numbered(right.select(F.explode("gram").alias("gram")).distinct(), ["gram"], "g", 0)
    numbers, _ = stored(df.join(own.select("gram", F.col("g").cast("int").alias("g")), "gram", "left"), "grams")
    w = F.col("tf") * F.col("idf")

    def vectors(side: DataFrame) -> DataFrame:
        rows = side.select("id", F.explode(F.arrays_zip("gram", "tf")).alias("_p")).select("id", "_p.gram", "_p.tf").join(numbers, "gram")
        # n-grams that the right side lacks make a text longer only
        lists = rows.groupBy("id").agg(F.collect_list(F.when(F.col("g").isNotNull(), F.struct("g", w.alias("v")))).alias("p"), F.sqrt(F.sum(w * w)).alias("_size"))
        return lists.where(F.size("p") > 0).select("id", F.transform(F.array_sort("p"), lambda x: F.struct(x["g"].alias("g"), (x["v"] / F.col("_size")).alias("v"))).alias("p"))

    return _best(vectors(left), vectors(right), k)


def _best(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """The best matches of vectors (id, p) with arrays p of n-grams' numbers g, in order, and weights v."""

    def vectors(lists: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        lists, _ = stored(lists, "lists")
        ids, _ = stored(numbered(lists.select("id"), ["id"], "n", 0), "numbers")
        found, _ = stored(lists.join(ids, "id").select("n", F.col("p.g").alias("g"), F.col("p.v").alias("v")), "vectors")
        texts, weights = found.agg(F.count("*"), F.sum(F.size("g"))).first()
        each = max(1, POSTINGS * texts // weights) if texts else POSTINGS
        return found.withColumn("own", F.expr(f"cast(n div {each} as int)")), ids, max(1, -(-texts // each))

    (a, i, rows), (b, j, columns) = vectors(left), vectors(right)
    sent = a.select((F.col("own") * columns).alias("own"), "n", "g", "v").select(F.explode(F.expr(f"sequence(own, own + {columns} - 1)")).alias("pair"), F.lit(False).alias("second"), "n", "g", "v")
    sent = sent.unionByName(b.select(F.explode(F.expr(f"transform(sequence(0, {rows} - 1), r -> cast(r * {columns} + own as int))")).alias("pair"), F.lit(True).alias("second"), "n", "g", "v"))

    def run(group: pa.Table) -> pa.Table:
        second = group.column("second")
        sides = group.filter(pc.invert(second)).sort_by("n"), group.filter(second).sort_by("n")
        found = list(best_of(*(Block(s) for s in sides), k)) if all(s.num_rows for s in sides) else []
        return pa.Table.from_batches(found, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())]))

    found, _ = stored(sent.repartition(rows * columns, "pair").groupBy("pair").applyInArrow(run, "a long, b long, sim double"), "block-best")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.round("sim", 9).desc(), "b"))
    kept = found.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return kept.join(i.select(F.col("n").alias("a"), F.col("id").alias("i")), "a").join(j.select(F.col("n").alias("b"), F.col("id").alias("j")), "b").select("i", "j", "sim")
