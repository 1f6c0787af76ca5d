"""Alignment-free clusters: TF-IDF of character n-grams, cosine matches, nearest distances and label propagation.

Cosine matches above a bound use prefix filtering. With the n-grams of all texts in one order, rarest first, a text's prefix
ends where the rest of its (unit) vector is shorter than a share of the bound. What two texts have in common outside both prefixes
is a product of one's rest, so it adds no more than that length, and only pairs whose prefixes make up for the difference are candidates. So
frequent n-grams, which make the most pairs, are mostly never joined on. The few candidates are then compared as a whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from clonespark.functions import sequences as S
from clonespark.operators.blocks import block_matches, list_best, list_matches
from clonespark.operators.components import connected_components
from clonespark.operators.numbering import numbered
from clonespark.operators.selection import percentiles
from clonespark.plans.lineage import remove, stored


#: Letters of the texts that one task counts n-grams of.
LETTERS = 1 << 22
#: N-grams of texts that a task holds as lists.
GRAMS = 1 << 18


def tokens(texts: DataFrame, window: int | None = 150, n: int = 5) -> DataFrame:
    """(id, gram, tf) of the last ``window`` letters of each text (id, text), or of whole texts.

    Texts are shuffled, not their n-grams: those of an id are counted in the task that has its texts, and there are as many tasks as the letters ask for.
    """
    seen = texts.where("text is not null").select("id", (F.col("text") if window is None else S.tail(F.col("text"), window)).alias("text"))
    letters = seen.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-letters // LETTERS))
    grams = seen.repartition(parts, "id").select("id", F.explode(S.ngrams("text", n)).alias("gram"))
    return grams.groupBy("id", "gram").agg(F.count("*").alias("tf"))


def counted(texts: DataFrame, window: int | None = 150, n: int = 5) -> DataFrame:
    """(id, gram, tf), a row for each id: the distinct n-grams of its texts' last ``window`` letters, and how often they have them; as tokens() has them, but in arrays."""
    seen = texts.where("text is not null").select("id", S.cleaned(F.col("text") if window is None else S.tail(F.col("text"), window)).alias("text"))
    kind = texts.schema["id"].dataType
    schema = StructType([StructField("id", kind), StructField("gram", ArrayType(StringType())), StructField("tf", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, start, found, held = b.column("id"), 0, [], 0
            for i in range(b.num_rows):
                own: Counter[str] = Counter()
                for text in b.column("text")[i].as_py():
                    own.update(text[k : k + n] for k in range(len(text) - n + 1))
                found.append(own)
                held += len(own)
                if held > GRAMS or i == b.num_rows - 1:
                    lists = [pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(found)), *lists], ["id", "gram", "tf"])
                    start, found, held = i + 1, [], 0

    return seen.groupBy("id").agg(F.collect_list("text").alias("text")).mapInArrow(run, schema)


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(gram, df, idf) with idf = ln((1 + N) / (1 + df)) + 1, N the texts that have n-grams."""
    total = tf.agg(F.countDistinct("id").cast("double").alias("_n"))
    counts = tf.groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(total))  # one row
    return counts.select("gram", "df", (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(tf: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """(id, gram, w, df, and what w is made of: tf, idf, size): tf * idf over the text's Euclidean length."""
    idf = document_frequencies(tf) if idf is None else idf
    raw = tf.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))  # a text has as many rows as n-grams in its window
    return raw.withColumn("size", size).select("id", "gram", (F.col("w") / F.col("size")).alias("w"), "df", F.col("tf").cast("int").alias("tf"), "idf", "size")


def stored_weights(texts: DataFrame, window: int | None = 150, n: int = 5) -> DataFrame:
    """The weights of texts (id, text) as a table, for the several passes that matching makes over them."""
    tf, _ = stored(tokens(texts, window, n), "tokens")
    return stored(weights(tf), "weights")[0]


#: Pieces that an n-gram with very many texts is dealt to, and the length, as a share of the bound, of what a prefix leaves of its vector.
SALTS, REST = 16, 0.6
#: The share of the bound that may be left for the pairs of texts that are compared as a whole, where blocks meet.
LEFT = 0.9


def _prefix(w: DataFrame, rest: float) -> DataFrame:
    """(id, gram, w) of each text's prefix: its n-grams in the order of (df, gram), up to where the others are no longer than ``rest``."""
    by = Window.partitionBy("id").orderBy("df", "gram").rowsBetween(0, Window.unboundedFollowing)
    left = w.withColumn("_left", F.sum(F.col("w") * F.col("w")).over(by))
    return left.where(F.col("_left") >= rest * rest * (1 - 1e-9)).select("id", "gram", "w") if rest > 0 else w.select("id", "gram", "w")


def _across(left: DataFrame, right: DataFrame, least: float, rest: float) -> DataFrame:
    """(i, j, sim) of the texts of two tables. An n-gram's pairs are dealt to SALTS tasks, so a frequent one is not one task's."""
    a = _prefix(left, rest).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).alias("a")
    b = _prefix(right, rest).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("b")
    pairs = a.join(b, F.expr("a.gram = b.gram and a._salt = b._salt")).groupBy(F.col("a.id").alias("i"), F.col("b.id").alias("j")).agg(F.sum(F.expr("a.w * b.w")).alias("sim"))
    if rest > 0:  # what the prefixes leave adds no more than ``rest``, so few pairs are compared as a whole
        x, y = left.select(F.col("id").alias("i"), "gram", F.col("w").alias("_a")), right.select(F.col("id").alias("j"), "gram", F.col("w").alias("_b"))
        pairs = pairs.where(F.col("sim") >= (least - rest) * (1 - 1e-9)).select("i", "j")
        pairs = pairs.join(x, "i").join(y, ["j", "gram"]).groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("sim"))
    return pairs.where(F.col("sim") > least)


def cosine_matches(left: DataFrame, right: DataFrame | None = None, least: float = 0.5, top: int | None = 1800) -> DataFrame:
    """(i, j, sim) for the pairs of texts whose weights have a product above ``least``; at most ``top`` for each i, best first.

    Without a right side the texts match among themselves, each also with itself. Both sides' weights need one idf table.
    With least = 0 every common n-gram is joined on; for the best few of each text there is ``top_matches``. Weights should be stored (stored_weights), as they are read several times.
    Matches among one table's texts are found block against block (``blocks.py``).
    """
    rest = least * REST
    if right is None:
        every = left.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("sim")).select(F.col("id").alias("i"), F.col("id").alias("j"), "sim")
        sims = _both_ways(block_matches(left, least, least * LEFT), every)
    else:
        sims = _across(left, right, least, rest)
    return _best(sims, top)


def text_matches(texts: DataFrame, least: float = 0.5, top: int | None = 1800, window: int | None = 150, n: int = 5) -> DataFrame:
    """cosine_matches among texts (id, text), without a table that has a row for each weight."""
    return _best(_list_matches(stored(counted(texts, window, n), "counted")[0], least), top)


def _list_matches(lists: DataFrame, least: float) -> DataFrame:
    every = lists.where(F.size("gram") > 0).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("sim"))  # weights are of length one
    return _both_ways(list_matches(lists, least, least * LEFT), every)


def _both_ways(pairs: DataFrame, every: DataFrame) -> DataFrame:
    sims, _ = stored(pairs, "matches")
    return sims.unionByName(sims.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim")).unionByName(every)


def _best(sims: DataFrame, top: int | None) -> DataFrame:
    if top is None:
        return sims
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.round("sim", 9).desc(), "j"))
    return sims.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank")


def nearest_distance(matches: DataFrame, ids: DataFrame, place: int = 2) -> DataFrame:
    """(id, distance): 1 - the similarity at a place (2: the best but one, as the best is the text itself); 1 without one."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.col("sim").desc(), "j"))
    at = matches.withColumn("_rank", rank).where(F.col("_rank") == place).select(F.col("i").alias("id"), "sim")
    return ids.select("id").join(at, "id", "left").select("id", (1 - F.coalesce("sim", F.lit(0.0))).alias("distance"))


def percentile_threshold(distances: DataFrame, percent: float = 0.1) -> DataFrame:
    """One row (threshold): the percentile of the distances, interpolated."""
    return distances.sparkSession.createDataFrame([(percentiles(distances, "distance", [percent / 100.0])[0],)], "threshold double")


def component_clusters(matches: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """(id, cluster): components of the matches above 1 - threshold; the cluster is its least id."""
    roots = connected_components(matches.where(F.col("sim") > 1 - threshold).select("i", "j"))
    return ids.select("id").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("cluster"))


def greedy_labels(near: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, cluster): labels spread in the order of ids over matches (i, j): a text with two matches or more (it may be its own) hands the first label that one of them has,
    taken in the order of their ids, or else a new one, to all of them, whatever label they had. The cluster is the least id with the same last label.

    Which text hands the label on to which does not depend on the labels: a match has one if an earlier text matches it too, and then it has the label of the last of
    these. So every text points to one earlier text, or to itself if it makes a new label, and labels are the roots of these pointers, found by doubling. Places in the order of (j, i) replace
    windows over all that match one text, so a text that very many match is no single task's.
    """
    near, _ = stored(near.select("i", "j"), "near")  # read three times: counted, sampled for its ranges, and sorted
    counts = near.groupBy("i").agg(F.count("*").alias("_n")).where("_n > 1").select("i")
    ordered = numbered(near.join(counts, "i", "left_semi").select("i", "j"), ["j", "i"], "_place", 0)
    ordered, _ = stored(ordered, "ordered")
    before = ordered.select((F.col("_place") + 1).alias("_place"), F.col("j").alias("_j"), F.col("i").alias("_i"))
    known = ordered.join(before, "_place", "left").select("i", "j", F.when(F.col("j") == F.col("_j"), F.col("_i")).alias("p"))
    pointer = known.groupBy("i").agg(F.min(F.when(F.col("p").isNotNull(), F.struct("j", "p")))["p"].alias("p"))
    to, path = stored(pointer.select("i", F.coalesce("p", "i").alias("to")), "pointers")
    while True:
        step = to.join(to.select(F.col("i").alias("to"), F.col("to").alias("_next")), "to").select("i", F.col("_next").alias("to"), (F.col("_next") != F.col("to")).alias("_moved"))
        table, new = stored(step, "pointers")
        remove(to.sparkSession, path)
        to, path = table.drop("_moved"), new
        if table.where("_moved").isEmpty():
            break
    last = ordered.groupBy("j").agg(F.max("i").alias("i"))
    label, _ = stored(last.join(to, "i").select(F.col("j").alias("id"), "to"), "labels")
    found = label.join(label.groupBy("to").agg(F.min("id").alias("cluster")), "to")
    return ids.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def greedy_clusters(matches: DataFrame, ids: DataFrame, threshold: float | str) -> DataFrame:
    """(id, cluster): greedy_labels over matches (i, j, sim) above 1 - threshold; threshold: a number, or a column of ``ids`` with one for each text."""
    one = ids.select("id", (F.lit(float(threshold)) if isinstance(threshold, float) else F.col(threshold)).alias("_t"))
    near = matches.join(one, F.col("i") == F.col("id")).where("sim > 1 - _t").select("i", "j")
    return greedy_labels(near, ids)


def greedy_by_distance(distances: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """(id, cluster): greedy_labels over pairs (i, j, distance) below the threshold; pairs are there both ways round, each text's with itself among them."""
    return greedy_labels(distances.where(F.col("distance") < threshold).select("i", "j"), ids)


def specificity_sweep(distances: DataFrame, negatives: DataFrame, percents: list[float], size: int) -> DataFrame:
    """(percent, threshold, specificity): for thresholds at percentiles of the negatives' distances, the share of texts without a clone beyond them.

    distances: (distance, label), label 0 for texts without a clone; size: texts altogether, which shrinks the thresholds.
    """
    import math

    at = percentiles(negatives, "distance", [p / 100.0 for p in percents])
    factor = 1 - 0.09 * math.log(size / 5000)
    sweep = distances.sparkSession.createDataFrame([(float(p), None if t is None else t * factor) for p, t in zip(percents, at, strict=True)], "percent double, threshold double")
    lone = distances.where("label = 0").select("distance")
    kept = lone.join(F.broadcast(sweep), F.expr("distance > threshold"), "right").groupBy("percent", "threshold").agg(F.count("distance").alias("kept"))
    total = lone.agg(F.count("*").alias("total"))
    return kept.join(total, F.lit(True)).select("percent", "threshold", (F.col("kept") / F.nullif("total", F.lit(0))).alias("specificity"))


def alignment_free(repertoire: DataFrame, negatives: DataFrame, window: int | None = 150, percent: float = 0.1, greedy: bool = False) -> DataFrame:
    """(id, cluster) of a repertoire (id, text), with the threshold from its nearest distances to a negative set (text)."""
    lists, _ = stored(counted(repertoire, window), "counted")  # for the matches with both sides
    strangers, _ = stored(counted(negatives.select(F.monotonically_increasing_id().alias("id"), "text"), window), "counted")
    far = list_best(lists, strangers, 2)  # the second nearest decides
    threshold = percentile_threshold(nearest_distance(far, repertoire), percent).first()[0]
    matches = _list_matches(lists, 0.5)
    return greedy_clusters(matches, repertoire, float(threshold)) if greedy else component_clusters(matches, repertoire, float(threshold))


def cross_group_distances(records: DataFrame, clone: str, group: str, text: str, distance: Callable[[Column, Column], Column] | None = None, each: int = 4096) -> DataFrame:
    """(clone, nearest): within each clone that has several groups, the least normalised distance of texts of two of its groups.

    distance: of two columns of texts, by default the offset distance. Equal texts of a group are compared once, and one side of a clone with more than ``each`` texts
    is dealt to several tasks. Rows with a null in any of the columns take no part.
    """
    from clonespark.functions.offsets import offset_distance_udf

    rows, _ = stored(records.select(F.col(clone).alias("_c"), F.col(group).alias("_g"), F.col(text).alias("_x")).na.drop().distinct(), "groups")
    large = rows.groupBy("_c").agg(F.count("*").alias("_n")).where(F.col("_n") > each)
    rows = rows.join(large, "_c", "left").withColumn("_salts", F.coalesce(F.ceil(F.col("_n") / each), F.lit(1)).cast("int"))
    a = rows.withColumn("_s", F.pmod(F.xxhash64("_x"), F.col("_salts")).cast("int")).alias("a")
    b = rows.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).alias("b")
    x, y = F.col("a._x"), F.col("b._x")
    pairs = a.join(b, F.expr("a._c = b._c and a._s = b._s and a._g < b._g"))
    d = S.length_normalised((distance or offset_distance_udf)(x, y), x, y)
    return pairs.select(F.col("a._c").alias(clone), d.alias("_d")).groupBy(clone).agg(F.min("_d").alias("nearest"))
