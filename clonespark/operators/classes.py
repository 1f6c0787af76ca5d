"""From records to classes: normalised columns, class sizes, samples and distance histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonespark.functions import sequences as S
from clonespark.operators.histograms import LOCAL, local_histogram
from clonespark.operators.numbering import numbered
from clonespark.plans.lineage import stored
from clonespark.schema import ANY, CLASS, ROW, WORKING, Params


def mutation_count() -> Column:
    """Letters in which a record's alignments differ; null if one is null."""
    a, b = F.col("alt_sequence_alignment"), F.col("alt_germline_alignment")
    return F.when(a.isNotNull() & b.isNotNull(), S.letter_distance(a, b)).cast("int")


def normalise(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The working columns; each is derived only where the input lacks it, and rows with a null in any are dropped.

    A ``_row`` column and the columns in ``keep`` pass through.
    """
    new: dict = {}
    has = set(df.columns)
    if "v_gene" not in has:
        new["v_gene"] = S.gene("v_call")
    if "j_gene" not in has:
        new["j_gene"] = S.gene("j_call")
    if "cdr3" not in has:
        new["cdr3"] = S.cdr3("junction")
    for kind in ("sequence", "germline"):
        if f"alt_{kind}_alignment" not in has:
            new[f"alt_{kind}_alignment"] = F.concat(f"v_{kind}_alignment", f"j_{kind}_alignment")
    df = df.withColumns(new).withColumn("cdr3_length", F.length("cdr3").cast("int"))
    more = [c for c in (ROW, *keep) if c in df.columns and c not in WORKING]
    df = df.withColumn("mutation_count", mutation_count())
    # a null mutation count has a null alignment; left out here so that queries without it need not compute it
    return df.select(*more, *WORKING).na.drop(subset=[c for c in WORKING if c != "mutation_count"])


def normalised_keys(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What the CDR3 methods read of normalise(df): the ids, classes and CDR3s of the same rows, and no alignments. Those that df lacks are not asked for."""
    lacking = [c for kind in ("sequence", "germline") for c in (f"v_{kind}_alignment", f"j_{kind}_alignment") if c not in df.columns and f"alt_{kind}_alignment" not in df.columns]
    rows = normalise(df.withColumns({c: F.lit("") for c in lacking}), keep)
    return rows.select(*[c for c in (ROW, "sequence_id", *keep, *CLASS, "cdr3") if c in rows.columns])


def with_row_ids(df: DataFrame) -> DataFrame:
    """Rows with a number of their own, stored, so that results can be joined back, dropped rows and repeated ids included."""
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")[0]


def with_sequence_id(df: DataFrame) -> DataFrame:
    """A sequence_id where the input has none: a digest of the row and, among equal rows, their rank."""
    if "sequence_id" in df.columns:
        return df.withColumn("sequence_id", F.col("sequence_id").cast("string"))
    digest = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    rank = F.row_number().over(Window.partitionBy("_digest").orderBy("_digest"))
    numbered = df.withColumn("_digest", digest).withColumn("_rank", rank)
    return numbered.withColumn("sequence_id", F.when(F.col("_rank") == 1, F.col("_digest")).otherwise(F.concat_ws("-", "_digest", "_rank"))).drop("_digest", "_rank")


def clean_or_keep(df: DataFrame, suffix: str) -> DataFrame:
    """sequence_id without the chain's suffix, and made where there is none."""
    df = with_sequence_id(df)
    return df.withColumn("sequence_id", S.clean_id("sequence_id", suffix))


def paired(heavy: DataFrame, light: DataFrame) -> DataFrame:
    """Normalised heavy and light chains of one id as one record: texts are joined, numbers added; ``_h`` and ``_k`` keep the parts."""
    columns = [c for c in WORKING if c != "sequence_id"]
    h = heavy.select("sequence_id", *([ROW] if ROW in heavy.columns else []), *[F.col(c).alias(f"{c}_h") for c in columns])
    k = light.select("sequence_id", *[F.col(c).alias(f"{c}_k") for c in columns])
    both = h.join(k, "sequence_id")
    numbers = ("cdr3_length", "mutation_count")
    return both.withColumns({c: F.col(f"{c}_h") + F.col(f"{c}_k") if c in numbers else F.concat(f"{c}_h", f"{c}_k") for c in columns})


def create_classes(records: DataFrame) -> DataFrame:
    """Class sizes, with a row for each length over all genes; class_id numbers them from the largest."""
    sizes = records.groupBy(*CLASS).agg(F.count("*").alias("sequence_count"))
    sizes = sizes.withColumn("pair_count", F.expr("sequence_count * (sequence_count - 1) div 2"))
    lengths = sizes.groupBy("cdr3_length").agg(F.sum("sequence_count").alias("sequence_count"), F.sum("pair_count").alias("pair_count"))
    every = sizes.unionByName(lengths.select(F.lit(ANY).alias("v_gene"), F.lit(ANY).alias("j_gene"), "cdr3_length", "sequence_count", "pair_count"))
    return numbered(every, [F.col("sequence_count").desc(), *CLASS], "class_id").withColumn("class_id", F.col("class_id").cast("int"))


def class_sample(records: DataFrame, classes: DataFrame, params: Params = Params()) -> DataFrame:
    """(class_id, cdr3_length, sequence_id, cdr3) of the modelled classes; large classes are sampled to about nmax pairs.

    The rows with the least hashes of their ids are taken, so the sample is the same in every run.
    """
    modelled = classes.where(f"v_gene <> '{ANY}' and pair_count > 0 and {params.legal()}")
    share = F.least(F.sqrt(F.lit(float(params.nmax)) / F.col("pair_count")), F.lit(1.0))
    take = F.round(share * F.col("sequence_count"))
    # the hashes are uniform, so of a class's n rows those below (take + 8 sqrt(take) + 32) / n hold the ``take`` least but for a chance of 1e-14
    most = (take + 8 * F.sqrt(take) + 32) / F.col("sequence_count")
    modelled = modelled.select(*CLASS, "class_id", take.alias("_take"), most.alias("_most"))
    digest = F.md5(F.concat(F.lit(f"{params.seed}:"), F.col("sequence_id")).cast("binary"))
    ranked = records.select(*CLASS, "sequence_id", "cdr3").join(modelled, CLASS).withColumn("_hash", digest)
    near = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) <= F.col("_most")
    order = Window.partitionBy("class_id").orderBy("_hash", "sequence_id")
    ranked = ranked.where(near)
    return ranked.withColumn("_rank", F.row_number().over(order)).where("_rank <= _take").select("class_id", "cdr3_length", "sequence_id", "cdr3")


def distance_histogram(sample: DataFrame) -> DataFrame:
    """(class_id, cdr3_length, d, n): the numbers of pairs of each class at each distance that occurs.

    Equal CDR3s are counted once with their number first, and compared in tasks that hold a class (``histograms.py``); classes of very many distinct ones are joined.
    """
    counts = sample.groupBy("class_id", "cdr3_length", "cdr3").agg(F.count("*").alias("k"))
    counts, _ = stored(counts, "counts")  # a sample is bounded
    large, _ = stored(counts.groupBy("class_id").agg(F.count("*").alias("_n")).where(F.col("_n") > LOCAL).select("class_id"), "large")
    if large.isEmpty():
        unequal = local_histogram(counts)
    else:
        unequal = local_histogram(counts.join(large, "class_id", "left_anti")).unionByName(_joined_histogram(counts.join(large, "class_id", "left_semi")))
    equal = counts.where("k > 1").select("class_id", "cdr3_length", F.lit(0).alias("d"), F.expr("k * (k - 1) div 2").alias("n"))
    return unequal.unionByName(equal).groupBy("class_id", "cdr3_length", "d").agg(F.sum("n").alias("n"))


def _joined_histogram(counts: DataFrame) -> DataFrame:
    words = S.word_count(counts, "cdr3")
    e = [f"_e{i}" for i in range(words)]
    counts = counts.withColumns(dict(zip(e, S.packed(F.col("cdr3"), words), strict=True))).withColumn("_plain", S.plain(F.col("cdr3")))
    a, b = counts.alias("a"), counts.alias("b")
    fast = S.packed_distance([F.col(f"a.{c}") for c in e], [F.col(f"b.{c}") for c in e])
    d = F.when(F.col("a._plain") & F.col("b._plain"), fast).otherwise(S.letter_distance(F.col("a.cdr3"), F.col("b.cdr3")))
    return a.join(b, F.expr("a.class_id = b.class_id and a.cdr3 < b.cdr3")).select("a.class_id", "a.cdr3_length", d.cast("int").alias("d"), F.expr("a.k * b.k").alias("n"))
