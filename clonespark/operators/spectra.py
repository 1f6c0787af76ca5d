"""Family analytics: sizes, mutation spectra, dN/dS and length quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonespark.functions import sequences as S


def analytic_range(records: DataFrame) -> DataFrame:
    return records.where("cdr3_length % 3 = 0 and cdr3_length < 106 and cdr3_length > 14")


def size_spectrum(records: DataFrame, family: str) -> DataFrame:
    """(cdr3_length, size, families)."""
    sizes = records.groupBy("cdr3_length", family).agg(F.count("*").alias("size"))
    return sizes.groupBy("cdr3_length", "size").agg(F.count("*").alias("families"))


def family_sample(records: DataFrame, family: str, least: int = 100, take: int = 100) -> DataFrame:
    """At most ``take`` rows (least hashes of sequence_id) of each family of at least ``least`` rows."""
    keys = ["cdr3_length", family]
    large = records.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.md5(F.col("sequence_id").cast("binary")), "sequence_id"))
    return records.join(large, keys, "left_semi").withColumn("_rank", rank).where(F.col("_rank") <= take).drop("_rank")


def mutation_spectrum(sample: DataFrame, family: str) -> DataFrame:
    """(cdr3_length, family, pos, nt, n): rows of the family that differ from the germline base nt at a position (from 0)."""
    bases = sample.select("cdr3_length", family, F.posexplode(F.arrays_zip(F.split("alt_germline_alignment", "").alias("g"), F.split("alt_sequence_alignment", "").alias("s"))).alias("pos", "x"))
    changed = bases.where("x.g not in ('N', '.') and x.s <> 'N' and x.g <> x.s")
    return changed.groupBy("cdr3_length", family, "pos", F.col("x.g").alias("nt")).agg(F.count("*").alias("n"))


def dnds(sample: DataFrame, family: str) -> DataFrame:
    """(cdr3_length, family, n, s): positions of amino acid changes, and the further changed bases, against the least mutated row."""
    keys = ["cdr3_length", family]
    naive = sample.groupBy(*keys).agg(F.min_by("cdr3", F.struct("mutation_count", "sequence_id")).alias("_naive"))
    rows = sample.select(*keys, "cdr3").distinct().join(naive, keys)

    def changed(a, b):
        pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
        return F.array_compact(F.transform(pairs, lambda p, i: F.when(p["x"] != p["y"], i)))

    rows = rows.withColumn("_nt", changed(F.col("cdr3"), F.col("_naive"))).withColumn("_aa", changed(S.translated(F.col("cdr3")), S.translated(F.col("_naive"))))
    # positions of a family are at most the letters of a CDR3
    sums = rows.groupBy(*keys).agg(F.size(F.array_distinct(F.flatten(F.collect_set("_nt")))).alias("_s"), F.size(F.array_distinct(F.flatten(F.collect_set("_aa")))).alias("n"))
    return sums.select(*keys, F.col("n"), (F.col("_s") - F.col("n")).alias("s"))


def length_quantiles(records: DataFrame, parts: int = 10) -> DataFrame:
    """(part, cdr3_length): the interpolated quantiles, rounded down."""
    at = F.array(*[F.lit(i / parts) for i in range(parts + 1)])
    return records.agg(F.percentile("cdr3_length", at).alias("q")).select(F.posexplode("q").alias("part", "q")).select("part", F.floor("q").cast("int").alias("cdr3_length"))
