"""Scores of partitions against a truth, from group sizes alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonespark.plans.lineage import stored


def _cells(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n), stored: how many rows have each combination, so that sums over some of the keys need not read the rows again."""
    return stored(df.groupBy(*keys).agg(F.count("*").alias("n")), "cells")[0]


def _sums(cells: DataFrame, by: list[str], *keys: str) -> DataFrame:
    """(by, keys, n): sums of the cells over the other columns, which need no shuffle where there is none; null keys are left out."""
    for k in keys:
        cells = cells.where(F.col(k).isNotNull())
    return cells if {*by, *keys, "n"} == set(cells.columns) else cells.groupBy(*by, *keys).agg(F.sum("n").alias("n"))


def _pairs(cells: DataFrame, *keys: str) -> DataFrame:
    return _sums(cells, [], *keys).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))


def pair_scores(df: DataFrame, partition: str, truth: str = "ground_truth") -> DataFrame:
    """One row (precision, sensitivity): shares of pairs; no pair found is precision 1, no true pair gives nulls.

    Rows without a label are no pair of the partition but count in the truth.
    """
    if truth not in df.columns:
        return df.sparkSession.createDataFrame([(None, None)], "precision double, sensitivity double")
    cells = _cells(df, truth, partition)
    t, p, both = _pairs(cells, truth), _pairs(cells, partition), _pairs(cells, truth, partition)
    one = t.select(F.col("pairs").alias("p")).join(p.select(F.col("pairs").alias("tf")), F.lit(True)).join(both.select(F.col("pairs").alias("tp")), F.lit(True))
    precision = F.when(F.col("p") == 0, None).when(F.col("tf") == 0, 1.0).otherwise(F.col("tp") / F.nullif("tf", F.lit(0)))
    return one.select(precision.cast("double").alias("precision"), F.when(F.col("p") > 0, F.col("tp") / F.nullif("p", F.lit(0))).alias("sensitivity"))


def pair_scores_by(df: DataFrame, partition: str, truth: str, by: list[str]) -> DataFrame:
    """pair_scores in each group of ``by``."""
    pairs, cells = F.expr("n * (n - 1) div 2"), _cells(df, *by, truth, partition)

    def sums(name: str, *keys: str) -> DataFrame:
        return _sums(cells, by, *keys).groupBy(*by).agg(F.sum(pairs).alias(name))

    one = sums("p", truth).join(sums("tf", partition), by, "left").join(sums("tp", truth, partition), by, "left")
    precision = F.when(F.col("p") == 0, None).when(F.coalesce("tf", F.lit(0)) == 0, 1.0).otherwise(F.col("tp") / F.nullif("tf", F.lit(0)))
    return one.select(*by, precision.cast("double").alias("precision"), F.when(F.col("p") > 0, F.coalesce("tp", F.lit(0)) / F.nullif("p", F.lit(0))).alias("sensitivity"))


def _entropy(cells: DataFrame, *keys: str) -> DataFrame:
    """Sum of p log2 p over the groups (not positive)."""
    sizes = cells.groupBy(*keys).agg(F.sum("n").alias("n"))
    # sum n log2 n / N - log2 N, in one pass over the sizes
    return sizes.agg((F.sum(F.col("n") * F.log2("n")) / F.sum("n") - F.log2(F.sum("n"))).alias("h"))


def entropy(df: DataFrame, *keys: str) -> DataFrame:
    return _entropy(df.withColumn("n", F.lit(1)), *keys).select(F.col("h").alias("entropy"))


def variation_of_information(df: DataFrame, partition: str, truth: str = "ground_truth") -> DataFrame:
    """One row (variation_of_information): 0 for equal partitions."""
    cells = _cells(df, truth, partition)
    a, b, both = _entropy(cells, truth), _entropy(cells, partition), _entropy(cells, truth, partition)
    one = a.select(F.col("h").alias("a")).join(b.select(F.col("h").alias("b")), F.lit(True)).join(both.select(F.col("h").alias("c")), F.lit(True))
    return one.select((F.col("a") + F.col("b") - 2 * F.col("c")).alias("variation_of_information"))


def prevalence_by_length(df: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """(cdr3_length, prevalence): the share of pairs within a V and J gene that are truly related."""
    pairs = F.expr("n * (n - 1) div 2")
    true = df.groupBy("cdr3_length", "v_gene", "j_gene", truth).agg(F.count("*").alias("n")).groupBy("cdr3_length").agg(F.sum(pairs).alias("t"))
    every = df.groupBy("cdr3_length", "v_gene", "j_gene").agg(F.count("*").alias("n")).groupBy("cdr3_length").agg(F.sum(pairs).alias("p"))
    return true.join(every, "cdr3_length").select("cdr3_length", (F.col("t") / F.nullif("p", F.lit(0))).alias("prevalence"))


def specificity(df: DataFrame, partition: str, truth: str = "ground_truth") -> DataFrame:
    """One row (specificity): the share of unrelated pairs that the partition keeps apart, over all pairs."""
    cells = _cells(df, truth, partition)
    # of the cells, as the rows would be clustered once more to be counted
    n = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.expr("n * (n - 1) div 2").alias("all"))
    t, p, both = _pairs(cells, truth), _pairs(cells, partition), _pairs(cells, truth, partition)
    one = n.join(t.select(F.col("pairs").alias("t")), F.lit(True)).join(p.select(F.col("pairs").alias("p")), F.lit(True)).join(both.select(F.col("pairs").alias("b")), F.lit(True))
    return one.select(((F.col("all") - F.col("t") - F.col("p") + F.col("b")) / F.nullif(F.col("all") - F.col("t"), F.lit(0))).alias("specificity"))


def impurity(df: DataFrame, cluster: str, *columns: str) -> DataFrame:
    """For clusters of more than one row, the further distinct values of each column."""
    aggs: list[Column] = [F.count("*").alias("size"), *[(F.countDistinct(c) - 1).alias(f"{c}_errors") for c in columns]]
    return df.groupBy(cluster).agg(*aggs).where("size > 1")


def cluster_stats(df: DataFrame, cluster: str, text: str) -> DataFrame:
    """(cluster, size, lengths): size and number of text lengths of clusters of more than one row."""
    return df.groupBy(cluster).agg(F.count("*").alias("size"), F.countDistinct(F.length(text)).alias("lengths")).where("size > 1")


def in_clone(df: DataFrame, *clusters: str) -> DataFrame:
    """df with ``in_<cluster>``: 1 if the row's cluster has more rows. Sizes are aggregated and joined back."""
    for c in clusters:
        sizes = df.groupBy(c).agg((F.count("*") > 1).cast("int").alias(f"in_{c}"))
        df = df.join(sizes, c, "left")
    return df


def loglog_fit(df: DataFrame, x: str, y: str, by: list[str], least: str = "0") -> DataFrame:
    """Slope and intercept of ln y over ln x, for x of at least ``least`` (SQL)."""
    return df.where(f"{x} >= {least} and {x} > 0 and {y} > 0").groupBy(*by).agg(F.regr_slope(F.ln(y), F.ln(x)).alias("slope"), F.regr_intercept(F.ln(y), F.ln(x)).alias("intercept"))
