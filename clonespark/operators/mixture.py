"""The distance mixture of each class: null model, fits, parameters and thresholds.

A class is one row with its histogram as an array, so the fits are array expressions without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.schema import ANY, Params

SMALL = 1e-5
#: The greatest length whose factorial is a double.
LONGEST = 170
ITERATIONS = 10
#: Used where a class has no fit of its own.
PREVALENCE, MEAN_DISTANCE = 0.2, 0.04


def default_null(spark: SparkSession, lengths: range = range(12, 148, 3)) -> DataFrame:
    """(l, cdf): distances of unrelated sequences as Binomial(l, 3/4); cdf[d] is the share of distances up to d, d = 0..l."""
    rows = []
    for n in lengths:
        total, cdf = 0, []
        for d in range(n + 1):
            total += math.comb(n, d) * 3**d
            cdf.append(total / 4**n)
        rows.append((n, cdf))
    return spark.createDataFrame(rows, "l int, cdf array<double>")


def require_lengths(classes: DataFrame, null: DataFrame, params: Params) -> None:
    """ValueError where classes that are to be modelled have lengths that the null model lacks, or that are beyond LONGEST: they would get no fit."""
    lengths = classes.where(params.legal()).select("cdr3_length").distinct()
    lacking = lengths.join(null.select(F.col("l").alias("cdr3_length")), "cdr3_length", "left_anti").union(lengths.where(F.col("cdr3_length") > LONGEST))
    found = sorted(r[0] for r in lacking.limit(10).collect())
    if found:
        raise ValueError(f"the null model has no rows for the lengths {found}; set max_length or give a longer model (up to {LONGEST})")


def null_pmf(null: DataFrame) -> DataFrame:
    """(l, d, p0): the null probabilities; the last one takes what is left."""
    return null.select("l", F.posexplode(_p0(F.col("cdf"), F.col("l"))).alias("d", "p0"))


def _p0(cdf: Column, n: Column) -> Column:
    before = lambda b: F.when(b == 0, F.lit(0.0)).otherwise(F.get(cdf, b - 1))
    return F.transform(F.sequence(F.lit(0), n), lambda b: F.when(b < n, F.get(cdf, b)).otherwise(1.0) - before(b))


def _factorials() -> Column:
    return F.array(*[F.lit(float(math.factorial(k))) for k in range(LONGEST + 1)])


def _pmf(kind: str, mu: Column, b: Column, factorial: Column) -> Column:
    if kind == "geometric":
        return F.pow(mu / (mu + 1), b) / (mu + 1)
    return F.pow(mu, b) * F.exp(-mu) / factorial


def binned(histogram: DataFrame, null: DataFrame) -> DataFrame:
    """One row for each class: (class_id, l, total, bins), bins an array of (b, h, p0, f) with f the factorial of b."""
    one = histogram.groupBy("class_id", F.col("cdr3_length").alias("l")).agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("_n"))
    one = one.join(null.select("l", _p0(F.col("cdf"), F.col("l")).alias("_p0")), "l")
    bins = F.transform(
        F.sequence(F.lit(0), F.col("l")),
        lambda b: F.struct(b.alias("b"), F.coalesce(F.try_element_at("_n", b), F.lit(0)).cast("double").alias("h"), F.get("_p0", b).alias("p0"), F.get(_factorials(), b).alias("f")),
    )
    total = lambda bins: F.aggregate(bins, F.lit(0.0), lambda s, x: s + x["h"])
    return one.select("class_id", "l", bins.alias("bins")).withColumn("total", total(F.col("bins")))


def fitted(kind: str) -> Column:
    """(rho, mu): ten rounds of expectation and maximisation from the histogram in ``bins``."""
    bins, mu0 = F.col("bins"), 0.02 * F.col("l")
    rho0 = F.greatest(F.least(F.get(bins, F.lit(0))["h"] / F.col("total") * (1 + mu0), F.lit(1.0)), F.lit(0.1))

    def step(theta: Column, _: Column) -> Column:
        weighed = F.transform(bins, lambda x: F.struct(x["b"].alias("b"), x["h"].alias("h"), (theta["rho"] * _pmf(kind, theta["mu"], x["b"], x["f"])).alias("p"), ((1 - theta["rho"]) * x["p0"]).alias("q")))
        shares = F.transform(weighed, lambda x: F.struct(x["b"].alias("b"), (x["h"] * x["p"] / (x["p"] + x["q"] + SMALL)).alias("p"), (x["h"] * x["q"] / (x["p"] + x["q"] + SMALL)).alias("q")))
        sums = F.aggregate(
            shares,
            F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"), F.lit(0.0).alias("bp")),
            lambda s, x: F.struct((s["p"] + x["p"]).alias("p"), (s["q"] + x["q"]).alias("q"), (s["bp"] + x["b"] * x["p"]).alias("bp")),
            lambda s: F.struct(F.least(s["p"] / (s["p"] + s["q"] + SMALL), F.lit(1.0)).alias("rho"), (s["bp"] / (s["p"] + SMALL)).alias("mu")),
        )
        return sums

    return F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), F.struct(rho0.alias("rho"), mu0.alias("mu")), step)


def fit_error(kind: str, theta: Column) -> Column:
    """Root of the summed squared differences of histogram and mixture below a fifth of the length."""
    near = F.filter("bins", lambda x: x["b"] < 0.2 * F.col("l"))
    model = lambda x: theta["rho"] * _pmf(kind, theta["mu"], x["b"], x["f"]) + (1 - theta["rho"]) * x["p0"]
    return F.sqrt(F.aggregate(near, F.lit(0.0), lambda s, x: s + F.pow(x["h"] / F.col("total") - model(x), F.lit(2.0))))


def fit_classes(bins: DataFrame, params: Params = Params()) -> DataFrame:
    """(class_id, rho_geo, mu_geo, rho_poisson, mu_poisson, error_geo, error_poisson) of each class with a histogram."""
    fits = bins.withColumn("geo", fitted("geometric")).withColumn("poi", fitted("poisson"))
    own = F.col("poi" if params.error_of_own_fit else "geo")
    return fits.select(
        "class_id", F.col("geo.rho").alias("rho_geo"), F.col("geo.mu").alias("mu_geo"), F.col("poi.rho").alias("rho_poisson"), F.col("poi.mu").alias("mu_poisson"),
        fit_error("geometric", F.col("geo")).alias("error_geo"), fit_error("poisson", own).alias("error_poisson"),
    )


def with_parameters(classes: DataFrame, fits: DataFrame) -> DataFrame:
    """classes with prevalence and mean distance; the effective ones have defaults where there is no fit."""
    both = classes.join(fits, "class_id", "left").withColumn("prevalence", F.least("rho_poisson", "rho_geo")).withColumn("mean_distance", F.col("mu_poisson") / F.col("cdr3_length"))
    both = both.withColumn("effective_prevalence", F.coalesce("prevalence", F.lit(PREVALENCE))).withColumn("effective_mean_distance", F.coalesce("mean_distance", F.lit(MEAN_DISTANCE)))
    return both.select(*classes.columns, "prevalence", "error_geo", "error_poisson", "mean_distance", "effective_prevalence", "effective_mean_distance")


def required_odds(prevalence: Column, precision: float) -> Column:
    return prevalence / (1 + SMALL - prevalence) * (1 - precision) / precision


def with_thresholds(classes: DataFrame, null: DataFrame, params: Params = Params()) -> DataFrame:
    """classes with the largest distances that keep the wanted precision, and that reach the wanted sensitivity."""
    table = classes.join(null.select(F.col("l").alias("cdr3_length"), "cdf"), "cdr3_length", "left")
    n, mu = F.col("cdr3_length"), F.col("effective_mean_distance") * F.col("cdr3_length")
    factorial = _factorials()
    pmf = F.transform(F.sequence(F.lit(0), n), lambda b: _pmf("poisson", mu, b, F.get(factorial, b)))
    table = table.withColumn("_pmf", F.when(F.expr(params.legal()), pmf))
    cdf1 = F.transform(F.sequence(F.lit(0), n), lambda b: F.aggregate(F.slice("_pmf", F.lit(1), b + 1), F.lit(0.0), lambda s, x: s + x))
    table = table.withColumn("_cdf1", F.when(F.col("_pmf").isNotNull(), cdf1))
    sensitive = F.size(F.filter("_cdf1", lambda x: x < params.sensitivity))
    bound = required_odds(F.col("effective_prevalence"), params.precision - 1e-4)
    precise = F.size(F.filter(F.zip_with(F.slice("cdf", F.lit(1), n + 1), "_cdf1", lambda x, y: x / y), lambda p: p < bound)) - 1
    fixed = F.expr("cdr3_length div 5")
    legal = F.col("_cdf1").isNotNull()
    table = table.withColumn("sensitive_threshold", F.when(legal, sensitive).otherwise(fixed).cast("int"))
    table = table.withColumn("precise_threshold", F.when(legal, F.least(precise, "sensitive_threshold")).otherwise(fixed).cast("int"))
    return table.select(*classes.columns, "precise_threshold", "sensitive_threshold")


def remaining_classes(classes: DataFrame) -> DataFrame:
    """The classes whose two thresholds differ."""
    return classes.where(f"v_gene <> '{ANY}' and precise_threshold < sensitive_threshold and pair_count > 0")
