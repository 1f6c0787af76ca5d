"""Small operators for comparing results: aligned models, means over repetitions, unique values, matches with their texts, grouped functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonespark.operators.numbering import dense_numbers


def gene_keys(v_call: str = "v_call", j_call: str = "j_call", v_letters: int = 15, j_letters: int = 13) -> Column:
    """The first letters of both calls as one key."""
    return F.concat(F.substring(v_call, 1, v_letters), F.substring(j_call, 1, j_letters))


def unique_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of the columns, and how often each is there."""
    return df.groupBy(*columns).agg(F.count("*").alias("count"))


def unique_inverse(df: DataFrame, columns: list[str], name: str = "inverse") -> DataFrame:
    """df with the place (from 0) of its values among the distinct ones in their order."""
    return dense_numbers(df, columns, name, 0)


def align_models(base: DataFrame, models: dict[str, DataFrame], key: str = "sequence_id", label: str = "clone_id") -> DataFrame:
    """base with one column for each model: its label for the row's key, null where it has none."""
    out = base
    for name, found in models.items():
        out = out.join(found.select(key, F.col(label).alias(name)), key, "left")
    return out


def mean_over(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, and the mean and number of the values that are not null."""
    return values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def with_texts(matches: DataFrame, texts: DataFrame, top: int | None = None) -> DataFrame:
    """(left, right, similarity) of matches (i, j, sim), with texts (id, text) in place of ids; the ``top`` best, if given."""
    if top is not None:
        matches = matches.orderBy(F.col("sim").desc(), "i", "j").limit(top)
    a, b = texts.select(F.col("id").alias("i"), F.col("text").alias("left")), texts.select(F.col("id").alias("j"), F.col("text").alias("right"))
    return matches.join(a, "i").join(b, "j").select("i", "j", "left", "right", F.col("sim").alias("similarity"))


def row_by_value(matches: DataFrame) -> DataFrame:
    """(i, place, j, sim): each row's matches from the largest, ties to the smaller j."""
    order = Window.partitionBy("i").orderBy(F.round("sim", 9).desc(), "j")
    return matches.select("i", F.row_number().over(order).alias("place"), "j", "sim")


def apply_groups(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """What a function of a pandas frame makes of each group; a group is held by one task, so groups should be of bounded size."""
    return df.groupBy(*keys).applyInPandas(function, schema)
