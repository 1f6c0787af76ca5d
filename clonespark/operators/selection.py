"""Exact order statistics of a column without sorting it or gathering its values.

Counts of values for each of ``BUCKETS`` ranges show which range holds a rank; only that range is cut into ranges again, until it holds one value. A
round is one aggregation whose result has no more rows than there are buckets and ranks, whatever the number of values or of distinct ones.
Nulls and NaNs take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.plans.lineage import remove, stored

BUCKETS = 1024


def _refined(table: DataFrame, ranges: list[tuple[float, float]]) -> dict[int, list[tuple[int, float, float]]]:
    """For each of some disjoint ranges: (count, least, greatest) of its buckets that have values, in order."""
    x = F.col("x")
    bucket = F.lit(None).cast("struct<k:int,b:int>")
    for k, (lo, hi) in enumerate(ranges):
        # halves, so that the width of a range does not overflow; the bucket does not fall as x rises, in spite of rounding
        share = (x / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
        bucket = F.when((x >= lo) & (x <= hi), F.struct(F.lit(k).alias("k"), F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int").alias("b"))).otherwise(bucket)
    rows = table.select("x", bucket.alias("at")).where("at is not null").groupBy("at").agg(F.count("*"), F.min("x"), F.max("x")).collect()
    out: dict[int, list] = {}
    for r in sorted(rows):
        out.setdefault(r[0].k, []).append(tuple(r[1:]))
    return out


def values_at(table: DataFrame, ranks: list[int]) -> dict[int, float]:
    """{rank: value} of a stored table (x double) without nulls; rank 0 is the least value."""
    n, lo, hi = table.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if any(not 0 <= r < n for r in ranks):
        raise ValueError(f"ranks of {n} values: {ranks}")
    found: dict[int, float] = {}
    waiting = {(lo, hi): (0, sorted(set(ranks)))} if ranks else {}
    while waiting:
        for (lo, hi), (_, own) in waiting.items():
            if lo == hi:
                found.update(dict.fromkeys(own, lo))
        ranges = [r for r in waiting if r[0] != r[1]]
        following: dict[tuple[float, float], tuple[int, list[int]]] = {}
        for k, buckets in (_refined(table, ranges) if ranges else {}).items():
            before, own = waiting[ranges[k]]
            for count, low, high in buckets:
                inside = [r for r in own if before <= r < before + count]
                if inside:
                    following[low, high] = before, inside
                before += count
        waiting = following
    return found


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """The values at shares (0 to 1) of a column's values, interpolated between neighbours; None for each without any value."""
    table, path = stored(df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)"), "values")
    n = table.count()
    places = [p * (n - 1) for p in shares]
    at = values_at(table, [r for p in places for r in {math.floor(p), math.ceil(p)}]) if n else {}
    remove(df.sparkSession, path)
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) if n else None for p in places]
