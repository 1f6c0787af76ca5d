"""Numbers in a global order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clonespark.plans.lineage import stored


def numbered(df: DataFrame, order: list[str | Column], name: str = "number", start: int = 1) -> DataFrame:
    """df with the place of each row in the order, which should tell all rows apart.

    Rows are sorted by ranges; a row's place is its place in its range and the rows of the ranges before, of which there is one number for
    each partition.
    """
    rows, _ = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    places = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return places.withColumn(name, F.col("_before") + within + F.lit(start)).drop("_at", "_part", "_before")


def dense_numbers(df: DataFrame, columns: list[str], name: str = "number", start: int = 1) -> DataFrame:
    """df with the number of its values of the columns among the distinct ones, in their order."""
    keys = numbered(df.select(*columns).distinct(), columns, name, start)
    return df.join(keys, columns)
