"""Documents with any further columns: these travel as one struct, so no name can clash with an operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = "_rest"


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


def slim(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others (if there are any) in one struct."""
    others = [_name(c) for c in docs.columns if c not in names]
    return docs.select(*names, *([F.struct(*others).alias(REST)] if others else []))


def rest(df: DataFrame) -> list[str]:
    """The struct's name, where there is one."""
    return [REST] if REST in df.columns else []


def whole(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns as they were before slim(); ``new`` has replacements for some."""
    own = set(df.columns) - {REST}
    return df.select(*[new[c].alias(c) if c in new else _name(c) if c in own else F.col(f"{REST}.`{c}`").alias(c) for c in columns])
