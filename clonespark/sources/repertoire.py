"""Readers and writers: repertoires, null models, gene tables, partitions and timings."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    import pandas as pd

#: The rows that a sheet of a workbook can have, below its header (a fixed value).
SHEET = 1_048_575
SUFFIXES = (".tsv", ".csv", ".csv.gz", ".tsv.gz", ".parquet", ".xlsx")


def suffix_of(path: str) -> str:
    """The known suffix of a path; others raise ValueError."""
    found = [s for s in SUFFIXES if str(path).endswith(s)]
    if not found:
        raise ValueError(f"{path}: supported are {', '.join(SUFFIXES)}")
    return max(found, key=len)


def read_repertoire(spark: SparkSession, path: str, config: dict[str, str] | str | None = None, rows: int | None = None) -> DataFrame:
    """A table of sequences, every column a string (Parquet keeps its types); more columns than the named ones pass through.

    config: {column of the file: column wanted}, or the path of such a JSON file; columns are copied, not renamed.
    rows: so many rows of the file at most. A compressed file is one task's to read; its rows are dealt out after that.
    """
    kind = suffix_of(path)
    if kind == ".parquet":
        df = spark.read.parquet(path)
    elif kind == ".xlsx":
        import pandas as pd

        df = spark.createDataFrame(pd.read_excel(path, dtype=str))
    else:
        df = spark.read.csv(path, header=True, sep="\t" if ".tsv" in kind else ",")
    if rows is not None:
        df = df.limit(rows)
    elif kind.endswith(".gz"):
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    if config:
        names = json.loads("\n".join(r[0] for r in spark.read.text(config).collect())) if isinstance(config, str) else config
        df = df.withColumns({new: F.col(old) for old, new in names.items()})
    return df


def write_result(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write a table in the format of the path's suffix (a folder of part files; compressed where the suffix says so)."""
    kind = suffix_of(path)
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if kind == ".parquet":
        writer.parquet(path)
    elif kind == ".xlsx":
        if os.path.exists(path) and not overwrite:
            raise ValueError(f"{path} exists")
        sheet = df.limit(SHEET + 1).toPandas()
        if len(sheet) > SHEET:
            raise ValueError(f"{path}: a sheet has at most {SHEET} rows")
        sheet.to_excel(path, index=False)
    else:
        writer = writer.option("header", True).option("sep", "\t" if ".tsv" in kind else ",")
        (writer.option("compression", "gzip") if kind.endswith(".gz") else writer).csv(path)


def result_path(path: str, method: str, folder: str | None = None) -> str:
    """Where a method's result for an input goes: <folder>/inferred_<method>_<name>."""
    name = {"crude": "crude_method", "cdr3": "cdr3_based", "full": "full_method", "alignment-free": "alignment_free"}[method]
    return f"{folder or os.path.join(os.path.dirname(path), 'clone_results')}/inferred_{name}_{os.path.basename(path)}"


def read_null_model(spark: SparkSession, path: str) -> DataFrame:
    """(l, cdf) from a table with the columns l, 0, 1, 2, ...; cdf[d] is the share of distances up to d."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    places = sorted((c for c in wide.columns if c != "l"), key=int)
    return wide.select(F.col("l").cast("int").alias("l"), F.array_compact(F.array(*[F.col(f"`{c}`").cast("double") for c in places])).alias("cdf"))


def read_fasta(spark: SparkSession, path: str, field: int = 1) -> DataFrame:
    """(call, germline_alignment): the field (from 0) of each ``|`` header, and the sequence."""
    records = spark.read.text(path, lineSep=">").where(F.length(F.trim("value")) > 0)
    lines = F.split("value", r"\r?\n", 2)
    return records.select(F.get(F.split(lines[0], r"\|"), F.lit(field)).alias("call"), F.regexp_replace(lines[1], r"\s", "").alias("germline_alignment"))


def write_fasta(df: DataFrame, path: str, id_column: str = "sequence_id", sequence: str = "sequence", sample: int | None = None, seed: int = 0) -> None:
    """Records as FASTA text; with ``sample``, that many rows by a seeded hash of the id."""
    if sample is not None:
        df = df.orderBy(F.xxhash64(F.lit(seed), id_column)).limit(sample)
    df.select(F.concat(F.lit(">"), id_column, F.lit("\n"), sequence).alias("value")).write.text(path)


def read_columns(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """Some columns of all CSV files of a glob."""
    return spark.read.csv(pattern, header=True).select(*columns)


def _best_partitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The likeliest partition of each YAML file, read in the file's task."""
    import pandas as pd
    import yaml

    for b in batches:
        best = [max(yaml.safe_load(t)["partitions"], key=lambda p: p.get("logprob", 0))["partition"] for t in b["value"]]
        yield pd.DataFrame({"partition": best})


def write_partitions(df: DataFrame, path: str, sequence_id: str, clone: str, by: list[str]) -> None:
    """JSON lines {"partition": [[ids of a clone], ...]}, a line for each value of the columns ``by``; ids and clones in their order."""
    clones = df.groupBy(*by, clone).agg(F.sort_array(F.collect_list(sequence_id)).alias("_ids"))
    lines = clones.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(clone, "_ids"))).alias("_clones"))
    lines.select(F.transform("_clones", lambda c: c["_ids"]).alias("partition")).write.json(path)


def write_null_model(null: DataFrame, path: str) -> None:
    """(l, cdf) as a CSV table with the columns l, 0, 1, 2, ...; shorter rows end in empty fields."""
    longest = null.agg(F.max(F.size("cdf"))).first()[0] or 0
    null.select("l", *[F.get("cdf", F.lit(d)).alias(str(d)) for d in range(longest)]).write.option("header", True).csv(path)


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, clone) from JSON lines {"partition": [[ids of a clone], ...]}; YAML files too where PyYAML is installed."""
    if str(path).endswith((".yaml", ".yml")):
        df = spark.read.text(path, wholetext=True).mapInPandas(_best_partitions, "partition array<array<string>>")
    else:
        df = spark.read.schema("partition array<array<string>>").json(path)
    return df.select(F.posexplode("partition").alias("clone", "ids")).select(F.explode("ids").alias("sequence_id"), "clone")


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """(model, size, seconds) from a JSON file {model: {size: [seconds]}}."""
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))
    one = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("model", "sizes"))
    return one.select("model", F.explode("sizes").alias("size", "all")).select("model", F.col("size").cast("double").alias("size"), F.explode("all").alias("seconds"))


def id_map(df: DataFrame, sequence_id: str = "sequence_id") -> DataFrame:
    """(seq_id, sequence_id): the given id, and a number from 0 in the order of ids."""
    from clonespark.operators.numbering import numbered

    ids = df.select(F.col(sequence_id).cast("string").alias("seq_id")).distinct()
    return numbered(ids, ["seq_id"], "sequence_id", 0)


def export_by_length(df: DataFrame, path: str) -> None:
    """One folder for each CDR3 length."""
    df.write.partitionBy("cdr3_length").option("header", True).csv(path)
