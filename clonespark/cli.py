"""Command line: crude-method, cdr3-method and full-method over a repertoire file."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time
from dataclasses import replace

from clonespark.schema import Params

log = logging.getLogger("clonespark")


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"level": record.levelname.lower(), "event": record.getMessage(), "timestamp": self.formatTime(record)})


def set_logging(verbose: int, as_json: bool) -> None:
    handler = logging.StreamHandler()
    handler.setFormatter(_Json() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.handlers[:] = [handler]
    log.setLevel({0: logging.WARNING, 1: logging.INFO}.get(verbose, logging.DEBUG))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="clonespark", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("crude-method", "cdr3-method", "full-method"):
        c = commands.add_parser(name)
        c.add_argument("data_path", help="a .tsv, .csv, .csv.gz, .parquet or .xlsx table of sequences")
        c.add_argument("--kappa-file", help="the table of light chains; both chains of an id are then one record")
        c.add_argument("-v", "--verbose", action="count", default=0)
        c.add_argument("-t", "--threads", type=int, default=1, help="local threads, -1 for all; ignored where a master is set")
        c.add_argument("--result-folder")
        c.add_argument("--config", help="a JSON file {column of the table: column wanted}")
        c.add_argument("--override", action="store_true")
        c.add_argument("--json", dest="as_json", action="store_true")
        c.add_argument("--text", dest="as_json", action="store_false")
        if name == "crude-method":
            c.add_argument("-ft", "--fixed_threshold", type=int, default=-1)
            c.add_argument("-nt", "--normalized_threshold", type=float, default=0.2)
        else:
            c.add_argument("-p", "--precision", type=float, default=0.99 if name == "cdr3-method" else 1.0)
            c.add_argument("-s", "--sensitivity", type=float, default=0.9)
            c.add_argument("--null-model", help="a table with the columns l, 0, 1, ... of cumulative null probabilities")
            c.add_argument("--silent", action="store_true")
        if name == "full-method":
            c.add_argument("--without-heuristic", type=float, metavar="XY", help="this constant in place of the computed thresholds of the mutation statistic")
    c = commands.add_parser("alignment-free")
    c.add_argument("data_path", help="a table of sequences with the columns sequence_id and --text")
    c.add_argument("negative_path", help="a table of sequences that are no clones of any")
    c.add_argument("--text", dest="column", default="sequence", help="the column that is compared")
    c.add_argument("-p", "--percent", type=float, default=0.1, help="percentile of the nearest distances to the negative set")
    c.add_argument("-w", "--window", type=int, default=150, help="letters from the end that are compared; 0 for whole texts")
    c.add_argument("--greedy", action="store_true", help="labels in the order of ids in place of components")
    c.add_argument("-v", "--verbose", action="count", default=0)
    c.add_argument("-t", "--threads", type=int, default=1, help="local threads, -1 for all; ignored where a master is set")
    c.add_argument("--result-folder")
    c.add_argument("--override", action="store_true")
    c.add_argument("--json", dest="as_json", action="store_true")
    return top


def _alignment_free(spark, args: argparse.Namespace, out: str) -> None:
    from pyspark.sql import functions as F

    from clonespark.operators.classes import with_sequence_id
    from clonespark.operators.textclone import alignment_free
    from clonespark.sources import repertoire as R

    data = with_sequence_id(R.read_repertoire(spark, args.data_path))
    negatives = R.read_repertoire(spark, args.negative_path).select(F.col(args.column).alias("text"))
    found = alignment_free(data.select(F.col("sequence_id").alias("id"), F.col(args.column).alias("text")), negatives, args.window or None, args.percent, args.greedy)
    R.write_result(data.join(found.toDF("sequence_id", "clone_id"), "sequence_id", "left"), out, args.override)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    set_logging(args.verbose, args.as_json)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from clonespark.operators.classes import class_sample, clean_or_keep, distance_histogram
    from clonespark.operators.evaluate import pair_scores
    from clonespark.plans import methods
    from clonespark.plans.lineage import clean
    from clonespark.sources import repertoire as R

    builder = SparkSession.builder.appName("clonespark")
    if "SPARK_MASTER" not in os.environ and "MASTER" not in os.environ:
        builder = builder.master(f"local[{'*' if args.threads < 0 else args.threads}]")
    ours = SparkSession.getActiveSession() is None
    spark = builder.getOrCreate()
    method = args.command.removesuffix("-method")
    out = R.result_path(args.data_path, method, args.result_folder)
    began = time.time()
    if method == "alignment-free":
        _alignment_free(spark, args, out)
        if ours:
            clean(spark)
        log.info("wrote %s in %.1f s", out, time.time() - began)
        return 0
    data = clean_or_keep(R.read_repertoire(spark, args.data_path, args.config), "-igh")
    light = clean_or_keep(R.read_repertoire(spark, args.kappa_file, args.config), "-igk") if args.kappa_file else None
    log.info("read %s", args.data_path)
    params = Params()
    if method == "crude":
        result = methods.crude(data, args.normalized_threshold, args.fixed_threshold, light)
    else:
        params = Params(precision=args.precision, sensitivity=args.sensitivity)
        null = R.read_null_model(spark, args.null_model) if args.null_model else None
        if method == "full" and args.without_heuristic is not None:
            params = replace(params, xy_constant=args.without_heuristic)
        result = (methods.cdr3 if method == "cdr3" else methods.full)(data, null, light, params)
    output = result.output
    if light is not None:
        ids = output.select("sequence_id", "clone_id")
        both = light.join(ids, "sequence_id", "left")
        R.write_result(both.withColumn("sequence_id", F.concat("sequence_id", F.lit("-igk"))), out.replace("inferred_", "inferred_kappa_"), args.override)
        output = output.withColumn("sequence_id", F.concat("sequence_id", F.lit("-igh")))
    R.write_result(output, out, args.override)
    if args.verbose >= 2:
        folder = out.rsplit("/", 1)[0] + "/debug"
        R.write_result(data, f"{folder}/input_{method}.parquet", True)
        R.write_result(result.classes, f"{folder}/classes_{method}.parquet", True)  # with the parameters and thresholds
        if method != "crude":
            histograms = distance_histogram(class_sample(result.records, result.classes, params))
            R.write_result(histograms, f"{folder}/histograms_{method}.parquet", True)
        if "ground_truth" in result.output.columns:
            log.debug("scores %s", pair_scores(result.output, "clone_id").first().asDict())
    if ours:  # another's session may have results that are still to be read
        clean(spark)
    log.info("wrote %s in %.1f s", out, time.time() - began)
    return 0


if __name__ == "__main__":
    sys.exit(main())
