"""The three methods, from a repertoire table to its clone ids."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from clonespark.operators import classes as C
from clonespark.operators import linkage as L
from clonespark.operators import mixture as M
from clonespark.operators import mutations as X
from clonespark.plans.lineage import stored
from clonespark.schema import CLASS, PAIRED, ROW, Params


@dataclass
class Result:
    """clone_id of the records that could be processed; ``output`` has every input row, with a null clone_id for the others.

    ``keys`` has the labels with the class, CDR3, ids and truth of the records only, which is less to read.
    """

    output: DataFrame
    records: DataFrame
    classes: DataFrame
    keys: DataFrame


def prepare(df: DataFrame, light: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(input with row ids, stored; normalised records, which are not); with light chains, both chains of an id make one record."""
    rows = C.with_row_ids(C.with_sequence_id(df))
    records = C.normalise(rows, keep=("ground_truth",))
    if light is not None:
        records = C.paired(records, C.normalise(C.with_sequence_id(light)))
    return rows, records


def _keys(records: DataFrame, light: DataFrame | None) -> DataFrame:
    """What a CDR3 method reads of the records: no alignments, whose mutations would be counted and stored in vain."""
    slim = records.select(*[c for c in (ROW, "sequence_id", "ground_truth", *CLASS, "cdr3") if c in records.columns])
    return slim if light is None else stored(slim, "pairs")[0]  # a join, which several steps read


def _output(rows: DataFrame, records: DataFrame, label: str) -> DataFrame:
    return rows.join(records.select(ROW, label), ROW, "left").drop(ROW).withColumnRenamed(label, "clone_id")


def _with_labels(records: DataFrame, found: DataFrame) -> DataFrame:
    return records.join(found.select(ROW, *[c for c in found.columns if c not in records.columns]), ROW)


def crude_labels(df: DataFrame, share: float = 0.2, fixed: int = -1, params: Params = Params(), keep: list[str] | None = None) -> DataFrame:
    """The ids, classes, CDR3s and truth of the records that crude(df) can process, or those of them in ``keep``, with their ``crude_method_family``.

    Nothing is joined back to the input, so its rows are not stored; alignments may be lacking.
    """
    keys = C.normalised_keys(C.with_sequence_id(df), keep=("ground_truth",))
    sizes = L.class_sizes(keys)
    return L.clusters(keys, L.crude_thresholds(sizes.select(*CLASS), share, fixed), {"crude_method_family": "threshold"}, params.inclusive, sizes, keep)


def crude(df: DataFrame, share: float = 0.2, fixed: int = -1, light: DataFrame | None = None, params: Params = Params()) -> Result:
    """Clusters at one threshold: fixed, or a share of the CDR3's length."""
    rows, records = prepare(df, light)
    keys = _keys(records, light)
    classes, _ = stored(L.crude_thresholds(C.create_classes(keys), share, fixed), "classes")
    found = L.clusters(keys, classes, {"crude_method_family": "threshold"}, params.inclusive)
    return Result(_output(rows, found, "crude_method_family"), _with_labels(records, found), classes, found)


def modelled_classes(records: DataFrame, null: DataFrame, params: Params) -> DataFrame:
    """Classes with parameters and thresholds, written once."""
    classes, _ = stored(C.create_classes(records), "classes")
    M.require_lengths(classes, null, params)
    # read twice; of bounded size, so that storing it is less than hashing the ids again
    sample, _ = stored(C.class_sample(records, classes, params), "sample")
    histogram = C.distance_histogram(sample)
    fits = M.fit_classes(M.binned(histogram, null), params)
    return stored(M.with_thresholds(M.with_parameters(classes, fits), null, params), "thresholds")[0]


def _both(records: DataFrame, classes: DataFrame, params: Params) -> DataFrame:
    return L.clusters(records, classes, {"precise_cluster": "precise_threshold", "sensitive_cluster": "sensitive_threshold"}, params.inclusive)


def _settings(params: Params, light: DataFrame | None) -> Params:
    return replace(params, **PAIRED, xy_offset=4.0) if light is not None else params


def cdr3(df: DataFrame, null: DataFrame | None = None, light: DataFrame | None = None, params: Params = Params(precision=0.99), sensitive: bool = False) -> Result:
    """Clusters at each class's precise threshold; with ``sensitive``, the records also have the clusters at its sensitive one."""
    params = _settings(params, light)
    rows, records = prepare(df, light)
    keys = _keys(records, light)
    classes = modelled_classes(keys, null if null is not None else M.default_null(df.sparkSession), params)
    found = _both(keys, classes, params) if sensitive else L.clusters(keys, classes, {"precise_cluster": "precise_threshold"}, params.inclusive)
    return Result(_output(rows, found, "precise_cluster"), _with_labels(records, found), classes, found)


def full(df: DataFrame, null: DataFrame | None = None, light: DataFrame | None = None, params: Params = Params()) -> Result:
    """Precise clusters, merged inside sensitive ones where the mutations speak for it."""
    params = _settings(params, light)
    null = null if null is not None else M.default_null(df.sparkSession)
    rows, records = prepare(df, light)
    records, _ = stored(records, "records")
    classes = X.xy_thresholds(records, modelled_classes(records, null, params), null, params)
    both, _ = stored(_both(records, classes, params), "clusters")
    found = X.merge_clusters(both, stored(classes, "xy")[0], params)
    return Result(_output(rows, found, "clone_id"), found, classes, found)
