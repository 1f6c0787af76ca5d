"""Distance histograms of classes in tasks, against all pairs."""

from collections import Counter
from itertools import combinations
from random import Random

import pytest
from pyspark.sql import functions as F

from clonespark.operators import classes as C
from clonespark.operators import histograms as H


@pytest.mark.parametrize("local", [8192, 20])
def test_histogram_equals_all_pairs(spark, monkeypatch, local):
    """Classes with copies, with other letters than DNA's, of one row, and more than one batch and one piece of pairs."""
    monkeypatch.setattr(C, "LOCAL", local)
    monkeypatch.setattr(H, "ROWS", 30)
    monkeypatch.setattr(H, "CELLS", 100)
    rng = Random(3)
    rows = [(c, 6 * c, f"{c}_{i}", "".join(rng.choice("AC" if c == 1 else "ACGTNéx") for _ in range(6 * c))) for c, m in ((1, 40), (2, 70), (11, 25), (4, 1), (5, 2)) for i in range(m)]
    rows += [(9, 6, f"9_{i}", "AAAAAA") for i in range(4)]
    found = {(r["class_id"], r["cdr3_length"], r["d"]): r["n"] for r in C.distance_histogram(spark.createDataFrame(rows, "class_id int, cdr3_length int, sequence_id string, cdr3 string")).collect()}
    expected = Counter((a[0], a[1], sum(x != y for x, y in zip(a[3], b[3], strict=True))) for a, b in combinations(rows, 2) if a[0] == b[0])
    assert found == dict(expected)


def test_distances_are_not_counted_in_few_tasks(spark):
    """A sample is few bytes and much work, so its partitions must not be put together for their size."""
    rows = [(c, 3, f"{c}_{i}", f"{i:03d}") for c in range(40) for i in range(5)]
    df = spark.createDataFrame(rows, "class_id int, cdr3_length int, sequence_id string, cdr3 string")
    counts = df.groupBy("class_id", "cdr3_length", "cdr3").count().withColumnRenamed("count", "k")
    parts = H.local_histogram(counts).rdd.getNumPartitions()
    assert parts == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    plan = C.distance_histogram(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # pairs of rows were joined


def test_an_empty_sample_has_no_distances(spark):
    assert C.distance_histogram(spark.createDataFrame([], "class_id int, cdr3_length int, sequence_id string, cdr3 string")).collect() == []


def test_queries_on_thresholds_and_cdr3s_derive_no_alignments(spark, sf_dir, monkeypatch):
    from clonespark import catalogue as K

    names = ["sensitive_clusters", "precise_clusters", "thresholds", "remaining_classes", "to_resolve_clusters"]
    rows, _ = K.stored(K.records(spark, sf_dir).limit(400), "some")
    some = rows.select("sequence_id", "ground_truth", F.col("v_gene").alias("v_call"), F.col("j_gene").alias("j_call"), F.concat(F.lit("TGT"), "cdr3", F.lit("TGG")).alias("junction"))
    for name in ("rep", "records"):
        monkeypatch.setattr(K, name, lambda *a, **k: pytest.fail("alignments are derived"))
    monkeypatch.setattr(K, "rep_keys", lambda spark, sf_dir: some)
    counts = {name: K.QUERIES[name](spark, sf_dir).count() for name in names}
    assert counts["sensitive_clusters"] == counts["precise_clusters"] == 400 and counts["thresholds"] > 0
