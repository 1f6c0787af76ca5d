"""Clusters that grow with a stream are those of one batch."""

import random

import pytest
from pyspark.sql import functions as F

from clonespark.operators import linkage as L
from clonespark.streaming.assign import _versions, cluster_stream, clusters_of, grow


@pytest.fixture(scope="module")
def records(spark):
    """Families that hang together through members of different batches, repeated CDR3s, a class with a large threshold, one with a negative one and one without any."""
    rng, rows = random.Random(4), []
    for k in range(8):
        text = "".join(rng.choice("ACGT") for _ in range(18))
        for _ in range(12):
            rows.append(("V1", 18, text))
            at = rng.randrange(18)
            text = text[:at] + rng.choice("ACGT") + text[at + 1 :]
    rows += [("V2", 12, "".join(rng.choice("ACGT") for _ in range(12))) for _ in range(40)]
    rows += [("V3", 12, rng.choice(["A" * 12, "C" * 12])) for _ in range(6)] + [("V4", 12, "A" * 12)] * 3
    rng.shuffle(rows)
    table = [(f"s{i:03d}", v, "J", n, x, i % 3) for i, (v, n, x) in enumerate(rows)]
    return spark.createDataFrame(table, "sequence_id string, v_gene string, j_gene string, cdr3_length int, cdr3 string, part int")


@pytest.fixture(scope="module")
def thresholds(spark):
    return spark.createDataFrame([("V1", "J", 18, 1), ("V2", "J", 12, 9), ("V3", "J", 12, -1)], "v_gene string, j_gene string, cdr3_length int, t int")


@pytest.fixture(scope="module")
def whole(records, thresholds):
    found = L.clusters(records, thresholds, {"clone_id": "t"})
    return {r["sequence_id"]: r["clone_id"] or r["sequence_id"] for r in found.collect()}


def test_any_split_gives_the_clusters_of_one_batch(spark, records, thresholds, whole, tmp_path):
    path = f"file://{tmp_path}/state"
    for epoch, part in ((0, 0), (1, 1), (2, 0), (2, 2)):  # the third batch is tried twice, the first time with other rows
        grow(records.where(F.col("part") == part).drop("part"), thresholds, "t", path, epoch)
    got = {r["sequence_id"]: r["clone_id"] for r in clusters_of(spark, path).collect()}
    assert got == whole and len(set(got.values())) < len(got)
    assert _versions(spark, path) == [1, 2]


def test_a_stream_does_the_same(spark, records, thresholds, whole, tmp_path):
    rows = records.drop("part")
    records.where("part < 2").drop("part").coalesce(1).write.parquet(f"{tmp_path}/in")
    records.where("part = 2").drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    cluster_stream(stream, thresholds, "t", f"file://{tmp_path}/state", f"{tmp_path}/ck").awaitTermination()
    assert {r["sequence_id"]: r["clone_id"] for r in clusters_of(spark, f"file://{tmp_path}/state").collect()} == whole


def test_an_empty_batch(spark, records, thresholds, tmp_path):
    grow(records.limit(0).drop("part"), thresholds, "t", f"file://{tmp_path}/state", 0)
    assert clusters_of(spark, f"file://{tmp_path}/state").collect() == []
