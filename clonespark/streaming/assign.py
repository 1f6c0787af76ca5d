"""Single linkage that grows with a stream: clusters of all records seen so far, extended batch by batch.

The state is a folder of tables: the distinct CDR3s with their numbers (nodes), the least spanning forest of their links, and the records. A micro-batch numbers its new CDR3s,
looks for links of these only (among themselves, and with known ones of their classes), and the forest of the known forest and the new links is the next one. A new CDR3
can so merge clusters that were apart, and new ones that are linked to each other form clusters; any split of records into batches gives the clusters of one batch.

Each batch writes a version of its own, from the last complete one before it, so a batch that is tried again replaces what it wrote. The versions before these two are removed.
Thresholds are given, by class: they come from a model of all pairs. Rows of classes without one, or with a negative one, are alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clonespark.functions import sequences as S
from clonespark.operators.linkage import Linkage, forest_links
from clonespark.operators.numbering import numbered
from clonespark.operators.spanning import minimum_forest
from clonespark.plans.lineage import children, remove, stored
from clonespark.schema import CLASS

NODES = "v_gene string, j_gene string, cdr3_length int, cdr3 string, node long, within long, least string, t int"
FOREST = "src long, dst long, w int, within long"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions: the forest is written last, and Spark marks what it has written as a whole."""
    found = [n for n in children(spark, path) if n.startswith("version=")]
    return sorted(int(n[8:]) for n in found if "_SUCCESS" in children(spark, f"{path}/{n}/forest"))


def _state(spark: SparkSession, path: str, version: int | None) -> tuple[DataFrame, DataFrame]:
    if version is None:
        return spark.createDataFrame([], NODES), spark.createDataFrame([], FOREST)
    return spark.read.schema(NODES).parquet(f"{path}/version={version}/nodes"), spark.read.schema(FOREST).parquet(f"{path}/version={version}/forest")


def grow(batch: DataFrame, thresholds: DataFrame, column: str, path: str, epoch: int, inclusive: bool = True) -> None:
    """Extend the clusters at ``path`` by a batch of records (working columns); ``epoch`` is the batch's number, and a number that is given again replaces that batch."""
    spark = batch.sparkSession
    place = f"{path}/records/epoch={epoch}"
    batch.select("sequence_id", *CLASS, "cdr3").write.mode("overwrite").parquet(place)
    records = spark.read.parquet(place)
    before = max((v for v in _versions(spark, path) if v < epoch), default=None)
    known, forest = _state(spark, path, before)
    one = [*CLASS, "cdr3"]
    t = thresholds.select(*CLASS, F.col(column).cast("int").alias("t")).where("t >= 0")
    seen = records.groupBy(*one).agg(F.min("sequence_id").alias("least")).join(t, CLASS)
    start = known.agg(F.max("node")).first()[0]
    new, _ = stored(numbered(seen.join(known, one, "left_anti").select(*one, "least", "t"), one, "node", 0 if start is None else start + 1), "new-nodes")
    group = new.groupBy(*CLASS).agg(F.min("node").alias("_new")).join(known.groupBy(*CLASS).agg(F.min("within").alias("_old")), CLASS, "left")
    new, _ = stored(new.join(group.select(*CLASS, F.coalesce("_old", "_new").alias("within")), CLASS).select(known.columns), "new-nodes")
    older = known.join(seen.select(*one, F.col("least").alias("_least")), one, "left").withColumn("least", F.least("least", "_least")).select(known.columns)
    here = f"{path}/version={epoch}"
    older.unionByName(new).write.mode("overwrite").parquet(f"{here}/nodes")
    nodes = spark.read.schema(NODES).parquet(f"{here}/nodes")
    touched = new.select("within").distinct()
    marks = new.select("node", F.lit(True).alias("asked"))
    texts = nodes.join(touched, "within", "left_semi").join(marks, "node", "left").select("node", "within", F.col("cdr3").alias("text"), "t", F.coalesce("asked", F.lit(False)).alias("asked"))
    texts, _ = stored(texts, "texts")
    own = forest.join(touched, "within", "left_semi").select(forest.columns)
    found = forest_links(texts, S.word_count(texts, "text"), inclusive, known=own)
    grown = minimum_forest(found.unionByName(own)).unionByName(forest.join(touched, "within", "left_anti").select(forest.columns))
    grown.write.mode("overwrite").parquet(f"{here}/forest")
    for old in _versions(spark, path):
        if before is not None and old < before:
            remove(spark, f"{path}/version={old}")


def clusters_of(spark: SparkSession, path: str, label: str = "clone_id", inclusive: bool = True) -> DataFrame:
    """The records so far with ``label``: the least sequence_id of the row's cluster, or its own where its class has no threshold that links."""
    last = max(_versions(spark, path), default=None)
    records = spark.read.parquet(f"{path}/records").where(F.col("epoch") <= last).drop("epoch")
    nodes, forest = _state(spark, path, last)
    found = Linkage(nodes, forest, ["t"], inclusive).labels({"_found": "t"})
    return records.join(found, [*CLASS, "cdr3"], "left").select(*records.columns, F.coalesce("_found", "sequence_id").alias(label))


def cluster_stream(stream: DataFrame, thresholds: DataFrame, column: str, path: str, checkpoint: str, inclusive: bool = True) -> StreamingQuery:
    """Grow the clusters at ``path`` by each micro-batch that is there; a path belongs to one checkpoint, whose numbers of batches it keeps."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: grow(batch, thresholds, column, path, epoch, inclusive)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
