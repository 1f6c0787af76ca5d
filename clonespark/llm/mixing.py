"""Mixing sources to target weights, with DataFrame operations only.

Each source has a target size; a document of a source with the rate target / size is emitted floor(rate) times, plus
once more with the probability of the rate's fraction. That draw is a hash of the document's id and a seed, so reruns agree.

Targets are water-filling: sources share the budget by weight, no source gets more than ``cap`` times its size, and what is
left over is shared by weight among the others. Sources sorted by cap / weight fill up in that order, so running sums give
the common level at once, without iterating.

Only the table of sources is sorted in one place, after the documents have been summed up map-side. The join
back is a plain equi-join: Spark broadcasts the sources if their stored table is under its broadcast threshold, and
otherwise sorts and merges, where adaptive execution splits a source with many rows.

A null source is a source of its own, ordered last; a null text has size 0; a null doc_id draws by its text. A source
of size 0 has the target 0. Repeated rows of one id share its draw. All other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clonespark.llm.columns import slim, whole
from clonespark.plans.lineage import stored

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"


def size_of(text: str = "text") -> Column:
    """The number of words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: str = SEED, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number from 0 up to 1 (48 bits of an MD5), fixed by the id and the seed."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from a table with (source, size)."""
    one = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = Window.orderBy("ratio", "rank")
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", rank)
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    table = table.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    full = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.lit(share) * F.sum("source_size").over(one) - full) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("level", level).withColumn("open", F.col("ratio") > F.col("level"))
    common = F.min(F.when(F.col("open"), F.struct("ratio", "rank", "level"))).over(one)["level"]
    return table.withColumn("common", common).select("source", "source_size", F.least("most", F.coalesce(F.col("common") * F.col("weight"), "most")).alias("target"))


def copies(rate: Column, u: Column) -> Column:
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def _rate() -> Column:
    return F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))


def _with_targets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    targets = targets.withColumnRenamed("source", "_source")
    return docs.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes, _ = stored(docs.select("doc_id", "source", size_of().alias("size"), draw().alias("u")), "sizes")
    targets, _ = stored(source_targets(sizes), "targets")
    mixed = _with_targets(sizes, targets)
    return mixed.select("doc_id", "size", "source_size", "target", (copies(_rate(), F.col("u")) * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """documents as often as the mix takes them."""
    targets, _ = stored(source_targets(docs.select("source", size_of().alias("size"))), "targets")
    targets = targets.select("source", _rate().alias("_rate"))
    times = _with_targets(slim(docs, "doc_id", "text", "source"), targets).withColumn("_copies", copies(F.col("_rate"), draw()))
    return whole(times.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))), docs.columns)


#: DuckDB SQL of op5_mix_sources.
ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size,
    ('0x' || substr(md5('mix-1:' || coalesce(cast(doc_id as varchar), 'text ' || md5(coalesce(text, '')))), 1, 12))::ubigint / 281474976710656.0::double u
  from documents),
s as (select source, cast(sum(size) as bigint) source_size, row_number() over (order by source nulls last) - 1 rank from d group by source),
w as (select *, [5.0, 2.0, 1.0][cast(rank % 3 as bigint) + 1]::double weight, 2.0::double * source_size most from s),
r as (select *, most / weight ratio from w),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(most) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, rank rows between current row and unbounded following) level from r),
c as (select arg_min(level, ratio) common from l where ratio > level),
t as (select source, source_size, least(most, coalesce(common * weight, most)) target from l, c),
x as (select d.*, source_size, target, coalesce(target / nullif(source_size, 0), 0) rate from d join t on d.source is not distinct from t.source)
select doc_id, cast(size as bigint) size, source_size, target, cast(floor(rate) + (u < rate - floor(rate))::int as bigint) * cast(size as bigint) taken from x
"""
