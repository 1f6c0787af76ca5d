"""Raw reads with gene tables to records in the AIRR columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFFSET_V, OFFSET_J = 50, 33
#: The position of the conserved cysteine in gapped germline sequences, in letters (fixed by the numbering scheme).
CYSTEINE = 309


def v_genes(fasta: DataFrame) -> DataFrame:
    """(call, germline_alignment, anchor_index) of gapped V genes; the anchor is without the gaps before it."""
    gaps = F.length("germline_alignment") - F.length(F.replace("germline_alignment", F.lit("."), F.lit("")))
    return fasta.withColumn("anchor_index", F.lit(CYSTEINE) - gaps)


def j_genes(fasta: DataFrame) -> DataFrame:
    """(call, germline_alignment, anchor_index) of J genes; the anchor is the first ``tgggg``, null without one."""
    at = F.instr("germline_alignment", "tgggg")
    return fasta.withColumn("anchor_index", F.when(at > 0, at - 1))


def usable_reads(raw: DataFrame, offset_v: int = OFFSET_V) -> DataFrame:
    """Complete reads of productive heavy chains of isotype IgG that start before the offset."""
    return raw.na.drop().where(f"chain = 'heavy' and productive = 'yes' and startswith(isotype, 'IgG') and v_start < {offset_v}")


def to_airr(raw: DataFrame, genes_v: DataFrame, genes_j: DataFrame, offset_v: int = OFFSET_V, offset_j: int = OFFSET_J) -> DataFrame:
    """Reads as AIRR records; reads whose V or J call is not in the tables exactly once are dropped."""
    only = lambda g: g.join(g.groupBy("call").count().where("count = 1"), "call", "left_semi")
    v = only(genes_v).select(F.col("call").alias("v_full"), F.col("germline_alignment").alias("_v"), F.col("anchor_index").alias("_c"))
    j = only(genes_j).select(F.col("call").alias("j_full"), F.col("germline_alignment").alias("_j"), F.col("anchor_index").alias("_t"))
    reads = usable_reads(raw, offset_v).join(v, "v_full").join(j, "j_full")
    return reads.withColumn("_s", F.concat(F.repeat(F.lit("N"), F.col("v_start")), "vdj_nt")).withColumn("_l", F.length("cdr3_nt")).selectExpr(
        "seq_id",
        "v_full as v_call",
        "j_full as j_call",
        "substring(_s, _c + 1, _l + 6) as junction",
        f"substring(_s, {offset_v + 1}, greatest(_c + 3 - {offset_v}, 0)) as v_sequence_alignment",
        f"substring(_s, _c + _l + 4, {offset_j}) as j_sequence_alignment",
        f"upper(substring(replace(_v, '.', ''), {offset_v + 1}, greatest(_c + 3 - {offset_v}, 0))) as v_germline_alignment",
        f"upper(substring(_j, _t + 1, {offset_j})) as j_germline_alignment",
    )
