"""A corpus pipeline: quality, near copies, repeated passages, source mix, token ids and their text.

Each stage is one of the operators of ``clonespark.llm`` applied to all that the stage before kept; its result is
written as a table in the shared folder and read again as the next stage's documents. All stages but the last return the
columns of ``documents``, and any more that these have, whatever their names; the last returns the ids of each document as BPE encodes it, and
the text that they decode to.

Null and empty texts are scored as any other, are near copies of each other, have no passages, size 0 (so no copy in the mix unless
the rate of their source is one or more, or their draw falls below it), and no ids. Rows without an id are near copies too; such a row stays where its component
has no row with an id. Repeated rows are exact copies, of which one stays. Ties are settled as the operators' docstrings say. An empty table gives one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clonespark.llm.bpe import encode_texts
from clonespark.llm.mixing import mixed_documents
from clonespark.llm.quality import good_documents
from clonespark.llm.simhash import one_of_each
from clonespark.llm.substring_dedup import without_repeats
from clonespark.plans.lineage import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return good_documents(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, also where groups share an id."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once."""
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the decoded text of each document."""
    return encode_texts(docs, keep=("doc_id", "source"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("encode", encode)]
#: The classifier, the fingerprints and the ids are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
