"""Costly expressions are computed once for each row, and only for rows that need them."""

from pyspark.sql import functions as F

from clonespark.functions import sequences as S
from clonespark.operators import mutations as X
from clonespark.operators import textclone as T


def test_greedy_labels_read_the_matches_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def near(i, j):
        calls.add(1)
        return abs(i - j) <= 1

    pairs = spark.range(12).selectExpr("id i").crossJoin(spark.range(12).selectExpr("id j"))
    found = T.greedy_labels(pairs.where(F.udf(near, "boolean")("i", "j")), spark.range(12)).count()
    assert found == 12 and calls.value == 144


def test_codons_are_cut_from_the_text(spark):
    """A split within the function of a codon would be made for each letter again."""
    amino = S.translated(F.col("x"))
    assert "split" not in str(amino)
    rows = spark.createDataFrame([("TTTATGGGGTAA",), ("ATGAT",), ("NTGT TT TAT",), ("",), ("é😀AAAA",)], "x string")
    assert [r[0] for r in rows.select(amino).collect()] == ["FMG*", "M", "XXX", "", "XK"]


def test_rows_without_pairs_are_left_out(spark):
    rows = [("a", "V", "J", 12, "p", "s"), ("b", "V", "J", 12, "q", "s"), ("c", "V", "J", 12, "r", "u"), ("d", "V", "K", 12, "p", "u"), ("e", "V", "J", 12, "r", "u")]
    df = spark.createDataFrame(rows, "sequence_id string, v_gene string, j_gene string, cdr3_length int, precise_cluster string, sensitive_cluster string")
    assert sorted(r[0] for r in X.several(df).select("sequence_id").collect()) == ["a", "b"]
