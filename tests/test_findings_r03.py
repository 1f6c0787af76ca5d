"""Findings of round 3: registered queries against their SQL on tables that the fixtures are too small for."""

import duckdb
import pytest

from clonespark import catalogue


def _rows(found):
    return sorted(tuple(r) for r in found)


def _both(spark, folder, name):
    connection = duckdb.connect()
    for table in ("lineitem", "documents", "benchmark"):
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    found = catalogue.QUERIES[name](spark, str(folder))
    return _rows(found.collect()), _rows(connection.execute(f"select {', '.join(found.columns)} from ({catalogue.ORACLES[name]})").fetchall())


@pytest.fixture(scope="module")
def few_classes(tmp_path_factory, sf_dir):
    """The orders moved to eight classes of more than 100 rows each."""
    folder = tmp_path_factory.mktemp("few")
    duckdb.execute(f"copy (select * replace (l_orderkey * 651 as l_orderkey) from '{sf_dir}/lineitem.parquet' where l_orderkey % 4 = 0) to '{folder}/lineitem.parquet'")
    for table in ("documents", "benchmark"):
        duckdb.execute(f"copy (select * from '{sf_dir}/{table}.parquet') to '{folder}/{table}.parquet'")
    return folder


def test_full_method_agrees_with_its_sql_where_classes_are_large(spark, few_classes):
    found, expected = _both(spark, few_classes, "full_method")
    assert found == expected


def test_null_pmf_has_all_lengths(spark, sf_dir):
    found, expected = _both(spark, sf_dir, "null_pmf")
    assert found == expected and {r[0] for r in found} == set(range(12, 148, 3)) and sum(r[3] for r in found if r[1] == 0) == 4599


def test_whole_texts_have_all_ngrams_across_slices_and_rows_of_one_id(spark, monkeypatch):
    from collections import Counter

    from clonespark.functions import sequences as S
    from clonespark.operators import textclone as T

    monkeypatch.setattr(S, "SLICES", (64, 16, 4))
    monkeypatch.setattr(T, "LETTERS", 50)
    long = "".join(chr(97 + i * i % 23) if i % 7 else "é𝄞"[i % 2] for i in range(700))
    texts = [(k, long[: 3 + k]) for k in range(1, 140)] + [(500, long), (500, long[::-1]), (501, "a-b.c BDde/f"), (502, ""), (503, None), (None, "abcdef")]
    expected: Counter = Counter()
    for i, t in texts:
        t = "abcdef" if i == 501 else t or ""
        expected.update((i, t[k : k + 5]) for k in range(len(t) - 4))
    found = T.tokens(spark.createDataFrame(texts, "id int, text string"), window=None).collect()
    assert len(found) == len(expected) and {(r["id"], r["gram"]): r["tf"] for r in found} == expected


def test_ngrams_are_not_shuffled(spark):
    from clonespark.operators import textclone as T

    plan = T.tokens(spark.createDataFrame([(1, "abcdefgh")], "id int, text string"), window=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_mutations_are_counted_once_for_thresholds(spark, sf_dir):
    from clonespark.operators import mutations as X

    rows = catalogue.records(spark, sf_dir, catalogue.wide)
    classes = catalogue.C.create_classes(rows).withColumn("effective_prevalence", catalogue.F.lit(0.2))
    assert "zip_with" not in X.mutation_counts(rows, classes)._jdf.queryExecution().optimizedPlan().toString()
