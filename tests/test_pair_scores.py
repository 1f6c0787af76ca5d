"""Pair scores of crude labels: rows are clustered once, and only what the labels depend on is derived and moved."""

from collections import Counter
from itertools import combinations

import duckdb
import numpy as np

from clonespark import catalogue
from clonespark.operators import evaluate as E
from clonespark.operators import pieces as P
from clonespark.plans import methods

SCHEMA = "ground_truth long, clone string, cdr3_length int"
ROWS = [(1, "a", 15), (1, "a", 15), (1, "b", 15), (2, "b", 15), (2, None, 18), (None, "c", 18), (None, "c", 18), (3, "d", 18), (3, "d", 18)]


def _pairs(rows, same):
    return sum(1 for a, b in combinations(rows, 2) if all(a[k] == b[k] and a[k] is not None for k in same))


def test_specificity_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(ROWS, SCHEMA).mapInArrow(count, SCHEMA)
    found = E.specificity(df, "clone").collect()[0][0]
    every, t, p, both = len(ROWS) * (len(ROWS) - 1) // 2, _pairs(ROWS, [0]), _pairs(ROWS, [1]), _pairs(ROWS, [0, 1])
    assert found == (every - t - p + both) / (every - t) and seen.value == len(ROWS)
    assert E.specificity(spark.createDataFrame([], SCHEMA), "clone").collect()[0][0] is None


def test_alignments_are_not_derived_for_labels_and_the_same_rows_are_labelled(spark, sf_dir, tmp_path, monkeypatch):
    """Also where keys of lineitem are null: a record that lacked an alignment lacks its id or junction too."""
    some = ", ".join(f"case when l_partkey % 97 = {k} then null else {c} end as {c}" for k, c in enumerate(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    duckdb.execute(f"copy (select * replace ({some}) from '{sf_dir}/lineitem.parquet') to '{tmp_path}/lineitem.parquet'")
    want = methods.crude(catalogue.rep(spark, str(tmp_path))).keys.select("sequence_id", "ground_truth", "crude_method_family").collect()
    tables, own = [], catalogue.stored
    monkeypatch.setattr(catalogue, "stored", lambda df, name: (tables.append(df.columns), own(df, name))[1])
    monkeypatch.setattr(methods, "stored", lambda df, name: (tables.append(df.columns), own(df, name))[1])
    found = catalogue._crude(spark, str(tmp_path)).select("sequence_id", "ground_truth", "crude_method_family").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and len(found) > 4000
    assert tables and not any("alignment" in c for columns in tables for c in columns)


def test_a_linked_pair_is_kept_once_however_many_pieces_agree(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 4, (40, 36))
    texts = {"".join("ACGT"[c] for c in np.where(rng.random(36) < 0.04, rng.integers(0, 4, 36), base[i % 40])) for i in range(400)}
    texts = sorted(texts)
    group = np.arange(len(texts)) % 3
    given, own = [], P._least
    monkeypatch.setattr(P, "_least", lambda edges: (given.append(list(zip(*(c.tolist() for c in edges), strict=True))), own(edges))[1])
    P.forest_of(texts, np.arange(len(texts)), group, 7)
    want = [(i, j, d) for i, j in combinations(range(len(texts)), 2) if group[i] == group[j] and (d := sum(x != y for x, y in zip(texts[i], texts[j], strict=True))) <= 7]
    assert len(given) == 1 and Counter(given[0]) == Counter(want) and len(want) > 200


def test_cells_of_a_truth_and_a_label_are_not_shuffled_again(spark):
    found = E.pair_scores(spark.createDataFrame(ROWS, SCHEMA), "clone")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # by truth, and by label
    t, p, both = _pairs(ROWS, [0]), _pairs(ROWS, [1]), _pairs(ROWS, [0, 1])
    assert tuple(found.collect()[0]) == (both / p, both / t)


def test_cells_of_a_length_are_not_shuffled_by_truth_and_label_again(spark):
    found = E.pair_scores_by(spark.createDataFrame(ROWS, SCHEMA), "clone", "ground_truth", ["cdr3_length"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "clone" in x and "ground_truth" in x]
    want = {}
    for n in (15, 18):
        rows = [r for r in ROWS if r[2] == n]
        t, p, both = _pairs(rows, [0]), _pairs(rows, [1]), _pairs(rows, [0, 1])
        want[n] = both / p, both / t
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == want
