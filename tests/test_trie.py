"""Walks of tries against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonespark.operators import trie as R
from clonespark.operators import linkage as L
from clonespark.operators.spanning import minimum_forest


@pytest.mark.parametrize(("t", "leaves", "walkers"), [(0, 4096, 1 << 20), (2, 7, 50), (6, 64, 1000), (14, 16, 1 << 20), (15, 4096, 100)])
def test_trie_links_equal_all_pairs(spark, monkeypatch, t, leaves, walkers):
    """Several groups, small tries and batches, equal texts, other alphabets and lengths, budgets of several sizes."""
    monkeypatch.setattr(R, "LEAVES", leaves)
    monkeypatch.setattr(R, "WALKERS", walkers)
    rng = np.random.default_rng(t)
    rows = []
    for within, n in ((0, 90), (1000, 40), (2000, 1)):
        texts = sorted({"".join("ACGT"[c] for c in rng.integers(0, 4, 15)) for _ in range(n)} | {"é" * 15, "A\U0001f600" * 7 + "N", "ACG", ""})
        rows += [(within + i, within, x, t) for i, x in enumerate([*texts, texts[-1]])]
    far = lambda x, y: sum(a != b for a, b in zip(x.ljust(15, "\0"), y.ljust(15, "\0")))
    want = {(a[0], b[0], far(a[2], b[2]), a[1]) for a in rows for b in rows if a[1] == b[1] and a[0] < b[0] and far(a[2], b[2]) <= t}
    nodes = spark.createDataFrame(rows, "node long, within long, text string, t int").repartition(3)
    got = R.trie_links(nodes).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    asked = {a for a, *_ in rows if a % 3 == 0}
    some = R.trie_links(nodes.withColumn("asked", F.col("node") % 3 == 0)).collect()
    assert {tuple(r) for r in some} == {x for x in want if asked & set(x[:2])} and len(some) == len(set(some))


def test_trie_of_nothing(spark):
    assert R.trie_links(spark.createDataFrame([], "node long, within long, text string, t int")).collect() == []


@pytest.mark.parametrize(("n", "t"), [(60, 14), (400, 12), (5, 9)])
def test_spanning_links_hold_a_forest_of_all(spark, n, t):
    """Classes that hang together early, late, or never, at thresholds where most texts are linked."""
    rng = np.random.default_rng(n)
    rows = []
    for within, letters, size in ((0, "ACGT", n), (10_000, "AC", 30), (20_000, "ACGT", 1)):
        rows += [(within + i, within, x, t) for i, x in enumerate(sorted({"".join(letters[c] for c in rng.integers(0, len(letters), 15)) for _ in range(size)}))]
    rows += [(30_000, 30_000, "A" * 15, t), (30_001, 30_000, "A" * 10 + "C" * 5, t), (30_002, 30_000, "T" * 15, t)]
    nodes = spark.createDataFrame(rows, "node long, within long, text string, t int").repartition(3)
    weights = lambda links: sorted((r["within"], r["w"]) for r in minimum_forest(links).collect())
    assert weights(L.spanning_links(nodes, 1)) == weights(R.trie_links(nodes)) and weights(L.spanning_links(nodes.limit(0), 1)) == []
