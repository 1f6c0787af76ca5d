"""Forests of classes that one task holds, against all pairs."""

import numpy as np
import pytest

from clonespark.operators import linkage as L
from clonespark.operators import pieces as P
from clonespark.operators.spanning import least_forest


@pytest.mark.parametrize(("n", "t", "rows", "letters"), [(15, 3, 300, "ACGT"), (15, 7, 300, "ACGTN"), (36, 7, 400, "ACGT"), (9, 2, 200, "AC"), (70, 5, 300, "ACGTN-.xéz😀"), (6, 9, 50, "ACGT"), (5, 5, 40, "A")])
def test_forest_is_that_of_all_pairs(n, t, rows, letters, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 1000)
    rng = np.random.default_rng(n * t)
    m = rng.integers(0, len(letters), (rows // 4 + 1, n))[rng.integers(0, rows // 4 + 1, rows)]
    for row in m:
        k = rng.integers(0, 4)
        row[rng.integers(0, n, k)] = rng.integers(0, len(letters), k)
    texts, group, node = ["".join(letters[j] for j in r) for r in m], np.sort(rng.integers(0, 5, rows)) * 1000, rng.permutation(rows).astype(np.int64)
    d = (m[:, None] != m[None]).sum(2)
    a, b = np.where((d <= t) & (group[:, None] == group[None]) & (node[:, None] < node[None]))
    x, y, w = node[a], node[b], d[a, b]
    kept = least_forest(x, y, w)
    found = P.forest_of(texts, node, group, t)
    assert sorted(zip(*(c.tolist() for c in found))) == sorted(zip(x[kept].tolist(), y[kept].tolist(), w[kept].tolist()))


@pytest.mark.parametrize("local", [1 << 16, 3])
def test_small_classes_are_linked_where_they_lie(spark, monkeypatch, local):
    """Texts of small classes are not shuffled once for each part; where a class is too large for a task, they are, with the same clusters."""
    rows = [(f"s{i}", "V", f"J{i % 2}", 12, "ACGTACGTACGT"[: 11 - i % 3] + "TTTTTTTTTTTT"[: 1 + i % 3]) for i in range(8)] + [("z", "V", "J0", 12, "GGGGGGGGGGGG")]
    records = spark.createDataFrame(rows, "sequence_id string, v_gene string, j_gene string, cdr3_length int, cdr3 string")
    thresholds = spark.createDataFrame([("V", "J0", 12, 2), ("V", "J1", 12, 0)], "v_gene string, j_gene string, cdr3_length int, t int")
    called, own = [], L.links
    monkeypatch.setattr(L, "LOCAL", local)
    monkeypatch.setattr(L, "links", lambda *a: (called.append(a), own(*a))[1])
    found = {r["sequence_id"]: r["c"] for r in L.clusters(records, thresholds, {"c": "t"}).collect()}
    # J1 is at threshold 0, so only equal texts are together (i = 1 and 7)
    assert found == {"s0": "s0", "s2": "s0", "s4": "s0", "s6": "s0", "z": "z", "s1": "s1", "s3": "s3", "s5": "s5", "s7": "s1"}
    assert bool(called) == (local == 3)
