"""The merge of precise clusters in tasks, against all pairs."""

import numpy as np
import pytest

from clonespark.operators import mutations as X
from clonespark.operators import resolve as R
from clonespark.operators.components import least_labels


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for g, n, size in ((0, 15, 150), (1000, 18, 40), (2000, 21, 3), (3000, 15, 60)):
        base = rng.integers(0, 4, n)
        for i in range(size):
            text = np.where(rng.random(n) < 0.5, rng.integers(0, 4, n), base)
            alt = np.where(rng.random(60) < 0.15, rng.integers(0, 4, 60), 0)[: 60 - i % 2]
            m = int(rng.integers(0, 12))
            r = (g, g + i * 2 // 3, "".join("ACGT"[c] for c in text), "".join("ACGTX"[c + (c == 3 and i % 5 == 0)] for c in alt), m, n, 0.5 if g else 0.0)
            out += [r] * (1 + i % 3 // 2)
    return out


@pytest.mark.parametrize("sizes", [{}, {"LOCAL": 16, "SMALL": 4, "CELLS": 64, "STEPS": 2}, {"SMALL": 0, "CELLS": 500, "STEPS": 3}, {"CHUNK": 10}])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, rows, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(R, name, value)
    columns = ["group", "node", "cdr3", "alt_sequence_alignment", "mutation_count", "cdr3_length", "xy_threshold"]
    table = spark.createDataFrame(rows, "group long, node long, cdr3 string, alt_sequence_alignment string, mutation_count int, cdr3_length int, xy_threshold double")
    seen = table.selectExpr("'v' v_gene", "'j' j_gene", "cast(monotonically_increasing_id() as string) sequence_id", "lpad(node, 9, '0') precise_cluster", "group sensitive_cluster", *columns)
    edges = [(r["node_a"], r["node_b"]) for r in X.cross_pairs(seen, 60, ("node", "xy_threshold")).where("z <= xy_threshold_a + 1e-9").collect()]
    found = R.cluster_links(table, 60).collect()
    group = {r[1]: r[0] for r in rows}
    assert all(group[r["node_a"]] == group[r["node_b"]] == r["group"] for r in found)

    def parts(pairs):
        a = np.array(pairs, np.int64).reshape(-1, 2)
        return least_labels(4000, a[:, 0], a[:, 1])

    labels = parts(edges)
    assert np.array_equal(labels, parts([(r["node_a"], r["node_b"]) for r in found]))
    assert 20 < len(np.unique(labels[sorted(group)])) < len(group) - 20


def test_farthest_is_the_last_distance_within_the_threshold():
    rng = np.random.default_rng(5)
    differ, n1, n2 = rng.integers(0, 40, 500), rng.integers(1, 30, 500).astype(float), rng.integers(1, 30, 500).astype(float)
    for t in (0.0, -3.0, 2.5):
        table = np.stack([R._z(n, differ, n1, n2, 24, 96) <= t for n in range(25)])
        assert np.array_equal(R.farthest(differ, n1, n2, t, 24, 96), table.sum(0) - 1)
