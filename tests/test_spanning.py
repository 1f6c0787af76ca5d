"""Spanning forests and their cuts against plain Kruskal and plain components."""

import random

import numpy as np
import pytest

from clonespark.operators import linkage as L
from clonespark.operators import spanning as M


def kruskal(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = set()
    for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in edges if w is not None and a != b}):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.add((a, b, w))
    return out, find


def random_edges(seed):
    """Groups of very different sizes, with ties, repeats, loops and nulls; a hub and a path."""
    rng, edges = random.Random(seed), []
    for g, (n, m) in enumerate(((400, 3000), (40, 60), (5, 3), (300, 250))):
        edges += [(1000 * g + rng.randrange(n), 1000 * g + rng.randrange(n), rng.randrange(6), g) for _ in range(m)]
    edges += [(5000, 5000 + i, i % 3, 5) for i in range(300)] + [(6000 + i, 6001 + i, 1, 6) for i in range(200)]
    return edges + [edges[0], (edges[1][1], edges[1][0], *edges[1][2:]), (7, 7, 0, 0), (7, 9, None, 0)]


@pytest.mark.parametrize(("chunk", "large"), [(1 << 20, 1 << 22), (50, 1 << 22), (50, 100), (1 << 20, 0)])
def test_forest_equals_kruskal(spark, monkeypatch, chunk, large):
    """Forests in one task, in chunks, and by rounds over stored tables are the same."""
    monkeypatch.setattr(M, "CHUNK", chunk)
    monkeypatch.setattr(M, "LARGE", large)
    edges = random_edges(large)
    got = M.minimum_forest(spark.createDataFrame(edges, "src long, dst long, w int, within long").repartition(5)).collect()
    assert {(r["src"], r["dst"], r["w"]) for r in got} == kruskal([e[:3] for e in edges])[0] and len(got) == len({(r["src"], r["dst"]) for r in got})
    assert {(r["src"], r["within"]) for r in got} <= {(x, e[3]) for e in edges for x in e[:2]}


def test_forest_of_nothing(spark):
    empty = spark.createDataFrame([], "src long, dst long, w int, within long")
    forest = M.minimum_forest(empty)
    assert forest.collect() == [] and M.cut(forest, spark.createDataFrame([], "within long, t int"), ["t"]).collect() == []


def test_cuts_equal_components_at_each_threshold(spark):
    edges = random_edges(3)
    forest = M.minimum_forest(spark.createDataFrame(edges, "src long, dst long, w int, within long"))
    limits = {g: [(-1 if g == 2 else 0), g % 4, 5, None] for g in range(7)}
    table = spark.createDataFrame([(g, *t) for g, t in limits.items()], "within long, a int, b int, c int, d int")
    got = {r["node"]: r for r in M.cut(forest, table, ["a", "b", "c", "d"]).collect()}
    for k, c in enumerate("abcd"):
        _, find = kruskal([e[:3] for e in edges if e[2] is not None and limits[e[3]][k] is not None and e[2] <= limits[e[3]][k]])
        groups = {}
        for x in {x for e in edges for x in e[:2]}:
            groups.setdefault(find(x), []).append(x)
        for members in groups.values():
            for x in members:
                root = got[x][c] if x in got else None
                assert (x if root is None else root) == min(members)


def test_least_forest_of_ties():
    rng = np.random.default_rng(0)
    a, b, w = rng.integers(0, 60, 500), rng.integers(60, 120, 500), rng.integers(0, 3, 500)
    own = M.least_forest(a, b, w)
    assert set(zip(a[own].tolist(), b[own].tolist(), w[own].tolist())) == kruskal(list(zip(a.tolist(), b.tolist(), w.tolist())))[0]


def test_one_linkage_serves_all_thresholds(spark):
    """Labels at eight thresholds of two classes from one table of links are those of eight runs."""
    rng = random.Random(1)
    rows = [(f"s{i:03d}", "V", "J", n, "".join(rng.choice("ACGT" if rng.random() < 0.3 else "A") for _ in range(n))) for i in range(120) for n in (12, 18)]
    records = spark.createDataFrame([(f"{s}_{n}", v, j, n, x) for s, v, j, n, x in rows], "sequence_id string, v_gene string, j_gene string, cdr3_length int, cdr3 string")
    columns = [f"t{k}" for k in range(8)]
    thresholds = spark.createDataFrame([("V", "J", 12, *range(-1, 7)), ("V", "J", 18, *range(8, 0, -1))], "v_gene string, j_gene string, cdr3_length int, " + ", ".join(f"{c} int" for c in columns))
    tree = L.linkage(records, thresholds, columns)
    many = {(r["cdr3_length"], r["cdr3"]): r for r in tree.labels({f"l{k}": c for k, c in enumerate(columns)}).collect()}
    assert tree.forest.count() < tree.nodes.count()
    for k, c in enumerate(columns):
        if k not in (0, 1, 4, 7):
            continue
        one = L.clusters(records, thresholds, {"x": c}).collect()
        for r in one:
            own = many[r["cdr3_length"], r["cdr3"]][f"l{k}"]
            assert r["x"] == (r["sequence_id"] if own is None else own)
