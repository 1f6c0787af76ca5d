"""Vector codes against plain Python, and the cases that tables can have."""

import hashlib
import math

import numpy as np
import pytest

from clonespark.llm import vector_codes as V


def brute_force(rows, parts=16, entries=64, rounds=2, scale=256.0):
    """[(id, code, error, label error, digest)] of rows (id, vector, label)."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (dim - len(v)), label) for i, v, label in kept]
    d = dim // parts
    cut = lambda v: [v[p * d : (p + 1) * d] for p in range(parts)]
    first = {}
    for i, v, _ in kept:
        first[i] = min(v, first.get(i, v))
    start = [cut(first[i]) for i in sorted(first, key=lambda i: (i is None, i or 0))[:entries]]
    books = [[s[p] for s in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, w: min((far(w, c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(p, cut(v)[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    got = [(i, [nearest(p, w) for p, w in enumerate(cut(v))], label) for i, v, label in kept]
    total = {}
    for _, found, label in got:
        total[label] = total.get(label, 0) + sum(e for e, _ in found)
    return [(i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), total[label], digest) for i, found, label in got]


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, label, "clash") for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label int, code string").repartition(5)


def run(spark, rows, tmp_path, kind="double"):
    table(spark, rows, kind).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = V.op11_vector_codes(spark, str(tmp_path)).collect()
    assert got == [] or got[0].__fields__ == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, got), key=repr)


@pytest.mark.parametrize("dim", [16, 32, 64])
def test_op11_equals_brute_force(spark, tmp_path, dim):
    """With nulls, components that are not finite, repeated ids and rows, null ids and labels, large numbers and ties."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(150, dim)) * 0.3
    x[40:60] = x[40]
    rows = [(int(i) * 3 - 50, v.tolist(), int(i) % 4 if i % 7 else None) for i, v in enumerate(x)]
    rows += [(-50, x[70].tolist(), 1), rows[5], rows[5], (None, x[3].tolist(), 2), (None, x[4].tolist(), None), (10**12, [1e5] * dim, 9), (-(10**12), [0.0] * dim, 1)]
    rows += [(1, None, 1), (2, [None] + [0.0] * (dim - 1), 1), (3, [math.nan] * dim, 1), (4, [0.0] * (dim - 1) + [math.inf], None)]
    assert run(spark, rows, tmp_path) == sorted(brute_force(rows), key=repr)


def test_op11_dimensions_differ(spark, tmp_path):
    """Vectors are filled up with zeros; empty ones are zeros."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=int(n)).tolist(), 0) for i, n in enumerate(rng.integers(0, 40, 90))]
    assert run(spark, rows, tmp_path) == sorted(brute_force(rows), key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(5, [], 3), (4, [], None)], [(7, [0.1] * 16, None)]])
def test_op11_small_tables(spark, tmp_path, rows):
    assert run(spark, rows, tmp_path, "float") == sorted(brute_force(rows), key=repr)


def test_op11_other_settings_and_decoding(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), v.tolist(), int(i) % 3) for i, v in enumerate(rng.normal(size=(300, 12)))]
    codes, books = V.compress(table(spark, rows), parts=3, entries=200, rounds=4, scale=1000.0)
    want = brute_force(rows, 3, 200, 4, 1000.0)
    got = {r["vec_id"]: r for r in V.decoded(codes, books).collect()}
    assert sorted((i, bytes(r["code"]).hex(), r["error"]) for i, r in got.items()) == sorted(w[:3] for w in want)
    assert books.digest() == want[0][4]
    for i, v, _ in rows:
        whole = np.floor(1000 * np.array(v))
        assert round(float(((whole - 1000 * np.array(got[i]["vector"])) ** 2).sum())) == got[i]["error"]
    with pytest.raises(ValueError, match="entries"):
        V.fit_codebooks(codes, entries=300)


def test_op11_far_components_are_held(spark):
    """Components beyond the limit count as it, so sums and distances stay within 64 bits."""
    codes, books = V.compress(table(spark, [(0, [1e300] * 64, 0), (1, [-1e300] * 64, 0), (2, [0.0] * 64, 0), (3, [1e299] * 64, 0)]), entries=2, rounds=0)
    got = {r["vec_id"]: (bytes(r["code"])[0], r["error"]) for r in codes.collect()}
    assert int(abs(books.entries).max()) == 1 << 27 and got[0] == got[3] == (0, 0) and got[1] == (1, 0) and got[2] == (0, 64 << 54)


def test_op11_many_partitions_make_a_tree(spark):
    rows = [(i, [float(i % 11), float(i % 7)], i % 2) for i in range(4000)]
    wide = spark.createDataFrame([(i, v, label) for i, v, label in rows], "vec_id long, embedding array<double>, label int").repartition(70)
    blocks = V.blocks_of(wide)
    assert V._depth(blocks.rdd) >= 2
    assert V.fit_codebooks(blocks, 2, 8).digest() == V.fit_codebooks(V.blocks_of(wide.repartition(3)), 2, 8).digest() == brute_force(rows, 2, 8)[0][4]
