"""Order statistics by refined ranges, and the best matches from bounded postings, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonespark.operators import selection, topmatches
from clonespark.operators import textclone as T
from clonespark.plans.lineage import stored


@pytest.mark.parametrize("kind", ["uniform", "few values", "wide", "one", "two", "clustered"])
def test_percentiles_equal_numpy(spark, monkeypatch, kind):
    rng = np.random.default_rng(1)
    x = {
        "uniform": rng.random(3000), "few values": rng.integers(0, 4, 2000) / 7, "wide": np.concatenate([rng.normal(size=500) * 1e-300, rng.normal(size=500) * 1e300, [1.7e308, -1.7e308]]),
        "one": np.array([0.25]), "two": np.array([-1.0, 3.0]), "clustered": np.concatenate([1 + rng.random(1000) * 1e-13, rng.random(1000) * 1e9, np.full(5000, 1.0)]),
    }[kind]
    monkeypatch.setattr(selection, "BUCKETS", 16)
    shares = [0.0, 0.001, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    table = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(3)
    got = selection.percentiles(table, "v", shares)
    s = sorted(x.tolist())
    for p, g in zip(shares, got):
        at = p * (len(s) - 1)
        lo, hi = s[math.floor(at)], s[math.ceil(at)]
        assert g == lo + (hi - lo) * (at - math.floor(at))


def test_percentiles_of_nothing_and_ranks(spark):
    none = spark.createDataFrame([(None,)], "v double")
    assert selection.percentiles(none, "v", [0.1, 0.5]) == [None, None]
    assert T.percentile_threshold(none.withColumnRenamed("v", "distance")).collect()[0][0] is None
    table, _ = stored(spark.range(100).select(F.col("id").cast("double").alias("x")), "x")
    assert selection.values_at(table, [0, 7, 99]) == {0: 0.0, 7: 7.0, 99: 99.0}
    with pytest.raises(ValueError, match="ranks"):
        selection.values_at(table, [100])


def brute_top(left, right, k):
    out = {}
    for i, x in left.items():
        sims = sorted(((-round(s, 9), j) for j, y in right.items() if (s := sum(w * y[g] for g, w in x.items() if g in y)) > 0))
        out[i] = [(j, -s) for s, j in sims[:k]]
    return out


@pytest.mark.parametrize(("k", "slices"), [(1, (0.5, 0.25, 0.1, 0.0)), (3, (0.9, 0.6, 0.0)), (5, (0.0,)), (200, (0.5, 0.0))])
def test_top_matches_equal_all_pairs(spark, monkeypatch, k, slices):
    """With texts alike, ties among copies, texts with few or no matches, a frequent n-gram that is dealt out, and nulls."""
    monkeypatch.setattr(topmatches, "SLICES", slices)
    monkeypatch.setattr(topmatches, "EACH", 20)
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    pool = [word() for _ in range(60)]
    text = lambda: "the common part " + " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))
    reads, others = [text() for _ in range(50)], [text() for _ in range(70)]
    others += others[:3] * 2 + ["zzzzzzzz", "", "abc"]
    reads += [others[5], others[0] + "x", "qqqqqqqqq", "", None, "zzzzzzz"]
    rows = [(f"r{i}", t) for i, t in enumerate(reads)] + [(f"n{j:03d}", t) for j, t in enumerate(others)]
    w = T.stored_weights(spark.createDataFrame(rows, "id string, text string"))
    sides = {"r": {}, "n": {}}
    for r in w.collect():
        sides[r["id"][0]].setdefault(r["id"], {})[r["gram"]] = r["w"]
    got = {}
    for r in topmatches.top_matches(w.where("id like 'r%'"), w.where("id like 'n%'"), k).collect():
        got.setdefault(r["i"], []).append((r["j"], r["sim"]))
    want = {i: v for i, v in brute_top(sides["r"], sides["n"], k).items() if v}
    assert got.keys() == want.keys()
    for i, v in want.items():
        mine = sorted(((-round(s, 9), j) for j, s in got[i]))
        assert [j for _, j in mine] == [j for j, _ in v] and np.allclose([-s for s, _ in mine], [s for _, s in v], atol=1e-8)


def test_top_matches_of_empty_sides(spark):
    w = T.stored_weights(spark.createDataFrame([("r1", "some text here")], "id string, text string"))
    assert topmatches.top_matches(w, w.limit(0), 3).collect() == [] == topmatches.top_matches(w.limit(0), w, 3).collect()
