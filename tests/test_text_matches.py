"""Cosine matches among texts: without a row for each weight, and with few products and few whole comparisons."""

import numpy as np
import pytest

from clonespark.operators import blocks as B
from clonespark.operators import textclone as T

WORDS = ["alpha", "gamma", "delta", "omega", "sigma", "kappa"]


def _texts():
    texts = [(i % 40, " ".join(WORDS[(i * k + k * k) % 6] for k in range(1, 8)) + f" {i % 4}") for i in range(48)]  # 8 ids have two texts
    return texts + [(90, None), (91, "abc"), (92, ""), (93, "žluť ☃ žluť ☃ kůň, a-b/c BD"), (94, "žluť ☃ žluť ☃ kůň a"), (95, None), (95, "alpha gamma")]


@pytest.mark.parametrize("least", [0.5, 0.0])
def test_texts_match_as_their_weights_do(spark, monkeypatch, least):
    monkeypatch.setattr(B, "POSTINGS", 200)
    monkeypatch.setattr(T, "GRAMS", 30)
    texts = spark.createDataFrame(_texts(), "id long, text string")
    vectors: dict = {}
    for r in T.stored_weights(texts).collect():
        vectors.setdefault(r["id"], {})[r["gram"]] = r["w"]
    sims = {(i, j): sum(v * b.get(g, 0.0) for g, v in a.items()) for i, a in vectors.items() for j, b in vectors.items()}
    found = T.text_matches(texts, least=least, top=None)
    assert sorted((r["i"], r["j"], round(r["sim"], 9)) for r in found.collect()) == sorted((i, j, round(s, 9)) for (i, j), s in sims.items() if s > least)


def test_counted_texts_have_the_ngrams_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(T, "GRAMS", 30)
    texts = spark.createDataFrame(_texts(), "id long, text string")
    for window in (20, None):
        expected = sorted((r["id"], r["gram"], r["tf"]) for r in T.tokens(texts, window).collect())
        rows = T.counted(texts, window).collect()
        assert len({r["id"] for r in rows}) == len(rows)
        assert sorted((r["id"], g, f) for r in rows for g, f in zip(r["gram"], r["tf"], strict=True)) == expected


def test_no_texts_have_no_matches(spark):
    assert T.text_matches(spark.createDataFrame([], "id long, text string"), top=None).collect() == []
    assert T.text_matches(spark.createDataFrame([(1, None), (2, "abc")], "id long, text string")).collect() == []


def test_frequent_ngrams_are_not_added_up_for_every_pair(monkeypatch):
    """Texts of 15 rare n-grams (of 10,000) and 60 frequent ones (of 200) with the weights of their frequencies: bounded by the tail of one text alone, half of all products and more were made."""
    pa = pytest.importorskip("pyarrow")
    rng = np.random.default_rng(5)
    n = 400
    g = [np.sort(np.concatenate([rng.choice(10_000, 15, replace=False), 10_000 + rng.choice(200, 60, replace=False)])).astype(np.int32) for _ in range(n)]
    g[7], g[211] = g[5], np.sort(np.concatenate([g[3][:45], g[9][45:]]))
    df = np.bincount(np.concatenate(g), minlength=10_200)
    weights = [(np.log((1 + n) / (1 + df[x])) + 1) for x in g]
    v = [w / np.sqrt((w * w).sum()) for w in weights]
    block = B.Block(pa.table({"n": pa.array(range(n), pa.int64()), "g": pa.array(g), "v": pa.array(v)}))
    made, compared = [], []
    spread, products = B._spread, B._products
    monkeypatch.setattr(B, "_spread", lambda first, count: made.append(int(count.sum())) or spread(first, count))
    monkeypatch.setattr(B, "_products", lambda a, b, x, y: compared.append(len(x)) or products(a, b, x, y))
    dense = np.zeros((n, 10_200))
    for i in range(n):
        dense[i, g[i]] = v[i]
    sims = dense @ dense.T
    found = {(i, j) for batch in B.matches(block, block, 0.5, 0.45, True) for i, j, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    assert found == {(i, j) for i in range(n) for j in range(i + 1, n) if sims[i, j] > 0.5} and (5, 7) in found
    every = float((df.astype(float) ** 2).sum())
    assert sum(made) < every / 10 and sum(compared) < n * n / 20, (sum(made), every, sum(compared))


def test_best_of_lists_are_those_of_the_weights_of_both_sides(spark, monkeypatch):
    monkeypatch.setattr(B, "POSTINGS", 100)
    texts = spark.createDataFrame(_texts(), "id long, text string")
    strangers = spark.createDataFrame([(i, " ".join(WORDS[(i + k * k) % 6] for k in range(4))) for i in range(9)] + [(9, "abc"), (10, None)], "id long, text string")
    name = lambda df, c: df.selectExpr(f"concat('{c}', lpad(id, 3, '0')) id", "text")
    w = T.stored_weights(name(texts, "r").unionByName(name(strangers, "n")))
    expected = B.block_best(w.where("id like 'r%'"), w.where("id like 'n%'"), 3).collect()
    found = B.list_best(T.counted(texts), T.counted(strangers), 3).collect()
    assert len(expected) > 90 and sorted((r["i"], r["j"], round(r["sim"], 9)) for r in found) == sorted((int(r["i"][1:]), int(r["j"][1:]), round(r["sim"], 9)) for r in expected)


def test_alignment_free_counts_the_texts_ngrams_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(T, "counted", lambda texts, window=150, n=5, keep=T.counted: seen.append(texts.count()) or keep(texts, window, n))
    monkeypatch.setattr(T, "stored_weights", lambda *a, **k: pytest.fail("a table with a row for each weight"))
    texts = spark.createDataFrame(_texts(), "id long, text string")
    found = T.alignment_free(texts, spark.createDataFrame([("alpha gamma omega",), ("kappa sigma delta",), ("alpha alpha kappa",)], "text string"), percent=10.0).collect()
    assert {r["id"] for r in found} == {r["id"] for r in texts.collect()} and seen == [texts.count(), 3]
