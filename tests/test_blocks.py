"""Cosine matches block against block, against all pairs."""

import numpy as np
import pytest

from clonespark.operators import blocks as B
from clonespark.operators import textclone as T


@pytest.mark.parametrize("least", [0.5, 0.9, 0.0])
def test_matches_of_two_blocks_are_those_of_all_pairs(monkeypatch, least):
    pa = pytest.importorskip("pyarrow")
    monkeypatch.setattr(B, "CELLS", 100)
    monkeypatch.setattr(B, "CHUNK", 50)
    rng = np.random.default_rng(1)
    dense = rng.random((60, 40)) * (rng.random((60, 40)) < 0.2)
    dense[30:40] = dense[:10] + 0.05 * (rng.random((10, 40)) < 0.1)
    dense /= np.maximum(np.sqrt((dense**2).sum(1, keepdims=True)), 1e-9)

    def block(at):
        places = [np.flatnonzero(dense[i]) for i in at]
        return B.Block(pa.table({"n": pa.array(at, pa.int64()), "g": pa.array([p.astype(np.int32) for p in places]), "v": pa.array([dense[i][p] for i, p in zip(at, places)])}))

    product = dense @ dense.T
    for x, y, same in ((range(25), range(25, 60), False), (range(60), range(60), True)):
        found = [r for batch in B.matches(block(list(x)), block(list(y)), least, 0.6 * least, same) for r in zip(*(c.to_pylist() for c in batch.columns))]
        expected = {(i, j) for i in x for j in y if product[i, j] > least and (not same or i < j)}
        assert {(i, j) for i, j, _ in found} == expected and len(found) == len(expected)
        assert all(abs(s - product[i, j]) < 1e-12 for i, j, s in found)


def test_texts_in_many_blocks_match_once(spark, monkeypatch):
    monkeypatch.setattr(B, "POSTINGS", 200)
    words = ["alpha", "gamma", "delta", "omega", "sigma", "kappa"]
    texts = [(i, " ".join(words[(i * k + k * k) % 6] for k in range(1, 8)) + f" {i % 4}") for i in range(24)] + [(90, None), (91, "abc")]
    w = T.stored_weights(spark.createDataFrame(texts, "id long, text string"))
    found = T.cosine_matches(w, top=None)
    vectors: dict = {}
    for r in w.collect():
        vectors.setdefault(r["id"], {})[r["gram"]] = r["w"]
    sims = {(i, j): sum(v * b.get(g, 0.0) for g, v in a.items()) for i, a in vectors.items() for j, b in vectors.items()}
    assert sorted((r["i"], r["j"], round(r["sim"], 9)) for r in found.collect()) == sorted((i, j, round(s, 9)) for (i, j), s in sims.items() if s > 0.5)


def test_best_few_of_many_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(B, "POSTINGS", 100)
    monkeypatch.setattr(B, "CELLS", 7)
    words = ["alpha", "gamma", "delta", "omega", "sigma", "kappa"]
    texts = [(f"{'n' if i % 3 else 'r'}{i}", " ".join(words[(i * k + k * k) % 6] for k in range(1, 5)) + f" {i % 5}") for i in range(24)] + [("r90", "zzzzzz")]
    w = T.stored_weights(spark.createDataFrame(texts, "id string, text string"))
    left, right = w.where("id like 'r%'"), w.where("id like 'n%'")
    vectors: dict = {}
    for r in w.collect():
        vectors.setdefault(r["id"], {})[r["gram"]] = r["w"]
    expected = []
    for i in (v for v in vectors if v[0] == "r"):
        sims = [(round(sum(x * vectors[j].get(g, 0.0) for g, x in vectors[i].items()), 9), j) for j in vectors if j[0] == "n"]
        expected += [(i, j, s) for s, j in sorted((p for p in sims if p[0] > 0), key=lambda p: (-p[0], p[1]))[:3]]
    assert sorted((r["i"], r["j"], round(r["sim"], 9)) for r in B.block_best(left, right, 3).collect()) == sorted(expected)
    assert B.block_best(left, right.limit(0), 3).collect() == [] == B.block_best(left.limit(0), right, 3).collect()


def test_weights_made_again_are_those_of_the_table_and_blocks_grow_with_it(spark, monkeypatch):
    """A text's row has no weights, so it is sent in a third of the bytes; a larger table has larger blocks first, up to POSTINGS."""
    pa = pytest.importorskip("pyarrow")
    rows = pa.table({"n": pa.array([0, 1]), "g": pa.array([[0, 2, 5], [1, 2]], pa.list_(pa.int32())), "f": pa.array([[1, 2, 1], [3, 1]], pa.list_(pa.int32())), "size": [2.0, 4.0]})
    made = B.weighted(rows, np.array([0, 2]), np.array([8.0, 3.0]))
    assert made.column("v").to_pylist() == [[4.0, 3.0, 1.5], [6.0, 0.75]]
    monkeypatch.setattr(B, "FEWEST", 20)
    sent = []
    monkeypatch.setattr(B, "stored", lambda df, name, keep=B.stored: (sent.append((name, df.rdd.getNumPartitions())) if name == "block-matches" else None) or keep(df, name))
    texts = [(i, f"some words {i % 7} of text {i % 5}") for i in range(60)]
    found = B.block_matches(T.stored_weights(spark.createDataFrame(texts, "id long, text string")), 0.5, 0.3)
    assert found.count() == found.select("i", "j").distinct().count() > 0
    assert B.BLOCKS * (B.BLOCKS + 1) // 2 <= sent[0][1] <= (B.BLOCKS + 1) * (B.BLOCKS + 2) // 2
