"""Operators on texts against brute force."""

import hashlib
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from clonespark.llm import arrowtext as A
from clonespark.llm import exchange as X
from clonespark.llm import bpe, lm_scoring, mixing, quality, registry, simhash, substring_dedup, wordpiece
from clonespark.operators.components import forest


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_word_spans_and_hashes():
    texts = [b"", b" a  bc\tD\n", b"\x0b\x0c", "é x".encode(), b"q" * 5000, b"ends", b"joined"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    w = A.split_words(data, offsets)
    got = [[data[s:e].tobytes() for s, e in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [t.split() for t in texts]
    h = A.hash_spans(data, w.starts, w.ends)
    assert len(set(h.tolist())) == len({x for t in got for x in t})
    joined, at = A.joined_words(w)
    assert [joined[i:j].tobytes() for i, j in zip(at[:-1], at[1:])] == [b" ".join(t) for t in got]


def test_xxh64_equals_the_library():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = rng.integers(0, 2800, 500)
    ends = starts + rng.integers(0, 150, 500)
    assert A.xxh64_spans(data, starts, ends, 42).tolist() == [xxhash.xxh64_intdigest(data[s:e].tobytes(), 42) for s, e in zip(starts, ends)]


def test_op1_scores(spark, folder, rows):
    got = ordered(lm_scoring.op1_lm_scoring(spark, folder).collect())
    want = ordered(lm_scoring.brute_force([r[:2] for r in rows]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_op1_orders(docs, rows, order):
    """Chains of failure arcs of any length, from carried states, equal the recursive formula."""
    got = lm_scoring.score_texts(docs.withColumn("held_out", lm_scoring.fold() == 1), F.expr("not held_out"), keep=("doc_id", "held_out"), order=order).collect()
    want = lm_scoring.brute_force([r[:2] for r in rows], order)
    assert np.allclose(sorted(r["score"] for r in got), sorted(w[-1] for w in want), rtol=1e-9)


def _automaton(texts, order=3):
    """The automaton of texts of small numbers (0 is the end), all of them training, and the numbers of their words."""
    tokens = [x for t in texts for x in [*t, 0]]
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    padded = [["<s>", *t, 0] for t in texts]
    numbers, grams, counts = {k: {} for k in range(1, order + 1)}, {}, {}
    for k in range(1, order + 1):
        grams[k] = np.array([numbers[k].setdefault(tuple(p[i + 1 - k : i + 1]), len(numbers[k])) if i + 1 >= k else -1 for p in padded for i in range(1, len(p))])
        counts[k] = np.bincount(grams[k][grams[k] >= 0])
    context = {k: np.array([numbers[k - 1].get(g[:-1], len(numbers[1])) for g in numbers[k]]) for k in range(2, order + 1)}
    suffix = {k: np.array([numbers[k - 1][g[1:]] for g in numbers[k]]) for k in range(2, order + 1)}
    last = {k: np.array([numbers[1][g[-1:]] for g in numbers[k]]) for k in range(2, order + 1)}
    automaton = lm_scoring.BackoffAutomaton.of(counts, last, context, suffix, len(texts), len(tokens), len(numbers[1]))
    return automaton, grams[1], first, numbers


def test_op1_states_sum_to_one():
    """The weights of a state's steps over all known words, and the unseen class, as probabilities."""
    texts = [[1, 2, 1, 2, 3], [1, 2, 3], [2, 2, 1]]
    automaton, _, first, numbers = _automaton(texts)
    words, total = len(numbers[1]), int(first[-1])
    unseen = 0.5 / (total + 0.5 * (words + 1))
    ends = {0} | {s for s, g in enumerate([(), *numbers[1], ("<s>",), *numbers[2]]) if 0 in g}  # nothing follows an end
    for state in range(len(automaton.failure)):
        if state == 0 or state not in ends:
            weight, _ = automaton.step(np.full(words, state), np.arange(words))
            lost, at = 0.0, state
            while at:
                lost, at = lost + automaton.failure[at], int(automaton.fallback[at])
            assert np.isclose((10**weight).sum() + 10**lost * unseen, 1)


@pytest.mark.parametrize("stretch", [1, 2, 3, 512])
def test_op1_stretches_run_in(stretch):
    """A text in stretches has the weights of one traversal from its beginning."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 4, n).tolist() for n in (1, 2, 7, 30, 0, 100)]
    for order in (1, 2, 3, 4):
        automaton, word, first, _ = _automaton(texts, order)
        assert np.allclose(automaton.traverse(word, first, stretch), automaton.traverse(word, first, 1000))


def test_op1_follows_its_arcs():
    """Scores depend on where arcs and failure arcs lead, as the traversal has no other way to know a token's context."""
    texts = [[1, 2, 1, 2, 3, 1, 1, 2], [1, 2, 3, 3, 1], [2, 2, 1, 3]]
    automaton, word, first, _ = _automaton(texts)
    word = np.concatenate([word, word[::-1]])  # texts of the training, and others, which take failure arcs
    first = np.concatenate([first, first[1:] + first[-1]])
    right = automaton.traverse(word, first)
    assert (automaton.to[automaton.to > 0] != automaton.begin).all()
    for field in ("to", "fallback"):
        wrong = getattr(automaton, field).copy()
        kept, wrong[:] = wrong.copy(), 0
        setattr(automaton, field, wrong)
        assert not np.allclose(automaton.traverse(word, first), right)
        setattr(automaton, field, kept)
    used = [i for i, to in enumerate(automaton.to) if to > 0]
    moved = 0
    for i in used:  # one arc alone
        kept, automaton.to[i] = automaton.to[i], 0
        moved += not np.allclose(automaton.traverse(word, first), right)
        automaton.to[i] = kept
    assert moved > len(used) / 3 and np.allclose(automaton.traverse(word, first), right)


def test_op1_copies_stand_apart(spark):
    """Of training texts of one kind, those that occur twice score higher by the word."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 60) % 500) for _ in range(150)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:50]])], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_scoring.score_texts(table, F.lit(True)).collect()}
    assert max(got[i] for i in range(50, 150)) < np.quantile([got[i] for i in range(50)], 0.3)


def test_op4_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert ordered(substring_dedup.op4_substring_dedup(spark, folder).collect()) == ordered(con.sql(substring_dedup.ORACLE).fetchall())


@pytest.mark.parametrize(("window", "base"), [(35, 9), (35, 18), (35, 5), (4, 9), (3, 1), (1, 1)])
def test_op4_removes_what_repeats(docs, rows, window, base):
    got = substring_dedup.remove_repeats(docs, window, base)
    assert got.columns[-3:] == ["kept_text", "n_words", "n_removed"]
    found = ordered((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got.collect())
    assert found == ordered(substring_dedup.brute_force([r[:2] for r in rows], window))


@pytest.mark.parametrize("colliding", ["words", "windows"])
def test_op4_false_matches_are_found_out(rows, colliding, monkeypatch):
    """With hashes that collide all the time, the digests of the last level tell windows apart."""
    if colliding == "words":  # the plain seeds see a word's size alone
        plain = A.hash_spans
        monkeypatch.setattr(A, "hash_spans", lambda data, starts, ends, seed=0: plain(data, starts, ends, seed) if seed else (ends - starts).astype(np.uint64))
    else:
        plain_windows = A.window_values
        monkeypatch.setattr(A, "window_values", lambda total, at, k, seed=0: plain_windows(total, at, k, seed) % np.uint64(1 << 64 - 1 if seed > 100 else 3))
    texts = [t or "" for _, t, _ in rows]
    passes = substring_dedup._Passes(substring_dedup.levels(35))
    blocks = [substring_dedup._Block(pa.table({"text": texts[i::2]})) for i in range(2)]
    answers = [[], []]
    for level in range(3):
        asked = [passes.request(b, level, pa.Table.from_pylist(a) if a else None)[0] for b, a in zip(blocks, answers)]
        replies = substring_dedup._Repeats()
        _, merged, places = replies.merge([k for k, _ in asked], [{"b": None} | {c: X.pack(v) for c, v in more.items()} for _, more in asked])
        for a, p in zip(answers, places):
            a.append({"level": level, "bucket": 0, "x": X.squeezed(replies.tell(merged["a"][p]))})
    want = substring_dedup.brute_force([r[:2] for r in rows])
    removed = [0] * len(rows)
    for i, (b, a) in enumerate(zip(blocks, answers)):
        found = np.flatnonzero(passes.repeats(b, pa.Table.from_pylist(a)))
        gone = {w for f in found for w in range(f, f + 35)}
        for d in range(len(b.words.first) - 1):
            removed[2 * d + i] = sum(w in gone for w in range(b.words.first[d], b.words.first[d + 1]))
    assert removed == [w[2] for w in want]


def test_op4_levels():
    assert substring_dedup.levels(35) == [9, 18, 35] and substring_dedup.levels(35, 5) == [5, 9, 18, 35] and substring_dedup.levels(1) == [1]


def test_op4_stage_keeps_rows_and_columns(docs):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r["_block"] for r in out.collect()} == {"n"}


def test_op7_equals_the_library(spark, folder, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert ordered(bpe.op7_bpe_codec(spark, folder).collect()) == ordered(want)


def test_op7_random_texts_equal_the_library():
    import random

    from tokenizers import Tokenizer

    library, codec, rng = Tokenizer.from_file(bpe.vocabulary_path()), bpe.codec(open(bpe.vocabulary_path(), encoding="utf-8").read()), random.Random(2)
    texts = ["".join(rng.choice("aabeilnorstTH '’.,-1éß<|>\n日") for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a" * n for n in range(80)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids and codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_op7_refuses_other_kinds():
    with pytest.raises(ValueError):
        bpe.BpeCodec('{"model": {"end_of_word_suffix": null}, "normalizer": {"normalizers": []}, "pre_tokenizer": {"pretokenizers": []}, "decoder": null, "post_processor": null}')


def test_op8_equals_longest_match(docs, rows):
    initial, continuing = [b"a", b"ab", b"abc", b"e", b"w", "é".encode(), b"end"], [b"a", b"b", b"ab", b"bcd", b"d", b"e", b"w", b"ww"]
    got = wordpiece.count_tokens(docs, initial, continuing).collect()
    assert ordered(got) == ordered(wordpiece.brute_force([r[:2] for r in rows], initial, continuing))


def test_op8_query(spark, folder, rows):
    pieces = wordpiece.byte_level_pieces(wordpiece.vocabulary_path("byte_bpe_50k.json"))
    assert ordered(wordpiece.op8_token_counts(spark, folder).collect()) == ordered(wordpiece.brute_force([r[:2] for r in rows], *pieces))


def test_op9_equals_all_pairs(spark, folder, rows):
    assert ordered(simhash.op9_simhash_near_dedup(spark, folder).collect()) == ordered(simhash.brute_force([r[:2] for r in rows]))


@pytest.mark.parametrize("bits", [6, 8])
def test_op9_links_lose_no_pair(bits):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(200)], np.uint64)
    x = np.unique(np.concatenate([base, base[rng.integers(0, 40, 200)] ^ flips]))
    links = set()
    for bucket in range(1 << bits):
        a, b = simhash.links_in_bucket(x, bucket, bits, 2, slice_=5000)
        links |= set(zip(a.tolist(), b.tolist()))
    assert all(bin(a ^ b).count("1") <= 4 for a, b in links)
    a, b = np.array(list(links), np.uint64).T
    node, root = forest(a, b)
    found = dict(zip(node.tolist(), root.tolist()))
    want = {(i, j) for k, i in enumerate(x.tolist()) for j in x[k + 1 :].tolist() if bin(i ^ j).count("1") <= 4}
    assert want and all(found.get(i, i) == found.get(j, j) for i, j in want)


@pytest.mark.parametrize("bits", [6, 11, 13])
def test_op9_messages_are_whole_and_bounded(bits):
    """In slices, every fingerprint still goes to each bucket that has variants of it, and little memory is held."""
    import tracemalloc

    x = np.random.default_rng(1).integers(0, 1 << 63, 60, dtype=np.uint64)
    got = {}
    for buckets, packed in simhash.messages(x, bits, 2, slice_=1 << 10):
        assert sum(map(len, packed)) <= 8 * max(1 << 10, len(x))
        for k, p in zip(buckets.tolist(), packed):
            got.setdefault(k, []).extend(np.frombuffer(p, np.uint64).tolist())
    balls = simhash.ball(2)
    want = {}
    for f in x:
        for k in np.unique(simhash.syndrome(f ^ balls, bits)).tolist():
            want.setdefault(k, set()).add(int(f))
    assert {k: set(v) for k, v in got.items()} == want and all(len(v) == len(set(v)) for v in got.values())
    tracemalloc.start()
    for _ in simhash.messages(np.random.default_rng(1).integers(0, 1 << 63, 10_000, dtype=np.uint64), bits, 2):
        if tracemalloc.get_traced_memory()[1] > 1 << 28:
            break
    assert tracemalloc.get_traced_memory()[1] < 1 << 28
    tracemalloc.stop()


def test_op9_many_buckets(spark, folder, rows, monkeypatch):
    """The regime of large tables: a fingerprint goes to most of 2,048 buckets."""
    monkeypatch.setattr(simhash, "BUCKET", 1 << 7)
    assert simhash.bits_for(80, 2) == 11
    assert ordered(simhash.op9_simhash_near_dedup(spark, folder).collect()) == ordered(simhash.brute_force([r[:2] for r in rows]))


def test_op9_stage_keeps_one_of_each(docs, rows):
    kept = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    components = {i: c for i, _, c in simhash.brute_force([r[:2] for r in rows]) if i is not None}
    # the two texts of 8 are components of their own; one row without an id has a null text, as row 300
    assert sorted(k for k in kept if k is not None) == sorted([*set(components.values()), 8]) and kept.count(None) == 1


def test_op3_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.5)).astype(float)
    trees = quality.fit(x[:1500], y[:1500])
    assert ((trees.predict(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    one = quality.fit(np.zeros((0, 5)), np.zeros(0))
    assert one.predict(x[:3]).tolist() == [0.5] * 3
    assert quality.fit(x, np.ones(2000)).predict(x[:1])[0] > 0.99


def test_op3_statistics_do_not_depend_on_the_batch(rows):
    texts = [(t or "").encode() for _, t, _ in rows]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    every = quality.statistics(data, offsets)
    assert every.shape == (len(rows), len(quality.NAMES)) and np.isfinite(every).all()
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], every[i])


def test_op3_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = quality.op3_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 500 and (got.predicted == got.quality).mean() > 0.98


def test_op3_odd_rows(spark, folder, rows):
    got = quality.op3_quality_classifier(spark, folder).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_op5_targets_and_copies(spark, folder, rows):
    import re

    got = mixing.op5_mix_sources(spark, folder).collect()
    again = mixing.op5_mix_sources(spark, folder).collect()
    assert ordered(got) == ordered(again) and len(got) == len(rows)
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert ordered((r["doc_id"], r["size"]) for r in got) == ordered((i, size(t)) for i, t, _ in rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight, target, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, set()
    while True:  # share, cap, and share the excess again
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / sum(weight[o] for o in open_) for s in order}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(sizes[s], round(target[s], 6)) for s in order}
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_op5_stage(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {r["size"] for r in out.collect()} == {-5}


def test_empty_tables(spark, empty):
    for name, query in registry.QUERIES.items():
        assert query(spark, empty).count() == 0, name


def test_queries_need_no_python_where_native(spark, folder):
    plan = mixing.op5_mix_sources(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
