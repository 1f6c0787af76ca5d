"""Blocks ask buckets themselves or through relays; equal rows are dealt to several blocks."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonespark.llm import exchange as X
from clonespark.llm import lm_scoring, substring_dedup


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture
def relayed(monkeypatch):
    monkeypatch.setattr(X, "DIRECT", 1)


@pytest.mark.parametrize("window", [35, 4])
def test_op4_through_relays(docs, rows, relayed, window):
    got = substring_dedup.remove_repeats(docs, window).collect()
    found = ordered((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got)
    assert found == ordered(substring_dedup.brute_force([r[:2] for r in rows], window))


def test_op1_through_relays(spark, folder, rows, relayed):
    got = {repr(tuple(r)[:5]): tuple(r)[5:] for r in lm_scoring.op1_lm_scoring(spark, folder).collect()}
    want = {repr(tuple(r)[:5]): r[5:] for r in lm_scoring.brute_force([r[:2] for r in rows])}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_relays_of_empty_tables(spark, empty, relayed):
    assert not substring_dedup.op4_substring_dedup(spark, empty).collect() and not lm_scoring.op1_lm_scoring(spark, empty).collect()


@pytest.mark.parametrize("n", [2, 3, 7, 8, 50, 4097, 125_000])
def test_routes(n):
    """Groups cover the buckets, whose keys are the same ranges seen from blocks and from relays, and messages are 2 n sqrt(n) or so."""
    route = X.Route.of(n, 1)
    assert route.buckets >= n and route.groups * route.depth >= n and route.relays <= (math.sqrt(n) + 1) ** 2
    assert n * route.first + route.relays * route.width <= 2 * (math.sqrt(n) + 1) ** 3
    keys = np.sort(np.random.default_rng(n).integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2))
    groups, buckets = X.by_bucket(keys, route.groups), X.by_bucket(keys, route.buckets)
    assert (groups == buckets[:: route.width]).all()
    for g in (0, route.groups - 1):
        own = keys[groups[g] : groups[g + 1]]
        limits = X.by_bucket(own, route.buckets, g * route.width, (g + 1) * route.width)
        assert (limits + groups[g] == buckets[g * route.width : (g + 1) * route.width + 1]).all()


def test_few_blocks_ask_themselves():
    assert not X.Route.of(X.DIRECT).groups and X.Route.of(X.DIRECT + 1).groups == 65


def test_copies_are_numbered_over_batches():
    copies, rng = X._Copies(), np.random.default_rng(3)
    seen: dict[int, int] = {}
    for size in (0, 1, 500, 500, 3):
        keys = rng.integers(-40, 40, size)
        want = []
        for k in keys.tolist():
            want.append(seen.get(k, 0))
            seen[k] = want[-1] + 1
        assert copies.numbers(keys).tolist() == want


def test_equal_rows_are_in_many_blocks(spark, rows):
    """A row that is a third of all rows, with an id and without one: no block has much more than its share, and results are right."""
    hot = [(1, "to be or not to be that is", "x")] * 3000 + [(None, "404 not found", "x")] * 1000
    table = [r[:2] for r in [*rows[:60], *hot]] + [(1000 + i, f"text {i} of its own") for i in range(6000)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    blocks = X.in_blocks(docs, 16).select("block", F.col("rows")).toPandas()
    sizes = blocks.groupby("block")["rows"].apply(lambda g: sum(X.pa.ipc.open_stream(m).read_all().num_rows for m in g))
    assert sizes.sum() == len(table) and sizes.max() < 1.3 * len(table) / 16
    got = substring_dedup.remove_repeats(docs, 4).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert ordered(got) == ordered(substring_dedup.brute_force(table, 4))
