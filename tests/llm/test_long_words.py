"""Very long words in the longest-match automaton."""

import random
import time

import numpy as np
import pytest

from clonespark.llm import arrowtext as A
from clonespark.llm import wordpiece


def test_long_words_are_counted_alone():
    rng = random.Random(1)
    initial, continuing = [b"a", b"ab", b"abc", b"e"], [b"a", b"b", b"ab", b"bcd", b"d", b"c"]
    words = ["".join(rng.choice("abcd") for _ in range(n)) for n in [*range(1, 200), 5000, 40_000]] + ["e" * 300, "ax" * 100]
    rows = [(1, " ".join(words))]
    automaton = wordpiece.MatchAutomaton(initial, continuing)
    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    w = A.split_words(data, np.array([0, len(data)]))
    got = automaton.counts(w.data, w.starts, w.ends)
    want = [wordpiece.brute_force([(0, x)], initial, continuing)[0] for x in words]
    assert got.tolist() == [0 if u else n for _, _, n, u in want]


def test_a_word_of_a_megabyte_takes_seconds():
    automaton = wordpiece.MatchAutomaton([b"a", b"ab"], [b"a", b"b", b"ab"])
    data = np.frombuffer(b"ab" * (1 << 19), np.uint8)
    began = time.time()
    assert automaton.counts(data, np.array([0]), np.array([len(data)])).tolist() == [1 << 19]
    assert time.time() - began < 10


def test_keep_may_not_clash(docs):
    with pytest.raises(ValueError):
        wordpiece.count_tokens(docs, [b"a"], [b"a"], keep=("n_words",))
