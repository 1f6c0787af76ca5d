"""The statistics and the trees against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from clonespark.llm import quality


def statistics(text: bytes) -> list[float]:
    """The 23 statistics of one text, one by one."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", text)
    lines = [tuple(w) for line in text.split(b"\n") if (w := re.findall(rb"[^\x20\x09-\x0d]+", line))]
    share = lambda k, n: k / max(n, 1)
    is_sign = lambda b: 0x21 <= b < 0x7F and not chr(b).isalnum()
    kinds = [lambda b: 0x41 <= b <= 0x5A, lambda b: 0x61 <= b <= 0x7A, lambda b: 0x30 <= b <= 0x39, is_sign, lambda b: b >= 0x80, lambda b: b in b" \t\n\x0b\x0c\r"]
    n, sizes = len(words), [len(w) for w in words]
    mean = share(sum(sizes), n)
    signs = lambda w: sum(map(is_sign, w))
    upper = lambda w: sum(0x41 <= b <= 0x5A for b in w)
    return [
        math.log1p(n),
        mean,
        math.sqrt(max(share(sum(s * s for s in sizes), n) - mean**2, 0)),
        *(share(sum(map(kind, text)), len(text)) for kind in kinds),
        share(len(lines), n),
        share(len(set(words)), n),
        share(max(Counter(words).values(), default=0), n),
        share(len(set(zip(words, words[1:]))), n - 1),
        share(sum(is_sign(w[-1]) for w in words), n),
        share(sum(len(w) >= 3 and signs(w[-3:]) == 3 for w in words), n),
        share(sum(len(w) > 1 and upper(w) == len(w) for w in words), n),
        share(sum(signs(w) == len(w) for w in words), n),
        share(sum(0x41 <= w[0] <= 0x5A for w in words), n),
        share(sum(s > 15 for s in sizes), n),
        share(sum(s < 3 for s in sizes), n),
        -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values()),
        share(len(set(lines)), len(lines)),
        math.log1p(share(n, len(lines))),
    ]


def test_statistics(rows):
    texts = [(t or "").encode() for _, t, _ in rows] + [b"A.B ...\n...\nThe THE the!!! 12\n\n x\x0by\r\nThe THE", b"one\none\none two", b"\n" * 5, b"w" * 3_000_000, b"a b " * 500_000]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = quality.statistics(data, offsets)
    assert len(quality.NAMES) == 23
    for t, row in zip(texts, got):
        want = statistics(t)
        assert np.allclose(row, want, atol=1e-9), [(n, a, b) for n, a, b in zip(quality.NAMES, row, want) if abs(a - b) > 1e-9]


@pytest.mark.parametrize("depth", [1, 2])
def test_splits(depth):
    """The first tree, level by level, by trying each split of each node."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = ((x[:, 1] > 0.2) | (x[:, 2] < -0.8)).astype(float)
    trees = quality.fit(x, y, trees=1, depth=depth, rate=0.1, ridge=1.0, least=5.0)
    p = np.full(len(y), y.mean())
    g, h = p - y, p * (1 - p)

    def best(rows):
        score = lambda k: g[k].sum() ** 2 / (h[k].sum() + 1.0)
        found = (1e-9, None)
        for f in range(4):
            for limit in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])):
                left, right = rows[x[rows, f] <= limit], rows[x[rows, f] > limit]
                if min(h[left].sum(), h[right].sum()) >= 5.0 and (gain := score(left) + score(right) - score(rows)) > found[0] + 1e-12:
                    found = (gain, (f, limit))
        return found[1]

    level = [np.arange(300)]
    for d in range(depth):
        following = []
        for k, rows in enumerate(level):
            node, split = (1 << d) - 1 + k, best(rows)
            if split is None:
                assert trees.limit[0, node] == np.inf
                following += [rows, rows[:0]]
            else:
                right = x[rows, split[0]] > split[1]
                assert (right == (x[rows, trees.feature[0, node]] > trees.limit[0, node])).all()
                following += [rows[~right], rows[right]]
        level = following
    want = [-0.1 * g[rows].sum() / (h[rows].sum() + 1.0) for rows in level]
    assert np.allclose(trees.value[0], want)


def test_one_id_does_not_push_out_the_others(spark):
    """The bound is one of distinct rows, and which of them are learnt from does not follow the ids."""
    docs = spark.createDataFrame([(0, f"text {i} {'x' * (i % 7)}") for i in range(300)] + [(0, "same")] * 500 + [(i, f"WORD {i}!") for i in range(1, 101)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(101)], "doc_id long, quality int")
    seen = []
    plain = quality.fit
    quality.fit = lambda x, y, **more: (seen.append((x, y)), plain(x, y, **more))[1]
    try:
        quality.fit_quality(docs, labels, sample=101)
    finally:
        quality.fit = plain
    x, y = seen[0]
    assert len(x) == 101 and y.sum() > 20
