"""The pipeline's rows against a brute-force pipeline over the small fixture."""

import hashlib
import re

import numpy as np

import corpus_pipeline
from clonespark.llm import bpe, quality, simhash


def _words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def _good(spark, rows, folder):
    """Documents with a score of 0.3 or more, each scored by itself."""
    trees = quality._trees(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    one = lambda raw: trees.predict(quality.statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))[0]
    return [r for r in rows if one((r[1] or "").encode()) >= 0.3]


def _without_copies(rows):
    """Of each component one row of its least id; ids come before rows without one."""
    prints = [int(f, 16) for _, f, _ in simhash.brute_force([r[:2] for r in rows])]
    root = {p: p for p in prints}
    for _ in prints:  # the least fingerprint that links lead to
        root = {p: min(root[q] for q in root if (p ^ q).bit_count() <= 4) for p in root}
    out = []
    for c in set(root.values()):
        own = [r for r, p in zip(rows, prints, strict=True) if root[p] == c]
        least = min((r[0] is None, r[0]) for r in own)[1]
        assert len({r for r in own if r[0] == least}) == 1, "the fixture leaves no choice"
        out.append(next(r for r in own if r[0] == least))
    return out


def _without_passages(rows, window=35):
    words = [_words(t) for _, t, _ in rows]
    seen: dict = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for (i, t, s), w in zip(rows, words, strict=True):
        gone = {k for a in range(len(w) - window + 1) if seen[tuple(w[a : a + window])] > 1 for k in range(a, a + window)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t, s))
    return out


def _mixed(rows):
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(_words(t))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set()
    while True:  # share, cap, and share the excess again
        left, open_ = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full), [s for s in order if s not in full]
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / sum(weight[o] for o in open_) for s in order}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    out = []
    for i, t, s in rows:
        key = str(i) if i is not None else "text " + hashlib.md5((t or "").encode()).hexdigest()
        u = int(hashlib.md5(f"mix-1:{key}".encode()).hexdigest()[:12], 16) / (1 << 48)
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        out += [(i, t, s)] * (int(rate) + (u < rate - int(rate)))
    return out


def test_pipeline_equals_brute_force(spark, folder, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = [lambda r: _good(spark, r, folder), _without_copies, _without_passages, _mixed]
    expected, docs = rows, spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        expected = brute(expected)
        docs, _ = corpus_pipeline.stored(stage(spark, docs, folder), f"brute-{name}")
        got = sorted(map(tuple, docs.select("doc_id", "text", "source").collect()), key=repr)
        assert expected and got == sorted(expected, key=repr), name
    last = []
    for i, t, s in expected:
        ids = library.encode(t or "", add_special_tokens=False).ids
        last.append((i, s, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=repr) == sorted(last, key=repr)
