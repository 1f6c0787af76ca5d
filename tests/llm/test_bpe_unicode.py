"""Ids against the library for every code point, and the pieces of the encoder by themselves."""

import random

import numpy as np
import pytest

from clonespark.llm import arrowtext as A
from clonespark.llm import bpe


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    return Tokenizer.from_file(path), bpe.codec(open(path, encoding="utf-8").read())


@pytest.mark.parametrize("shape", ["a{}b", "{}'s{}", "1{}̣́"])
def test_every_code_point(both, shape):
    library, codec = both
    texts = []
    for start in range(0, 0x110000, 2048):
        if not 0xD800 <= start < 0xE000:
            texts.append(" ".join(shape.replace("{}", chr(c)) for c in range(start, start + 2048)))
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, first = codec.encode_texts(np.frombuffer(data, np.uint8), offsets)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [ids[i:j].tolist() for i, j in zip(first[:-1], first[1:])] == [w.ids for w in want]


def test_long_pieces_and_special_tokens(both):
    library, codec = both
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdeé") for _ in range(n)) for n in (63, 64, 65, 200, 5000)]
    texts += ["x<|endoftext|>y<|startoftext|>'s", "<|endoftext|><|endoftext|>", "<|endoftext|", "don't we'll o'clock ''s 'S İ's", " ", "\x85a b", "9" * 300, "!" * 300]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids and codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_a_text_of_megabytes(both):
    library, codec = both
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randrange(1, 9))) for _ in range(300_000)) + " " + "w" * 300_000
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_keep_may_not_clash(docs):
    with pytest.raises(ValueError):
        bpe.encode_texts(docs.withColumnRenamed("lang", "ids"), keep=("doc_id", "ids"))


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(A, "hash_spans", lambda data, starts, ends, seed=0: (ends - starts).astype(np.uint64))
    data = np.frombuffer(b"ab cd ab abcdefghij abcdefghik abcdefghij", np.uint8)
    words = A.split_words(data, np.array([0, len(data)]))
    example, which = A.distinct_spans(words.data, words.starts, words.ends)
    raw = data.tobytes().split()
    assert [raw[i] for i in example[which]] == raw and len(example) == 4
