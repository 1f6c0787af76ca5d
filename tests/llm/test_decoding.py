"""The pipeline's last stage against the library's encoding and decoding."""

import numpy as np

import corpus_pipeline
from clonespark.llm import arrowtext as A
from clonespark.llm import bpe


def test_last_stage_decodes(spark, docs, rows, folder, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "OUT", 1000)  # several batches for each chunk
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for i, t, s in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, s, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    name, stage = corpus_pipeline.STAGES[-1]
    got = stage(spark, docs, folder)
    assert name == "encode" and got.columns == ["doc_id", "source", "n_tokens", "ids", "decoded"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_batches_are_bounded_and_whole(spark, docs, monkeypatch):
    """Many small batches have the rows of one."""
    plain = sorted(map(tuple, bpe.encode_texts(docs).collect()), key=repr)
    data, offsets = np.zeros(41, np.uint8), np.cumsum([0, 1, 2, 30, 0, 4, 5, 0])
    assert A.chunks(offsets, 12) == [(0, 2), (2, 3), (3, 7)]
    monkeypatch.setattr(bpe, "OUT", 100)
    assert sorted(map(tuple, bpe.encode_texts(docs).collect()), key=repr) == plain
