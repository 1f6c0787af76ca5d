"""The bound of the text that op3's statistics take at once."""

import numpy as np

from clonespark.llm import quality


def test_op3_statistics_take_bounded_texts(monkeypatch):
    seen, own = [], quality._statistics
    monkeypatch.setattr(quality, "_statistics", lambda data, offsets: (seen.append(len(data)), own(data, offsets))[1])
    text = np.frombuffer(b"some words of a text " * 50, np.uint8)
    got = quality.statistics(np.tile(text, 3000), np.arange(3001) * len(text))
    assert len(got) == 3000 and sum(seen) == 3000 * len(text) and max(seen) <= quality.CHUNK
