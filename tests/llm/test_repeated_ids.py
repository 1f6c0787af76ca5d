"""Near copies where an id repeats with different texts."""

import corpus_pipeline
import pytest
from clonespark.llm import simhash


def _text(k: int) -> str:
    return " ".join(f"w{k}x{i * k % 97}" for i in range(60))


@pytest.fixture(scope="module")
def repeated(spark):
    rows = [(3, _text(3), "of 3"), (9, _text(4), "clean"), (9, _text(5), "clean too"), (9, _text(4), "clean"), (12, _text(5), "copy of 9")]
    # ids whose first text is their own and whose second is a near copy of 3, so that either order of hashes occurs
    rows += [r for i in range(20, 30) for r in ((i, _text(i), f"own of {i}"), (i, _text(3), "copy of 3"))]
    return spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(3).cache()


OWN = [(3, "of 3"), *((i, f"own of {i}") for i in range(20, 30))]


def test_each_component_keeps_its_own_row(spark, repeated):
    got = corpus_pipeline.near_dedup(spark, repeated, "")
    assert got.columns == repeated.columns
    assert sorted((r["doc_id"], r["note"]) for r in got.collect()) == sorted([*OWN, (9, "clean"), (9, "clean too")])


def test_rows_without_an_id_are_copies_too(spark):
    rows = [(None, _text(3), "a"), (None, _text(3), "b"), (5, _text(3), "of 5"), (None, _text(6), "x"), (None, _text(6) + "\n", "y"), (None, None, "none"), (None, "", "none")]
    got = [tuple(r) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, note string")).collect()]
    assert len(got) == 3 and (5, _text(3), "of 5") in got and sorted(r[2] in "xy" for r in got) == [False, False, True]
