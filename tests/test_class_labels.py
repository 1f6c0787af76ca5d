"""Classes that are clustered and labelled in one task, against those whose CDR3s are linked by joins."""

import numpy as np
import pytest

from clonespark.operators import linkage as L
from clonespark.operators import pieces as P
from clonespark.plans import methods

SCHEMA = "sequence_id string, v_gene string, j_gene string, cdr3_length int, cdr3 string"


def _rows(count: int = 120) -> list[tuple]:
    rng = np.random.default_rng(5)
    texts = ["".join("ACGT"[k] for k in rng.integers(0, 4, 12)) for _ in range(12)]
    out = []
    for i in range(count):
        text = list(texts[rng.integers(0, 12)])
        text[rng.integers(0, 12)] = "A"
        out.append((f"s{rng.permutation(9)[0]}{i}", "V", f"J{i % 5}", 12, "".join(text)))
    return out


@pytest.mark.parametrize("inclusive", [True, False])
def test_small_classes_need_no_numbers(spark, monkeypatch, inclusive):
    """Rows of small classes are labelled in their class's task: nothing is numbered over the table. Thresholds may be null, negative, zero, or lacking."""
    records = spark.createDataFrame(_rows(), SCHEMA)
    limits = [("V", "J0", 12, 2, 4), ("V", "J1", 12, 0, 3), ("V", "J2", 12, -1, 2), ("V", "J3", 12, None, 1)]
    thresholds = spark.createDataFrame(limits, "v_gene string, j_gene string, cdr3_length int, t int, u int")
    names = {"a": "t", "b": "u"}
    want = sorted(map(tuple, L._joined(records, thresholds, names, inclusive).collect()), key=str) if hasattr(L, "_joined") else None

    def fails(*_):
        raise AssertionError("numbered")

    monkeypatch.setattr(L, "numbered", fails)
    monkeypatch.setattr(P, "LOCAL", 7)  # classes come in several batches of rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = sorted(map(tuple, L.clusters(records, thresholds, names, inclusive).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len({r[-1] for r in got}) > 10


def test_crude_method_counts_no_mutations(spark, monkeypatch):
    """The crude and CDR3 methods read no alignments: nothing that they store has them but the input itself."""
    tables, own = [], methods.stored
    monkeypatch.setattr(methods, "stored", lambda df, name: (tables.append(df.columns), own(df, name))[1])
    rows = [(*r, "ACGT", "ACGA") for r in _rows(40)]
    df = spark.createDataFrame(rows, SCHEMA + ", alt_sequence_alignment string, alt_germline_alignment string")
    found = methods.crude(df)
    assert not any("mutation_count" in c or "alt_sequence_alignment" in c for c in tables)
    assert found.records.where("mutation_count = 1 and crude_method_family is not null").count() == 40 == found.output.where("clone_id is not null").count()
