"""Fill-in-middle against plain slices, round trips and counted units."""

import hashlib
import random
import re

import pytest

from clonespark.llm import fill_middle as M


def brute_force(rows):
    out = []
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, t in rows:
        t = t or ""
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        p, m, s = t[:a], t[a:b], t[b:]
        if not t or any(x in t for x in M.SENTINELS) or h3 % 100 >= 90:
            out.append((i, len(t), "plain", None, None, sha(t), sha(t)))
        elif h4 % 100 < 20:
            out.append((i, len(t), "spm", a, b - a, sha(f"<S>{s}<P>{p}<M>{m}"), sha(t)))
        else:
            out.append((i, len(t), "psm", a, b - a, sha(f"<P>{p}<S>{s}<M>{m}"), sha(t)))
    return out


def test_op12_equals_brute_force(spark, folder, empty, rows):
    got = M.op12_fill_in_middle(spark, folder)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_force([r[:2] for r in rows]), key=repr)
    assert {"plain", "psm", "spm"} == {r["form"] for r in got.collect()}
    assert M.op12_fill_in_middle(spark, empty).collect() == []


def test_op12_sentinels_and_long_texts(spark, tmp_path):
    """Texts with whole and torn sentinels, astral characters, separators alone, and one of 20 million letters."""
    texts = ["<P>", "a<S>", "x <M> y", "<P", "P>", "<<P>>", "<p>", "< P >", "<S<P><M", "\U0001f600" * 50 + "<", " \n\t", "é<", ">", "\x00\x00", "<P <S <M " * 30]
    texts += ["ab \U0001f600é\n" * 3_000_000]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)][: 2 * len(texts)], "doc_id long, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, M.op12_fill_in_middle(spark, str(tmp_path)).collect()))
    assert got == sorted(brute_force([(r["doc_id"], r["text"]) for r in table.collect()]))


@pytest.mark.parametrize("units", ["chars", "words"])
def test_units_and_places(units):
    """Ranks are found as a table of all units would give them."""
    rng = random.Random(3)
    scan = M.EventScan(units=units)
    for _ in range(300):
        text = "".join(rng.choice("ab é\U0001f600\n\t<PSM>") for _ in range(rng.randrange(0, 40)))
        want = list(text) if units == "chars" else re.findall(r"^[\x20\x09-\x0d]*[^\x20\x09-\x0d]+[\x20\x09-\x0d]*|[^\x20\x09-\x0d]+[\x20\x09-\x0d]*|^[\x20\x09-\x0d]+$", text)
        assert "".join(want) == text
        e = scan.events(text)
        assert e.units == len(want)
        at = 0
        for k, unit in enumerate(want):
            assert e.place(k) == at
            at += len(unit)
        assert e.place(len(want)) == e.place(len(want) + 5) == len(text)
        assert [text[i : i + 3] for i, _ in e.sentinels] == re.findall("<P>|<S>|<M>", text)


@pytest.mark.parametrize("units", ["chars", "words"])
def test_round_trip_of_other_settings(spark, docs, units):
    made = M.fill_in_middle(docs, seed="x", share=100, spm=50, sentinels=("<|a b|>", "<|c|>", "<|d|>"), units=units, keep=("doc_id", "text", "_block"))
    back = M.restore(made, ("<|a b|>", "<|c|>", "<|d|>"), keep=("doc_id", "text", "form", "_block")).collect()
    assert len(back) == docs.count() and all((r["text"] or "") == r["restored"] for r in back) and {"psm", "spm"} <= {r["form"] for r in back}
    again = M.fill_in_middle(docs.repartition(7), seed="x", share=100, spm=50, units=units)
    assert sorted(r["form"] for r in again.collect()) == sorted(r["form"] for r in back)


def test_settings_and_outputs_that_are_refused(docs):
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("<P", "P>", "<M>"), (" ", "<S>", "<M>")):
        with pytest.raises(ValueError):
            M.EventScan(bad)
    with pytest.raises(ValueError, match="units"):
        M.EventScan(units="bytes")
    with pytest.raises(ValueError, match="made"):
        M.fill_in_middle(docs.withColumnRenamed("size", "n"), keep=("n",))
    for output, form in (("<P>a<M>b<S>c", "psm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b", "psm"), ("<P>a<S>b<M>c", None)):
        with pytest.raises(ValueError, match="form"):
            M.EventScan().restored(output, form)
