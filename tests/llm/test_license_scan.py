"""License spans against brute force, changed notices and odd tables."""

import re

from clonespark.llm import license_scan as L


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    w = words(text)
    at = [(i, label) for label, phrase in L.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({k for _, k in at}))


def brute_spans(text, known):
    """Labels and best score: votes by diagonal, merged and verified one by one."""
    w, labels, best = words(text), set(), 0.0
    for x in known:
        k, lines = min(L.GRAM, len(x.words)), {}
        for t in range(len(x.words) - k + 1):
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) == x.words[t : t + k]:
                    cover, places = lines.setdefault(p - t, (set(), []))
                    cover.update(range(t, t + k))
                    places += [p, p + k]
        groups = []
        for d in sorted(lines):
            if groups and d - groups[-1][-1] <= x.slack:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            for part in [g, *([d] for d in g)]:
                places = [p for d in part for p in lines[d][1]]
                s = 2 * len(set().union(*(lines[d][0] for d in part))) / (len(x.words) + max(places) - min(places))
                if s >= (1.0 if x.whole else L.LEAST):
                    labels.add(x.label)
                    best = max(best, s)
    return ",".join(sorted(labels)), best


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
TEXTS = [
    None, "", "mit license", "MIT\nLicense, MIT-LICENSE mit_license x.mit license", "the mit  licenses", "Apache License and the General Public License; general public mit license",
    "Licensed under CC BY-NC 4.0.", "licensed under cc by nd 4.0", MIT, "x " * 50 + MIT.replace("of this", "of all of this") + " y" * 50, MIT.replace("hereby granted, free of charge,", "given"), MIT + " " + MIT.upper(),
    " ".join(MIT.split()[:14]), " ".join(reversed(MIT.split())), "mit license " * 700, "of this software and of this software and of this software", "MİT LİCENSE mit licenſe", "é mit license é", "All rights reserved. all rights, reserved", "1mit license", "mit\x7flicense\x00gpl",
    "This program is free software; you can redistribute it and or modify it, under the terms of the GNU General Public License as published by the Free Software Foundation", "released under the mit license " * 40,
]


def check(rows, table):
    known = L.templates()
    got = sorted(map(tuple, table.collect()), key=repr)
    want = []
    for i, t in rows:
        labels, score = brute_spans(t, known)
        want.append((i, *brute_base(t), labels, score))
    assert got == sorted(want, key=repr)
    return {r[0]: r for r in got}


def test_op13_equals_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[6]), (None, TEXTS[6]), (None, None), (2, "mit license"), (2, "other text"), (7, TEXTS[8])]
    table = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], "doc_id long, text string, id int, digest string, score int").repartition(3)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = check(rows, L.op13_license_scan(spark, str(tmp_path)))
    assert got[6][6] == "cc-by-nc-4.0" and got[9][6] == got[8][6] == "mit" and got[9][5] == "" and got[9][7] < 1 == got[8][7]
    assert got[13][6] == got[7][6] == got[15][6] == "" and got[14][2] == 700 and got[21][6] == "gpl"


def test_op13_on_the_tables(spark, folder, empty, rows, sf_dir):
    check([r[:2] for r in rows], L.op13_license_scan(spark, folder))
    assert L.op13_license_scan(spark, empty).collect() == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check([(r["doc_id"], r["text"]) for r in docs.collect()], L.scan_licenses(docs))


def test_op13_uses_no_python_workers(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for df in (L.spans(docs), L.scan_licenses(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_op13_long_text_and_hot_row(spark, tmp_path):
    """A text of 20 million letters, and one row that is a third of all."""
    long = "lorem ipsum dolor sit " * 900_000 + "released under the mit license " + "amet " * 50
    rows = [(1, long)] + [(5, "all of it: Released under the MIT License")] * 500 + [(i, f"text {i} gnu general public license") for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op13_license_scan(spark, str(tmp_path)).collect()
    assert len(got) == 1501 and sum(tuple(r) == (5, 8, 1, 6, 6, "mit", "mit", 1.0) for r in got) == 500
    assert [tuple(r)[1:7] for r in got if r["doc_id"] == 1 and r["n_words"] > 100] == [(3_600_055, 1, 3_600_003, 3_600_003, "mit", "mit")]


def test_op13_own_templates(spark):
    """Longer templates than a mask has bits are cut; several lengths of k-grams; bad ones are refused."""
    notice = " ".join(f"w{i}" for i in range(150))
    known = L.templates([("two", "a b"), ("many", "q r s t u")], [], [("long", notice)])
    assert [len(x.words) for x in known] == [2, 5, 50, 50, 50]
    docs = spark.createDataFrame([(1, "x a b q r s t u"), (2, " ".join(f"w{i}" for i in range(45, 101))), (3, "q r s t v u")], "doc_id long, text string")
    got = {r["doc_id"]: (r["base_labels"], r["labels"]) for r in L.scan_licenses(docs, known).collect()}
    assert got == {1: ("many,two", "many,two"), 2: ("", "long"), 3: ("", "")}
    for bad in ([("a,b", "x y")], [("a", "x")]):
        try:
            L.templates(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
