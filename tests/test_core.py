"""Operators against plain Python, and the edge cases of the methods."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonespark.functions import sequences as S
from clonespark.functions.offsets import offset_distance, sift4
from clonespark.operators import classes as C
from clonespark.operators import evaluate as E
from clonespark.operators import linkage as L
from clonespark.operators import mixture as M
from clonespark.operators import mutations as X
from clonespark.operators import textclone as T
from clonespark.operators.components import connected_components
from clonespark.plans import methods
from clonespark.schema import Params
from clonespark.sources import repertoire as R


def distance(a, b):
    return sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))


def components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


# -- expressions -----------------------------------------------------------------------------------


def test_hamming_packed_and_by_letter(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("ACGTN.") for _ in range(n)), "".join(rng.choice("ACGTN.") for _ in range(n))) for n in (1, 15, 16, 40)]
    pairs += [("ACGT", "ACG"), ("", ""), ("", "AC"), ("acgx", "acgy"), ("ACGTX", "ACGTY"), (None, "A")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", S.hamming(F.col("a"), F.col("b"), S.word_count(df, "a", "b")).alias("d")).collect()
    assert all(r["d"] == (None if r["a"] is None else distance(r["a"], r["b"])) for r in got)


def test_small_expressions(spark):
    one = lambda value, column: spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]
    assert one("IGHV1-2*03", S.gene("x")) == "IGHV1-2" and one("IGHV1-2", S.gene("x")) == "IGHV1-2"
    assert one("TGTACGTGG", S.cdr3("x")) == "ACG" and one("TGTA", S.cdr3("x")) == ""
    assert one("high-7-igh", S.clean_id("x")) == "high-7" and one("high-7-igh", S.strip_letters("x")) == "7"
    assert one("abc,-./def", S.ngrams(F.col("x"))) == ["abcde", "bcdef"] and one("abc", S.ngrams(F.col("x"))) == []
    assert one("abcdefgh", S.tail(F.col("x"), 3)) == "fgh" and one("abcdefgh", S.tail(F.col("x"), 3, 2)) == "def" and one("ab", S.tail(F.col("x"), 3)) == "ab"
    assert one("abcdefghij", S.wrapped_tail(F.col("x"), 15)) == "abcdefghij"[10 - 15 :] and one("abcdef", S.head(F.col("x"), 2, 1)) == "bc"
    assert one("ATGTAAGCN", S.translated(F.col("x"))) == "M*X"
    assert math.isclose(one("0.2", S.inverse_logit10(S.logit10(F.col("x").cast("double")))), 0.2)
    assert spark.range(1).select(S.padded(F.array(F.lit(1)), 3).alias("y")).first()["y"] == [1, None, None]


def test_offset_distance():
    """Values of the published algorithm (fixed values), look-ahead 5 and 2."""
    assert [offset_distance(a, b) for a, b in (("", "abc"), ("abc", "abc"), ("abc", "abd"), ("abcdef", "bcdef"), ("ab", "ba"))] == [3, 0, 1, 1, 1]
    table = {
        ("", ""): (0, 0), ("abc", ""): (3, 3), ("abcd", "abdc"): (1, 1), ("abcdef", "fabcde"): (1, 1), ("ACGTACGT", "CGTACGTA"): (1, 1), ("kitten", "sitting"): (3, 3),
        ("sunday", "saturday"): (3, 7), ("aaaa", "aaaab"): (1, 1), ("TTGACCA", "TGACCAT"): (1, 1), ("GATTACA", "GCATGCU"): (3, 3),
    }
    for (a, b), (five, two) in table.items():
        assert (offset_distance(a, b), offset_distance(a, b, 2)) == (five, two)
    first, second = zip(*table, strict=True)
    assert sift4([*first] * 3, [*second] * 3).tolist() == [five for five, _ in table.values()] * 3  # together as by themselves


# -- classes and fits ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def repertoire(spark):
    rng, rows = random.Random(4), []
    for family in range(12):
        v, j, n = f"V{family % 2}*01", "J1*02", 15 + 3 * (family % 3)
        naive = "".join(rng.choice("ACGT") for _ in range(n))
        germ = "".join(rng.choice("ACGT") for _ in range(90))
        for k in range(rng.randrange(1, 12)):
            change = lambda s, m: "".join(c if i not in m else "ACGT"["ACGT".index(c) - 1] for i, c in enumerate(s))
            seq = change(germ, set(rng.sample(range(90), rng.randrange(0, 6))))
            cdr3 = change(naive, set(rng.sample(range(n), rng.randrange(0, 3))))
            rows.append((f"{family}_{k}", v, j, "TGT" + cdr3 + "TGG", seq[:60], seq[60:], germ[:60], germ[60:], family))
    rows += [("null", "V0*01", "J1*02", None, "A", "C", "A", "C", 0), ("long", "V0*01", "J1", "TGT" + "A" * 100 + "TGG", "A" * 60, "C" * 30, "A" * 60, "C" * 30, 99)]
    rows.append(rows[0])  # a repeated row
    schema = ", ".join(f"{c} string" for c in ("sequence_id", "v_call", "j_call", "junction", "v_sequence_alignment", "j_sequence_alignment", "v_germline_alignment", "j_germline_alignment")) + ", ground_truth int"
    return spark.createDataFrame(rows, schema).cache()


def test_normalise(repertoire):
    got = C.normalise(repertoire, keep=("ground_truth",)).collect()
    assert len(got) == repertoire.count() - 1 and all(r["mutation_count"] == distance(r["alt_sequence_alignment"], r["alt_germline_alignment"]) and r["cdr3_length"] == len(r["cdr3"]) for r in got)


def test_classes_and_histogram(repertoire):
    rows = C.normalise(repertoire)
    classes = C.create_classes(rows)
    by = {}
    for r in rows.collect():
        by.setdefault((r["v_gene"], r["j_gene"], r["cdr3_length"]), []).append(r["cdr3"])
    got = {(r["v_gene"], r["j_gene"], r["cdr3_length"]): r for r in classes.where("v_gene <> 'None'").collect()}
    assert {k: (r["sequence_count"], r["pair_count"]) for k, r in got.items()} == {k: (len(v), len(v) * (len(v) - 1) // 2) for k, v in by.items()}
    histogram = {(r["class_id"], r["d"]): r["n"] for r in C.distance_histogram(C.class_sample(rows, classes)).collect()}
    want = {}
    for k, texts in by.items():
        if k[2] <= 81 and k[2] % 3 == 0:
            for i, a in enumerate(texts):
                for b in texts[:i]:
                    at = got[k]["class_id"], distance(a, b)
                    want[at] = want.get(at, 0) + 1
    assert histogram == want
    ids = sorted((r["class_id"], -r["sequence_count"]) for r in classes.collect())
    assert [i for i, _ in ids] == list(range(1, len(ids) + 1)) and [n for _, n in ids] == sorted(n for _, n in ids)


def test_fits_equal_numpy(spark):
    n, h = 15, np.array([40, 30, 12, 5, 1, 0, 2, 5, 9, 20, 40, 60, 50, 20, 9, 1], float)
    bins = M.binned(spark.createDataFrame([(1, n, d, int(k)) for d, k in enumerate(h) if k], "class_id int, cdr3_length int, d int, n long"), M.default_null(spark))
    got = M.fit_classes(bins).first()
    p0 = np.array([math.comb(n, d) * 3**d / 4**n for d in range(n + 1)])
    b = np.arange(n + 1)
    for kind, rho_name, mu_name in (("geo", "rho_geo", "mu_geo"), ("poi", "rho_poisson", "mu_poisson")):
        mu = 0.02 * n
        rho = max(min(h[0] / h.sum() * (1 + mu), 1), 0.1)
        for _ in range(10):
            p1 = rho / (mu + 1) * (mu / (mu + 1)) ** b if kind == "geo" else rho * mu**b * np.exp(-mu) / np.array([math.factorial(i) for i in b])
            q = (1 - rho) * p0
            s1, s0 = (h * p1 / (p1 + q + 1e-5)).sum(), (h * q / (p1 + q + 1e-5)).sum()
            rho, mu = min(s1 / (s1 + s0 + 1e-5), 1), (b * h * p1 / (p1 + q + 1e-5)).sum() / (s1 + 1e-5)
        assert math.isclose(got[rho_name], rho, rel_tol=1e-9) and math.isclose(got[mu_name], mu, rel_tol=1e-9)


def test_thresholds_of_odd_lengths(spark):
    classes = spark.createDataFrame([("V", "J", n, 5, 10, n, 0.2, 0.04) for n in (12, 16, 84, 15, 81)], "v_gene string, j_gene string, cdr3_length int, sequence_count long, pair_count long, class_id int, effective_prevalence double, effective_mean_distance double")
    got = {r["cdr3_length"]: (r["precise_threshold"], r["sensitive_threshold"]) for r in M.with_thresholds(classes, M.default_null(spark), Params(precision=0.99)).collect()}
    assert got[12] == (2, 2) and got[16] == (3, 3) and got[84] == (16, 16) and got[81][0] <= got[81][1] and got[15][1] >= 0


# -- linkage ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("t", [-1, 0, 1, 3, 7, 20])
def test_clusters_equal_all_pairs(spark, t):
    rng = random.Random(t)
    base = ["".join(rng.choice("ACGT") for _ in range(18)) for _ in range(6)]
    texts = ["".join(c if rng.random() > 0.15 else rng.choice("ACGT") for c in rng.choice(base)) for _ in range(60)] + [base[0]] * 3
    rows = [(f"s{i:03d}", "V", "J", 18, x) for i, x in enumerate(texts)]
    records = spark.createDataFrame(rows, "sequence_id string, v_gene string, j_gene string, cdr3_length int, cdr3 string")
    thresholds = spark.createDataFrame([("V", "J", 18, t)], "v_gene string, j_gene string, cdr3_length int, t int")
    got = {r["sequence_id"]: r["c"] for r in L.clusters(records, thresholds, {"c": "t"}).collect()}
    edges = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[:i] if t >= 0 and distance(a[4], b[4]) <= t]
    assert got == components([r[0] for r in rows], edges)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (7, None)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    real = [e for e in edges if e[1] is not None and e[0] != e[1]]
    assert got == components({n for e in real for n in e}, real)
    assert connected_components(df.limit(0)).count() == 0


# -- methods ---------------------------------------------------------------------------------------


def test_methods_refine_each_other(repertoire):
    found = methods.full(repertoire, params=Params(precision=0.99))
    rows = found.records.collect()
    assert found.output.count() == repertoire.count()
    assert {r["sequence_id"] for r in found.output.where("clone_id is null").collect()} == {"null"}
    for fine, coarse in (("precise_cluster", "clone_id"), ("clone_id", "sensitive_cluster")):
        seen = {}
        for r in rows:
            assert seen.setdefault((r["v_gene"], r["cdr3_length"], r[fine]), r[coarse]) == r[coarse]


def test_full_method_merges_by_mutations(spark):
    """Two precise clusters with many shared mutations merge; one without shared mutations does not."""
    rows = [("a", "V", "J", 30, "A" * 30, 20, "p1", "s"), ("b", "V", "J", 30, "A" * 26 + "CCCC", 20, "p2", "s"), ("c", "V", "J", 30, "C" * 30, 20, "p3", "s"), ("d", "V", "J", 30, "A" * 24 + "CCCCCC", 0, "p4", "s")]
    germ = "A" * 100
    alt = {"a": "C" * 20 + germ[20:], "b": "C" * 20 + germ[20:], "c": germ[:80] + "C" * 20, "d": germ}
    records = spark.createDataFrame([(*r, alt[r[0]]) for r in rows], "sequence_id string, v_gene string, j_gene string, cdr3_length int, cdr3 string, mutation_count int, precise_cluster string, sensitive_cluster string, alt_sequence_alignment string")
    classes = spark.createDataFrame([("V", "J", 30, 6, 1, 5, 0.0)], "v_gene string, j_gene string, cdr3_length int, pair_count long, precise_threshold int, sensitive_threshold int, xy_threshold double")
    got = {r["sequence_id"]: r["clone_id"] for r in X.merge_clusters(records, classes).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_pairs_of_a_large_cluster_are_dealt_out(spark, monkeypatch):
    """Every pair of different precise clusters once, whatever the number of tasks that a sensitive cluster is dealt to."""
    rng = random.Random(3)
    rows = [(f"s{i:02d}", "V", "J", 12, "".join(rng.choice("ACGT") for _ in range(12)), 1 + i % 5, f"p{i % 7}", "s" if i % 10 else "other", "".join(rng.choice("ACGT") for _ in range(40))) for i in range(60)]
    table = spark.createDataFrame(rows, "sequence_id string, v_gene string, j_gene string, cdr3_length int, cdr3 string, mutation_count int, precise_cluster string, sensitive_cluster string, alt_sequence_alignment string")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[7] == b[7] and a[6] < b[6])
    for each in (4096, 7):
        monkeypatch.setattr(X, "EACH", each)
        assert sorted((r["a"], r["b"]) for r in X.cross_pairs(table, 40).collect()) == want


def test_xy_threshold_exact_and_drawn_agree():
    m, k = np.array([1.0, 2, 5, 9]), np.array([5.0, 3, 2, 1])
    p0 = np.array([math.comb(15, d) * 3**d / 4**15 for d in range(16)])
    exact = X.exact_threshold(m, k, p0, 15, 300, 0.01, 1_000_000)
    drawn = X.drawn_threshold(m, k, p0, 15, 300, 0.01, 400_000, seed=1)
    assert abs(exact - drawn) < 0.05


def test_paired_and_crude(repertoire):
    light = repertoire.withColumn("junction", F.concat(F.lit("TGTACGACGACGACGACGACGACGACGACGACGACGACGACGACGACG"), F.lit("TGG"))).dropDuplicates(["sequence_id"])
    heavy = repertoire.dropDuplicates(["sequence_id"])
    out = methods.crude(heavy, light=light).output
    assert out.count() == heavy.count() and out.where("clone_id is not null").count() == heavy.count() - 1


def test_scores(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, None), (3, "c")]
    df = spark.createDataFrame(rows, "ground_truth int, p string")
    got = E.pair_scores(df, "p").first()
    assert (got["precision"], got["sensitivity"]) == (0.5, 0.25)
    alone = df.withColumn("p", F.monotonically_increasing_id())
    assert tuple(E.pair_scores(alone, "p").first()) == (1.0, 0.0)
    assert tuple(E.pair_scores(df.drop("ground_truth"), "p").first()) == (None, None)
    same = E.variation_of_information(df.withColumn("p", F.col("ground_truth")), "p").first()[0]
    assert abs(same) < 1e-12 and E.entropy(df, "ground_truth").first()[0] < 0


# -- texts -----------------------------------------------------------------------------------------


def test_cosine_matches_equal_all_pairs(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcd ") for _ in range(60)) for _ in range(5)]
    texts = [(i, "".join(c if rng.random() > 0.08 else rng.choice("abcd") for c in rng.choice(base))) for i in range(40)] + [(98, ""), (99, "ab")]
    w = T.weights(T.tokens(spark.createDataFrame(texts, "id long, text string")))
    table = {}
    for r in w.collect():
        table.setdefault(r["id"], {})[r["gram"]] = r["w"]
    want = {(i, j): sum(x * table[j].get(g, 0) for g, x in table[i].items()) for i in table for j in table}
    got = {(r["i"], r["j"]): r["sim"] for r in T.cosine_matches(w).collect()}
    assert set(got) == {k for k, v in want.items() if v > 0.5} and all(math.isclose(v, want[k], rel_tol=1e-9) for k, v in got.items())


def test_greedy_labels_follow_the_order(spark):
    rng = random.Random(6)
    pairs = {(i, i): 1.0 for i in range(30)}
    for _ in range(30):
        i, j = rng.randrange(30), rng.randrange(30)
        pairs[i, j] = pairs[j, i] = 0.9
    label, n = {i: ("own", i) for i in range(30)}, 0
    for i in range(30):
        js = sorted(j for a, j in pairs if a == i)
        if len(js) > 1:
            known = [j for j in js if label[j][0] == "new"]
            if known:
                value = label[known[0]]
            else:
                value, n = ("new", n), n + 1
            for j in js:
                label[j] = value
    matches = spark.createDataFrame([(i, j, s) for (i, j), s in pairs.items()], "i long, j long, sim double")
    got = {r["id"]: r["cluster"] for r in T.greedy_clusters(matches, spark.range(30), 0.3).collect()}
    least = {}
    for i in range(30):
        least.setdefault(label[i], i)
    assert got == {i: least[label[i]] for i in range(30)}


def test_cross_group_distances(spark):
    """The offset distance by default, clones of one group, nulls, and a clone that is dealt out."""
    rng = random.Random(2)
    rows = [(i % 4, "ab"[i % 3 > 0] if i % 4 else "a", "".join(rng.choice("ACGT") for _ in range(9))) for i in range(80)] + [(1, None, "A"), (None, "a", "A"), (2, "a", None)]
    table = spark.createDataFrame(rows, "clone int, grp string, cdr string")
    want = {}
    for c, g, x in rows:
        for d, h, y in rows:
            if None not in (c, g, x, d, h, y) and c == d and g < h:
                want[c] = min(want.get(c, 9), 2 * sum(p != q for p, q in zip(x, y)) / 18)
    for each in (4096, 5):
        got = {r["clone"]: r["nearest"] for r in T.cross_group_distances(table, "clone", "grp", "cdr", S.letter_distance, each).collect()}
        assert got.keys() == want.keys() == {1, 2, 3} and all(math.isclose(v, want[k]) for k, v in got.items())
    near = T.cross_group_distances(spark.createDataFrame([(1, "a", "ACGTACGT"), (1, "b", "ACGTACGT")], "clone int, grp string, cdr string"), "clone", "grp", "cdr")
    assert near.collect()[0][1] == 0.0


def plain_greedy(lists):
    """Labels handed on one text after the other: {id: cluster} of {id: its matches}."""
    label, members = {}, {}
    for i in sorted(lists):
        if len(lists[i]) > 1:
            known = next((label[j] for j in sorted(lists[i]) if j in label), i)
            label.update(dict.fromkeys(lists[i], known))
    for j, k in label.items():
        members.setdefault(k, []).append(j)
    return {j: min(members[label[j]]) if j in label else j for j in lists}


def test_greedy_labels_in_one_large_component(spark):
    """2,000 texts that all hang together, with a hub that a third of them match, and a threshold for each text."""
    rng = random.Random(8)
    sims = {(i, i): 1.0 for i in range(2000)}
    for i in range(2000):
        for j in {i // 2, rng.randrange(2000), 77 if i % 3 == 0 else i}:
            sims[i, j] = sims[j, i] = max(0.6, 1 - abs(i - j) % 40 / 100)
    table = spark.createDataFrame([(i, j, s) for (i, j), s in sims.items()], "i long, j long, sim double").repartition(5)
    own = {i: 0.1 + 0.1 * (i % 4) for i in range(2001)}
    ids = spark.createDataFrame(list(own.items()), "id long, t double")
    for threshold, limit in (("t", own), (0.35, dict.fromkeys(own, 0.35))):
        lists = {i: set() for i in own}
        for (i, j), s in sims.items():
            if s > 1 - limit[i]:
                lists[i].add(j)
        got = {r["id"]: r["cluster"] for r in T.greedy_clusters(table, ids, threshold).collect()}
        assert got == plain_greedy(lists) and len(set(got.values())) < 1900
    far = table.select("i", "j", (1 - F.col("sim")).alias("distance"))
    lists = {i: {j for a, j in sims if a == i and 1 - sims[a, j] < 0.2} for i in own}
    assert {r["id"]: r["cluster"] for r in T.greedy_by_distance(far, ids, 0.2).collect()} == plain_greedy(lists)


def test_alignment_free_pipeline(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("ACGT") for _ in range(170)) for _ in range(4)]
    reads = spark.createDataFrame([(i, b[:k] + "T" + b[k + 1 :]) for i, (b, k) in enumerate((b, k) for b in base for k in (30, 90, 140))], "id long, text string")
    strangers = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(170)),) for _ in range(20)], "text string")
    got = {r["id"]: r["cluster"] for r in T.alignment_free(reads, strangers).collect()}
    assert got == {i: i // 3 * 3 for i in range(12)}


# -- sources and sinks -----------------------------------------------------------------------------


def test_round_trips(spark, repertoire, tmp_path):
    for suffix in (".tsv", ".csv", ".csv.gz", ".tsv.gz", ".parquet"):
        path = f"{tmp_path}/x{suffix}"
        R.write_result(repertoire.select("sequence_id", "junction"), path)
        back = R.read_repertoire(spark, path, {"junction": "cdr3"})
        assert back.columns == ["sequence_id", "junction", "cdr3"] and sorted(map(str, back.collect())) == sorted(map(str, repertoire.selectExpr("sequence_id", "junction", "junction as cdr3").collect()))
    with pytest.raises(ValueError):
        R.read_repertoire(spark, "x.json")
    with pytest.raises(Exception, match="exists"):
        R.write_result(repertoire, f"{tmp_path}/x.csv")


def test_tables_of_other_kinds(spark, tmp_path):
    (tmp_path / "g.fasta").write_text(">M1|IGHV1*01|Homo\nacg...t\nacg\n>M2|IGHV2*01|Homo\nttt\n")
    assert sorted(map(tuple, R.read_fasta(spark, f"{tmp_path}/g.fasta").collect())) == [("IGHV1*01", "acg...tacg"), ("IGHV2*01", "ttt")]
    (tmp_path / "n.csv").write_text("l,0,1,2\n2,0.1,0.5,1.0\n")
    assert tuple(R.read_null_model(spark, f"{tmp_path}/n.csv").first()) == (2, [0.1, 0.5, 1.0])
    (tmp_path / "p.json").write_text('{"partition": [["a", "b"], ["c"]]}\n')
    assert sorted(map(tuple, R.read_partitions(spark, f"{tmp_path}/p.json").collect())) == [("a", 0), ("b", 0), ("c", 1)]
    (tmp_path / "t.json").write_text('{"m": {"100": [1.5, 2.0]}}')
    assert sorted(map(tuple, R.read_times(spark, f"{tmp_path}/t.json").collect())) == [("m", 100.0, 1.5), ("m", 100.0, 2.0)]
    R.write_fasta(spark.createDataFrame([("a", "ACG")], "sequence_id string, sequence string"), f"{tmp_path}/o.fasta")
    assert spark.read.text(f"{tmp_path}/o.fasta").count() == 2
    assert R.result_path("d/in.tsv", "full") == "d/clone_results/inferred_full_method_in.tsv"
