"""The entry point, the command line, the stream, and registered SQL at the smallest size."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clonespark import catalogue, cli
from clonespark.operators import mixture as M
from clonespark.plans import methods
from clonespark.schema import Params


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["repertoire_normalised", "class_sample", "thresholds", "crude_clusters", "full_method", "variation_of_information", "raw_to_airr", "cosine_topk", "dnds"])
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    got, want = catalogue.QUERIES[name](spark, sf_dir).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        values = df[sorted(df.columns)].itertuples(index=False)
        return sorted(tuple(round(float(v), 6) + 0.0 if isinstance(v, (float, np.floating)) else str(v) for v in r) for r in values)

    assert rows(got) == rows(want)


def test_command_line(spark, sf_dir, tmp_path):
    table = catalogue.rep(spark, sf_dir).where("ground_truth < 60")
    path = f"{tmp_path}/in.tsv"
    table.write.option("header", True).option("sep", "\t").csv(path)
    for command, name in (("crude-method", "crude_method"), ("full-method", "full_method")):
        assert cli.main([command, path, "--result-folder", f"{tmp_path}/out", "-vv", "--json"]) == 0
        out = spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/out/inferred_{name}_in.tsv")
        assert out.count() == table.count() and out.where("clone_id is null").count() == 0
    with pytest.raises(Exception, match="exists"):
        cli.main(["crude-method", path, "--result-folder", f"{tmp_path}/out"])


def test_command_line_of_pairs_and_texts(spark, sf_dir, tmp_path):
    """Light chains, the CDR3 method and the alignment-free command."""
    rows = catalogue.rep(spark, sf_dir).where("ground_truth < 200")
    write = lambda df, name: df.write.option("header", True).option("sep", "\t").csv(f"{tmp_path}/{name}")
    read = lambda name: spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/out/{name}")
    write(rows.withColumn("sequence_id", F.concat("sequence_id", F.lit("-igh"))), "h.tsv")
    write(rows.withColumn("sequence_id", F.concat("sequence_id", F.lit("-igk"))).withColumn("junction", F.reverse("junction")), "k.tsv")
    assert cli.main(["cdr3-method", f"{tmp_path}/h.tsv", "--kappa-file", f"{tmp_path}/k.tsv", "--result-folder", f"{tmp_path}/out"]) == 0
    heavy, light = read("inferred_cdr3_based_h.tsv"), read("inferred_kappa_cdr3_based_h.tsv")
    assert heavy.count() == light.count() == rows.count() and heavy.where("sequence_id not like '%-igh'").count() == light.where("sequence_id not like '%-igk'").count() == 0
    pair = heavy.select(F.regexp_replace("sequence_id", "-igh$", "").alias("s"), "clone_id").exceptAll(light.select(F.regexp_replace("sequence_id", "-igk$", ""), "clone_id"))
    assert pair.count() == 0 and heavy.where("clone_id is null").count() == 0
    texts = [(f"s{i}", "ACGTTGCA" * 20 + ("ACGT", "TTTT")[i % 2] * 10) for i in range(6)] + [("t", "GATTACAC" * 25)]
    write(spark.createDataFrame(texts, "sequence_id string, sequence string"), "a.tsv")
    write(spark.createDataFrame([(f"n{i}", "CCATGGAT" * i + "AACCGGTT" * 20) for i in range(5)], "sequence_id string, sequence string"), "n.tsv")
    assert cli.main(["alignment-free", f"{tmp_path}/a.tsv", f"{tmp_path}/n.tsv", "--result-folder", f"{tmp_path}/out", "--greedy"]) == 0
    got = {r["sequence_id"]: r["clone_id"] for r in read("inferred_alignment_free_a.tsv").collect()}
    assert len(got) == 7 and got["s0"] == got["s2"] == got["s4"] and got["t"] == "t"


def test_lengths_without_a_null_model_are_refused(spark, sf_dir):
    rows = catalogue.rep(spark, sf_dir).where("ground_truth < 100")
    with pytest.raises(ValueError, match="null model"):
        methods.cdr3(rows, null=M.default_null(spark, range(12, 30, 3)))


def test_params_and_constants(spark, sf_dir):
    out = methods.full(catalogue.rep(spark, sf_dir).where("ground_truth < 50"), params=Params(precision=0.99, xy_constant=-1e9))
    assert out.output.where(F.col("clone_id").isNull()).count() == 0


def test_numbers_in_order(spark):
    from clonespark.operators.numbering import dense_numbers, numbered

    rows = spark.range(0, 1000, numPartitions=7).selectExpr("id", "pmod(xxhash64(id), 50) k")
    got = numbered(rows, ["k", "id"]).collect()
    assert [r["number"] for r in sorted(got, key=lambda r: (r["k"], r["id"]))] == list(range(1, 1001))
    dense = dense_numbers(rows, ["k"], start=0).collect()
    place = {k: i for i, k in enumerate(sorted({r["k"] for r in dense}))}
    assert all(r["number"] == place[r["k"]] for r in dense)
    assert numbered(rows.limit(0), ["id"]).count() == 0


def test_ids_of_equal_rows_differ(spark):
    from clonespark.operators.classes import with_sequence_id

    rows = spark.createDataFrame([("a", 1)] * 3 + [("b", 2)], "x string, y int")
    assert len({r["sequence_id"] for r in with_sequence_id(rows).collect()}) == 4


def test_grouped_functions_and_aligned_models(spark):
    from clonespark.operators import compare as Q

    rows = spark.createDataFrame([(1, "a", 2.0), (2, "a", 4.0), (3, "b", None)], "id long, k string, value double")
    assert sorted(map(tuple, Q.apply_groups(rows, ["k"], lambda p: p.assign(n=len(p))[["id", "n"]], "id long, n long").collect())) == [(1, 2), (2, 2), (3, 1)]
    assert sorted(map(tuple, Q.mean_over(rows, ["k"]).collect())) == [("a", 3.0, 2), ("b", None, 0)]
    models = {"one": rows.selectExpr("id", "k clone_id"), "two": rows.where("id < 3").selectExpr("id", "id clone_id")}
    assert sorted(map(tuple, Q.align_models(rows.select("id"), models, "id").collect())) == [(1, "a", 1), (2, "a", 2), (3, "b", None)]


@pytest.mark.parametrize("t", [1, 3, 5, 8, 14])
def test_linkage_finds_every_link(spark, t):
    """Whole parts, parts with a letter left out, and the class as a whole."""
    from clonespark.operators.linkage import links

    rng = np.random.default_rng(t)
    base = rng.integers(0, 4, (12, 15))
    texts = {"".join("ACGT"[c] for c in np.where(rng.random(15) < 0.25, rng.integers(0, 4, 15), base[k % 12])) for k in range(150)}
    order = sorted(texts)
    nodes = spark.createDataFrame([(i, 0, x, t) for i, x in enumerate(order)], "node long, within long, text string, t int")
    got = {(order[r["src"]], order[r["dst"]]) for r in links(nodes, 1).collect()}
    assert got == {(a, b) for a in texts for b in texts if a < b and sum(x != y for x, y in zip(a, b)) <= t}


def test_components_within_groups(spark):
    from clonespark.operators.components import connected_components

    edges = spark.createDataFrame([(f"{g}{i}", f"{g}{i + 1}", g) for g in "abc" for i in range(10, 40) if i % 7] + [("a10", "a10", "a")], "x string, y string, `group` string").repartition(5)
    got, plain = (sorted(map(tuple, connected_components(edges if w else edges.select("x", "y"), within=w).collect())) for w in ("group", None))
    assert got == plain and len(got) > 80
