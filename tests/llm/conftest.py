import random

import pytest


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, source) with nulls, empty and long texts, exact and near copies, repeated rows and shared passages."""
    rng = random.Random(11)
    out = [(i, words(rng, rng.randrange(1, 120)), f"s{rng.randrange(3)}") for i in range(60)]
    passage = words(rng, 60)
    out += [(100 + i, f"{words(rng, 20)}\n{passage}\t{words(rng, 5)}", "s0") for i in range(6)]
    out += [(200, out[3][1], "s1"), (201, out[3][1].upper(), None), (202, out[4][1] + " x", "s2")]
    out += [(300, None, "s0"), (301, "", None), (302, " \n\t ", "s1"), (303, "one", "s1"), (304, "a b c", "s1"), (None, "no id here at all", "s2"), (None, None, None)]
    out += [(400, words(rng, 5000), "s0"), (401, "w" * 9000 + " end", "s0"), (7, out[7][1], out[7][2]), (8, "another text of an id", "s1")]
    out += [(500, "nbsp and　wide <|endoftext|> ΣΑΣ İ \U0001f600 á", "s2"), (501, "!!! ??? ...", "s2"), (502, "x " * 3000, "s0")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as documents, dealt over partitions, with further columns of awkward names."""
    table = [(i, t, s, "en", len(t or ""), "n", 1, 2.0, "r", -5) for i, t, s in rows]
    schema = "doc_id long, text string, source string, lang string, n_chars long, `_block` string, n_words int, score double, `_rank` string, size int"
    return spark.createDataFrame(table, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """A folder of tables as the queries read them: the documents, and others that are empty or awkward."""
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(0, None, 0), (None, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="session")
def empty(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    docs.limit(0).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)
