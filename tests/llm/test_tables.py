"""Archives, searches and the pipeline."""

import hashlib
import io
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from clonespark.llm import ann, exact_search, warc_zip


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)) * 0.2
    x[10] = x[20] = x[50]
    x[60] = 0
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(0, x[0].tolist(), "again"), (None, x[1].tolist(), "no id"), (1000, None, "null"), (1050, [1.0, None] + [0.0] * 6, "null in it"), (1100, [float("nan")] * 8, "nan"), (1150, [float("inf")] * 8, "inf"), (1200, [0.5, 0.5], "short")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3).cache()


def usable(vectors, zero):
    out = {}
    for r in vectors.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v is not None and None not in v and np.isfinite(v).all() and (zero or any(v)):
            out[r["vec_id"]] = np.array(v, float)
    return out


def test_op6_equals_brute_force(vectors):
    got = exact_search.largest_products(vectors, "pmod(vec_id, 50) = 0", 5, scale=256.0).collect()
    table = {i: np.floor(256 * v) for i, v in usable(vectors, True).items()}
    want = []
    for q in (i for i in table if i % 50 == 0):
        found = sorted((-float(table[q] @ v), i) for i, v in table.items() if i != q and len(v) == len(table[q]))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_op6_whole_numbers_beyond_doubles(spark):
    big = 1 << 30
    rows = [(50, [big, 1]), (1, [big, 1]), (2, [big, 2]), (3, [big, 0]), (4, [-big, 5])]
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = exact_search.largest_products(table, "vec_id = 50", 4, scale=1.0).collect()
    want = sorted(((-(big * v[0] + v[1]), i) for i, v in rows if i != 50))
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, -s) for s, i in want]
    far = spark.createDataFrame([(50, [1e200, 1.0]), (1, [1e200, 1.0]), (2, [-1e200, 0.0]), (3, [1e308, 1e308])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in sorted(exact_search.largest_products(far, "vec_id = 50", 4, scale=256.0).collect(), key=lambda r: r["rank"])] == [(50, 1, 1, (1 << 63) - 1), (50, 2, 2, -(1 << 63) + 1)]


@pytest.mark.parametrize(("kind", "share"), [("clusters", 0.02), ("structureless", 0.2)])
def test_op6_stops_early_and_stays_exact(kind, share):
    """Most products are never evaluated, among clusters and among vectors without structure, and the results are those of all products."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(18_000, 64))
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(60, 64)), 300, 0) + 0.1 * x
    x = np.floor(256 * x / np.sqrt((x**2).sum(1, keepdims=True)))
    x[5:15] = x[5]
    index = exact_search.Index(np.arange(len(x)), np.zeros(len(x), np.uint64), x, exact_search.farthest_first(x[::9], exact_search.PIVOTS), True)
    for own in range(0, 400, 20):
        gaps = [((index.table.all - v) ** 2).sum(1) ** 0.5 for v in (x[own], x[7], x[-1])]
        for i, gap in ((7, gaps[1]), (len(x) - 1, gaps[2])):  # the table's bound is the largest over all pivots
            assert np.isclose(index.table_bounds(x[own])[i], (x[own] @ x[own] + x[i] @ x[i] - np.abs(gaps[0] - gap).max() ** 2) / 2, rtol=1e-5)
        assert (index.table_bounds(x[own]) >= x @ x[own]).all() and (index.span_bounds(x[own], np.arange(len(x))) >= x @ x[own]).all()
        ids, _, scores = index.top(x[own], 5, own)
        products = x @ x[own]
        products[own] = -np.inf
        want = np.lexsort((np.arange(len(x)), -products))[:5]
        assert ids.tolist() == want.tolist() and scores.tolist() == products[want].tolist()
    assert index.evaluated < share * 20 * len(x)
    assert index.eliminated > (0.9 if kind == "clusters" else 0) * 20 * len(x)
    print(kind, [round(n / (20 * len(x)), 3) for n in (index.eliminated, index.second, index.evaluated)])


def test_op10_all_in_small_tables(vectors):
    got = ann.nearest_neighbours(vectors, "pmod(vec_id, 100) = 0", 10).collect()
    table = usable(vectors, False)
    want = []
    for q in (i for i in table if i % 100 == 0):
        found = sorted((float(np.sqrt(((table[q] - v) ** 2).sum())), i) for i, v in table.items() if i != q and len(v) == len(table[q]))[:10]
        want += [(q, r + 1, i, s) for r, (s, i) in enumerate(found)]
    assert [r[:3] for r in sorted(map(tuple, got))] == [r[:3] for r in sorted(want)]
    assert np.allclose([r[3] for r in sorted(map(tuple, got))], [r[3] for r in sorted(want)], rtol=1e-14)


@pytest.mark.parametrize("kind", ["structureless", "clusters", "a third the same"])
def test_op10_recall(spark, tmp_path, kind):
    """Recall against brute force on a table where a query visits a sixth of the rows at most."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64))
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(200, 64)), 100, 0) + 0.3 * x
    x = (x / np.sqrt((x**2).sum(1, keepdims=True))).astype(np.float32)
    if kind == "a third the same":
        x[rng.permutation(len(x))[: len(x) // 3]] = x[7]
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x), "label": np.zeros(len(x), np.int32)}), str(tmp_path / "embeddings.parquet"))
    got = ann.op10_ann_search(spark, str(tmp_path)).toPandas()
    assert len(got) == 2000 and got.groupby("query_id")["rank"].apply(list).map(lambda r: sorted(r) == list(range(1, 11))).all()
    x, hits = x.astype(float), 0
    for q, found in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert np.allclose(d[found.vec_id], found.score, rtol=1e-14)
        d[q] = np.inf
        hits += int((found.score <= np.sort(d)[9] * (1 + 1e-12)).sum())
    assert hits / len(got) >= 0.9


@pytest.mark.parametrize("rows", [500, 2000])
def test_op10_recall_in_small_tables(spark, tmp_path, rows):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(rows, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(rows), "embedding": list(x)}), str(tmp_path / "embeddings.parquet"))
    got = ann.op10_ann_search(spark, str(tmp_path)).toPandas()
    hits = 0
    for q, found in got.groupby("query_id"):
        d = ((x.astype(float) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(found.vec_id))
    assert hits / len(got) >= 0.9


def test_op10_visits_a_small_share():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 64))
    quantiser = ann.Quantiser.fit(x[:4000], ann.CENTROIDS, 1)
    rows = np.bincount(quantiser.cells(x), minlength=quantiser.size)
    visited = [rows[quantiser.visit(x[i], rows.tolist(), 1401)].sum() for i in range(20)]
    assert min(visited) >= 1401 and max(visited) < 1401 + rows.max()


def test_op10_large_cells_are_in_several_blocks():
    rows = np.array([0, 5, 1000, 3, 0, 7])
    place = ann.Placement(rows, 8)
    to = place.of_rows(np.full(1000, 2), np.arange(1000))
    blocks, cells = place.of_cells(np.array([2, 1]))
    assert len(set(to.tolist())) > 5 and set(to.tolist()) <= set(blocks[cells == 2].tolist()) and blocks.max() < 8
    assert set(place.of_rows(np.array([1, 3, 5]), np.arange(3)).tolist()) <= set(place.of_cells(np.array([1, 3, 5]))[0].tolist())


def test_op10_cells_come_in_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6))
    quantiser = ann.Quantiser.fit(x, 8)
    cells, n = np.unique(quantiser.cells(x), return_counts=True)
    rows = np.zeros(64, np.int64)
    rows[cells] = n
    visited = quantiser.visit(x[0], rows.tolist(), 500)
    sums = (ann._squared(x[0][:3], quantiser.first)[:, None] + ann._squared(x[0][3:], quantiser.second)[None]).ravel()
    assert (np.diff(sums[visited]) >= -1e-12).all() and len(set(visited.tolist())) == len(visited) and rows[visited].sum() == 500


# -- archives --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    long, other = "<p>é</p>" * 40, "x" * 99
    rows = [(5, "http://a/b c?q=%41", long), (3, "http://a", long), (9, None, long), (4, "u", other), (6, "u", other), (7, "ü\r\nX: y", None), (8, "", ""), (None, "n", long), (None, "n", "alone" * 50), (3, "http://a", long)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(2).cache()


def test_op2_round_trip(spark, pages, tmp_path):
    packages = warc_zip.write_packages(pages, f"file://{tmp_path}/w")
    got = warc_zip.read_packages(packages).collect()
    key = lambda r: (r["page_id"] is None, r["page_id"], r["payload_bytes"])
    rows = {(r["page_id"], r["payload_bytes"]): r for r in got}
    assert len(got) == pages.count()
    for p in pages.collect():
        payload = (p["html"] or "").encode()
        r = rows[p["page_id"], len(payload)]
        assert r["payload_digest"] == hashlib.sha256(payload).hexdigest() and r["url"] == (p["url"] or "")
        revisit = len(payload) == 360 and p["page_id"] != 3
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None)), key(r)
        assert r["payload"] == (None if revisit else payload.decode())


def test_op2_packages_are_plain_zip(spark, pages, tmp_path):
    packages = warc_zip.write_packages(pages, f"file://{tmp_path}/w").collect()
    with zipfile.ZipFile(packages[0]["path"].removeprefix("file://")) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_op2_zip64(monkeypatch):
    """The wide directory records, forced by lowering the limits of the library that writes them."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    package = warc_zip.Package()
    for i in range(3):
        package.add(f"u{i}", warc_zip.record(i, f"u{i}", b"p" * i, None, "1970-01-01T00:00:00Z"), 1)
    package.write(out := io.BytesIO())
    assert b"PK\x06\x06" in out.getvalue()
    assert sorted((r["page_id"], r["payload"]) for r in warc_zip.read_package(out, len(out.getvalue()))) == [(i, b"p" * i) for i in range(3)]


def test_op2_reads_ranges_alone():
    package = warc_zip.Package()
    for i in range(50):
        package.add(f"u{i}", warc_zip.record(i, f"u{i}", b"p" * i, None, "1970-01-01T00:00:00Z"), 1)
    package.write(out := io.BytesIO())
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("other.bin", b"\0" * 3_000_000)
    file = Counting(out.getvalue())
    assert len(list(warc_zip.read_package(file, len(out.getvalue())))) == 50 and file.count < 200_000


class Counting(io.BytesIO):
    count = 0

    def read(self, n=-1):
        got = super().read(n)
        self.count += len(got)
        return got


def test_op2_broken_payload():
    raw = warc_zip.record(1, "u", b"payload", None, "1970-01-01T00:00:00Z").replace(b"payload\r\n", b"paYload\r\n")
    with pytest.raises(ValueError):
        warc_zip.parse_record(raw)
    with pytest.raises(ValueError):
        warc_zip.ZipRanges(io.BytesIO(b"nothing"), 7)


# -- pipeline --------------------------------------------------------------------------------------


def test_pipeline_stages(spark, folder, docs):
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, _ = corpus_pipeline.stored(stage(spark, rows, folder), f"test-{name}")
        assert out.columns == docs.columns, name
        rows = out
    last = corpus_pipeline.STAGES[-1][1](spark, rows, folder)
    assert last.count() == rows.count() == corpus_pipeline.run(spark, folder).count()


def test_pipeline_over_nothing(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
