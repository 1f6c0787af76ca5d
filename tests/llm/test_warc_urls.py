"""URLs whose letters also stand in the index lines' JSON."""

import pytest

from clonespark.llm import warc_zip


def test_op2_urls_with_braces(spark, tmp_path):
    urls = ["http://a/{id}", "{", "}", "http://a/ {\"offset\": 0}", "http://a/%7Bid%7D", "{} {", "http://b"]
    pages = spark.createDataFrame([(i, u, f"<p>{i}</p>" * 30) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = warc_zip.read_packages(warc_zip.write_packages(pages, f"file://{tmp_path}/w")).collect()
    assert sorted((r["page_id"], r["url"], r["payload"]) for r in got) == [(i, u, f"<p>{i}</p>" * 30) for i, u in enumerate(urls)]


def test_a_late_attempt_changes_nothing(spark, tmp_path):
    """Packages of another attempt of the same tasks lie in the folder too, and are in no table."""
    pages = spark.createDataFrame([(i, f"u{i}", "p" * i) for i in range(300)], "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/w"
    first = warc_zip.write_packages(pages, folder)
    late = warc_zip.write_packages(pages.repartition(2, "url"), folder)
    assert not {r["path"] for r in first.collect()} & {r["path"] for r in late.collect()}
    for table in (first, late):
        assert sorted(r["page_id"] for r in warc_zip.read_packages(table).collect()) == list(range(300))


def test_a_package_has_the_records_of_the_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "p")], "page_id long, url string, html string")
    packages = warc_zip.write_packages(pages, f"file://{tmp_path}/w")
    with pytest.raises(Exception, match="records, not"):
        warc_zip.read_packages(packages.selectExpr("path", "records + 1 records")).collect()


def test_a_page_of_megabytes(spark, tmp_path):
    html = "<p>é</p>" * 1_500_000
    pages = spark.createDataFrame([(1, "u", html), (2, "v", html)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc_zip.read_packages(warc_zip.write_packages(pages, f"file://{tmp_path}/w")).collect()}
    assert got[1]["payload"] == html and got[2]["record_type"] == "revisit" and got[2]["payload_bytes"] == len(html.encode())
