"""Pages that share a url, against the registered SQL."""

import duckdb
import pytest

from pageloom.operators import similarity
from pageloom.plans import registry
from tests.test_queries import plain


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Twelve pages on four urls, some of them with one text."""
    rows = [(i, f"https://a.example.org/{i % 4}", f"<html><title>Title {i % 5}</title><p>{'some words of a text ' * 3}{i % 2}</p></html>") for i in range(12)]
    d = str(tmp_path_factory.mktemp("same-urls"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, folder)
    rows = sorted(repr([plain(r[c]) for c in want.columns]) for r in got.collect())
    assert rows == sorted(repr(list(map(plain, r))) for r in want.fetchall())
    return len(rows)


def test_a_changed_page_has_one_row(spark, folder):
    assert same_as_sql(spark, folder, "changed_documents") == 8


def test_a_page_of_a_changed_url_has_one_vector(spark, folder):
    assert same_as_sql(spark, folder, "embedded_pages") == 12


def test_any_row_of_a_key_makes_a_page_known(spark):
    pages = spark.createDataFrame([("u", "t", "new"), ("u", "t", "old"), ("w", "t", "new"), (None, "t", "new")], "url string, title string, content string")
    hashes = similarity.changed_documents(pages, spark.createDataFrame([], "url string, text_hash string")).collect()
    assert len(hashes) == 4
    by_text = {r.text_hash for r in hashes if r.url == "w"}
    known = spark.createDataFrame([("u", h) for h in by_text] + [("u", "other"), ("u", None), ("w", None)], "url string, text_hash string")
    left = similarity.changed_documents(pages, known).collect()
    assert sorted((r.url or "", r.text_hash in by_text) for r in left) == [("", True), ("u", False), ("w", True)]
