"""Queries that do the whole job: every row counts, against brute force."""

import hashlib
import html as html_text
import os
import re

import pytest

from corpusloom.sources import seeds


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_frontier_query_equals_brute_force(spark, sf):
    from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

    from corpusloom.plans import catalog

    def canonical(url):
        p = urlsplit(url)
        tracks = ("utm_", "mc_", "_hs", "gclid", "fbclid", "msclkid", "yclid", "wbraid", "gbraid")
        query = urlencode(sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not k.startswith(tracks)))
        return f"{p.scheme}://{p.netloc.lower()}{p.path.rstrip('/') or '/'}" + (f"?{query}" if query else "")

    pages = [(canonical(r.url), r.html) for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()]
    known, hosts = {u for u, _ in pages}, {urlsplit(u).netloc for u, _ in pages}
    want = []
    for url, html in sorted(pages):
        hrefs = (html_text.unescape(h).strip() for h in re.findall(r'<a\b[^>]*?\bhref="([^"]*)"', html))
        full = {canonical(urljoin(url, h)) for h in hrefs if h and not h.startswith(("#", "?", "mailto:", "javascript:", "tel:", "data:"))}
        for link in sorted(full):
            if urlsplit(link).netloc in hosts and link not in known:
                known.add(link)
                want.append(link)
    got = [r.url for r in catalog.frontier(spark, f"/root/testdata/{sf}").collect()]
    assert len(want) > 0 and sorted(got) == sorted(want[:1000])


def test_frontier_takes_a_table_of_hosts(spark):
    page = "<html><a href='/x'>x</a><a href='https://O/y'>y</a><a href='https://other/z'>z</a></html>"
    pages = spark.createDataFrame([("https://h/", "r1")], "url string, raw_hash string")
    blobs = spark.createDataFrame([("r1", page)], "raw_hash string, body string")
    hosts = spark.createDataFrame([("h",), ("o",)], "host string")
    new, done = seeds.frontier(pages, blobs, pages.select("url"), spark.createDataFrame([], "raw_hash string"), hosts)
    assert sorted(r.url for r in new.collect()) == ["https://h/x", "https://o/y"] and done.count() == 1


def test_slugs_read_the_whole_text(spark, tmp_path):
    from corpusloom.functions import text as tx
    from corpusloom.plans import catalog

    texts = ["é" * 250 + " Late Words, here", " " * 210 + "after blanks", "Short one", "x" * 300, "!" * 400 + "\nEnd", "ab " * 500]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.slug for r in catalog.slugs(spark, str(tmp_path)).collect()}
    assert got == {i: tx.slug_text(t) for i, t in rows}
    assert got[0] == "late-words-here" and got[1] == "after-blanks" and len(got[5]) <= 80


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_every_page_has_an_envelope(spark):
    from corpusloom.operators import integrity
    from corpusloom.plans import catalog, standins

    sf = "/root/testdata/sf0.001"
    pages = standins.standin(spark, sf, standins.PAGES).select("url", "content_hash").collect()
    got = catalog.proof_envelopes(spark, sf).collect()
    assert sorted(r.url for r in got) == sorted(r.url for r in pages) and all(r.included for r in got)
    leaf = {r.url: hashlib.sha256(f"{r.url}:{r.content_hash}".encode()).hexdigest() for r in pages}
    assert all(r.leaf == leaf[r.url] for r in got)
    root = integrity.merkle_root(integrity.leaves(standins.standin(spark, sf, standins.PAGES))).first()[0]
    assert {r.merkle_root for r in got} == {root}


def test_extract_log_equals_its_sql_where_pages_share_urls(spark, tmp_path):
    import duckdb

    from corpusloom import registry

    page = "<html><head><title>T</title></head><body><article><p>" + "words " * 30 + "{}</p></article></body></html>"
    # Fetched, changed and known pages of one url, copies of a known page, and urls that are only alike when they are canonical.
    rows = [(i, "https://h.example.com/a" + ("", "/", "#top", "?utm_source=x")[i % 4], page.format(i)) for i in range(32)]
    rows += [(i, "https://h.example.com/b", page.format("copy")) for i in range(32, 64)] + [(70, "https://h.example.com/c", page.format("c"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT url, raw_hash, reason, ok FROM ({registry.oracle_sql()['extract_log']})").fetchall()
    got = [(r.url, r.raw_hash, r.reason, r.ok) for r in registry.queries()["extract_log"](spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) and sorted(got, key=repr) == sorted(want, key=repr)
