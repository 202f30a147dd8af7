import hashlib
import json
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html, profiles
from corpusloom.operators import corpus, integrity
from corpusloom.plans import build
from corpusloom.sources import storage
from corpusloom.streaming import feeds

from .test_functions import RATES


def responses(spark, pages, status=200):
    raw = {u: hashlib.sha256(b.encode()).hexdigest() for u, b in pages.items()}
    error = None if status < 400 else f"http-{status}"
    log = [(u, "FETCH", status, "e", None, raw[u], len(b), "t", error, None, "text/html", i) for i, (u, b) in enumerate(sorted(pages.items()))]
    return spark.createDataFrame(log, storage.FETCH), spark.createDataFrame([(raw[u], b) for u, b in pages.items()], "raw_hash string, body string")


def page(title, body):
    return f"<html><head><title>{title}</title></head><body><article><h1>{title}</h1><p>{body}</p></article></body></html>"


def test_build_twice(spark, tmp_path):
    root, base = str(tmp_path), "https://www.ato.gov.au"
    pages = {f"{base}/individuals/p{i}": page(f"Page {i}", f"Some prose about the number {i}, long enough to be a page of its own. " * 2) for i in range(6)}
    pages[f"{base}/tax-rates-and-codes/tax-rates-australian-residents"] = f"<html><body><article>{RATES}<p>{'Rates of tax. ' * 8}</p></article></body></html>"
    seeds = spark.createDataFrame([(i, u, None) for i, u in enumerate(sorted(pages))], "seq long, url string, lastmod string")
    log, blobs = responses(spark, pages)
    assert build.run(spark, root, seeds, log, blobs, "2026-05-01T00:00:00Z", "r1", profiles.ATO)
    assert storage.current(spark, root) == "r1" and json.loads(storage.get_text(spark, f"{root}/runs/r1/snapshot.json"))["status"] == "published"
    assert storage.changelog(spark, root).count() == 7 and storage.table(spark, root, "facts").first()["fy"] == "2025-26"
    held = {r.gate: r.passed for r in storage.table(spark, root, "gates").collect()}
    assert held == dict.fromkeys(("manifest_fs_integrity", "hash_sample", "coverage", "schema_sanity", "changelog_continuity", "consolidate_md_tree", "facts_validation", "determinism"), True)
    index, listed = storage.get_text(spark, f"{root}/runs/r1/INDEX.md"), storage.get_text(spark, f"{root}/runs/r1/llms.txt")
    assert "[Tax rates and codes](sections/tax-rates-and-codes/INDEX.md) (1 pages)" in index and "## LIVING (7 pages)" in listed and f"- {base}/individuals/p0" in listed
    lines = {(r.slug, r.kind): r.line for r in storage.table(spark, root, "sections").where("kind = 0").collect()}
    assert lines["individuals", 0] == "Audience: `general` · Pages: 6" and storage.table(spark, root, "sections").count() == 9
    fact = corpus.read_facts(storage.table(spark, root, "facts").drop("known", "errors", "k"), "ato-rate-table-v1").first()
    assert fact["path"] == "facts/ato-rate-table-v1/individual-resident-2025-26.json" and fact["text"].startswith(f"# {fact['path']}\nschema: ato-rate-table-v1\nsource_url: {base}/tax-rates")
    assert list(json.loads(fact["text"].split("---\n")[1])) == sorted(json.loads(fact["text"].split("---\n")[1]))
    first = storage.table(spark, root, "snapshot").first()
    assert first["leaf_count"] == 7 and first["counts_by_state"] == {"FRESH": 7}
    md = storage.table(spark, root, "pages").where("url LIKE '%/p1'").first()
    assert "# Page 1 {#page-1}" in md["body"] and f"content_hash: sha256:{md['content_hash']}" in md["page"]

    changed = dict(pages)
    changed[f"{base}/individuals/p1"] = page("Page 1", "Quite another text that also goes on for long enough to be a page. " * 2)
    log, blobs = responses(spark, changed)
    assert build.run(spark, root, seeds, log, blobs, "2026-05-20T00:00:00Z", "r2", profiles.ATO)
    entries = storage.changelog(spark, root)
    assert integrity.verify(entries).first()["ok"] and storage.table(spark, root, "changelog").count() == 1
    assert storage.table_as_of(spark, root, "pages", "2026-05-10T00:00:00Z")[0] == "r1" and storage.table_as_of(spark, root, "pages", "2026-05-20T00:00:00Z")[0] == "r2"
    assert storage.table_as_of(spark, root, "pages", "r1")[1].where("url LIKE '%/p1'").first()["body"] == md["body"]
    assert [tuple(r)[1:7] for r in corpus.describe(storage.discover(spark, root)).collect()] == [("www.ato.gov.au", "Indexed pages of www.ato.gov.au", 7, root)]
    assert storage.discover(spark, str(tmp_path.parent)).where(F.col("root").endswith(tmp_path.name)).count() == 1
    assert entries.count() == 8 and [r.url for r in entries.where("run_id = 'r2'").collect()] == [f"{base}/individuals/p1"]
    assert storage.table(spark, root, "pages").count() == 7 and storage.table(spark, root, "snapshot").first()["merkle_root"] != first["merkle_root"]
    again, _ = build.re_extract(storage.table(spark, root, "manifest"), blobs, "2026-05-21T00:00:00Z", profiles.ATO)
    assert again.count() == 7
    _, x = build.re_extract(storage.table(spark, root, "manifest"), blobs, "2026-05-21T00:00:00Z", profiles.ATO)
    j = x.join(storage.table(spark, root, "manifest").select("url", F.col("content_hash").alias("h")), "url")
    assert j.where("content_hash = h").count() == 7

    log, blobs = responses(spark, changed, status=500)
    assert not build.run(spark, root, seeds, log, blobs, "2026-09-20T00:00:00Z", "r3", profiles.ATO)
    assert storage.current(spark, root) == "r2"
    path, digest = storage.backup(spark, root, f"{root}/backups", 2)
    assert storage.verify_backup(spark, path) == (True, "") and storage.get_text(spark, f"{path}/sha256") == digest and len(digest) == 64
    assert spark.read.parquet(f"{path}/changelog").count() == 8
    for old in ("a", "b"):
        storage.put_text(spark, f"{root}/backups/{old}/sha256", "x")
    storage.backup(spark, root, f"{root}/backups", 2)
    assert storage.exists(spark, f"{path}/sha256") and not storage.exists(spark, f"{root}/backups/a") and storage.exists(spark, f"{root}/backups/b")
    for bad in ("r3", "2020-01-01T00:00:00Z", "nonsense"):
        with pytest.raises(ValueError):
            storage.table_as_of(spark, root, "pages", bad)
    assert json.loads(storage.get_text(spark, f"{root}/runs/r3/status.json"))["status"] == "degraded"
    with pytest.raises(Exception):
        build.run(spark, root, seeds.drop("url"), log, blobs, "2026-09-21T00:00:00Z", "r4", profiles.ATO)
    assert json.loads(storage.get_text(spark, f"{root}/runs/r4/status.json"))["status"] == "failed" and storage.current(spark, root) == "r2"


def test_an_invalid_fact_degrades_a_build_and_plug_ins_run(spark, tmp_path):
    base, body = "https://www.ato.gov.au", "Some prose that is long enough to be a page of its own and no shorter than that. " * 2
    made = lambda fy: lambda rows: rows.select(F.lit("ato-rate-table-v1").alias("schema"), F.lit("own").alias("slug"), "url", F.concat(F.lit("sha256:"), "content_hash").alias("content_hash"), F.lit(fy).alias("fy"), F.lit("company").alias("audience"), F.expr("array(named_struct('from', 0L, 'to', cast(null as bigint), 'rate', 0.3D, 'base', 0D))").alias("brackets"), F.lit("2025-07-01").alias("effective_from"), F.lit("2026-06-30").alias("effective_to"), F.lit("own-1").alias("extractor_version"))
    shout = html.Strategy("shout", lambda body, kind: "shouted" in body, lambda body: (f"# Loud\n\n{body.upper()}", "Loud"))
    pages = {f"{base}/a": page("A", body), f"{base}/b": f"shouted {body}"}
    seeds = spark.createDataFrame([(i, u, None) for i, u in enumerate(sorted(pages))], "seq long, url string, lastmod string")
    log, blobs = responses(spark, pages)
    for fy, good in (("2025-26", True), ("soon", False)):
        own = replace(profiles.ATO, strategies=(shout,), enrichers=(lambda md, raw: (md + "\n\nEnriched.", 1),), extractors=(("own", lambda url: url.endswith("/a"), made(fy)),))
        root = f"{tmp_path}/{good}"
        assert build.run(spark, root, seeds, log, blobs, "2026-05-01T00:00:00Z", "r1", own) is good
        held = {r.gate: r.passed for r in spark.read.parquet(f"{root}/runs/r1/gates").collect()}
        assert held["facts_validation"] is good and held["determinism"] and sum(not x for x in held.values()) == (not good)
        got = {r.url[-1]: r for r in spark.read.parquet(f"{root}/runs/r1/pages").collect()}
        assert got["a"].body.endswith("Enriched.") and got["b"].title == "Loud" and "SHOUTED" in got["b"].body and got["b"].extractor_version == "loom-html-1-shout"


def test_extract_reasons(spark):
    from corpusloom.operators import manifest as m

    body = page("T", "words " * 30)
    log = [("a", 200, "r1", None), ("b", 304, None, None), ("c", 404, "r1", None), ("d", 200, None, None), ("e", 200, "r2", None), ("f", 200, "r3", None)]
    fetch = spark.createDataFrame([(u, "FETCH", s, None, None, r, 1, "t", e, None, "text/html", i) for i, (u, s, r, e) in enumerate(log)], storage.FETCH)
    blobs = spark.createDataFrame([("r1", body), ("r2", '<html><body class="cf-browser-verification"><p>' + "x " * 40 + "</p></body></html>"), ("r3", "%PDF-1.7")], "raw_hash string, body string")
    got = {r.url: (r.ok, r.reason) for r in build.extract(fetch, blobs, m.empty(spark)).collect()}
    assert got == {"a": (True, "new-content-html"), "b": (True, "304"), "c": (False, "http-404"), "d": (False, "no-raw-hash"), "e": (False, "admission-challenge-page"), "f": (False, "extract-failed-pdf")}


def test_extract_gives_one_row_where_the_manifest_repeats_a_url(spark):
    from corpusloom.operators import manifest as m

    pages, row = {f"r{k}": page("T", f"{k} words " * 30) for k in range(3)}, {"normalizer_version": "v2", "extractor_version": "loom-html-1-html"}
    known = [row | {"url": "a", "raw_hash": r, "content_hash": c} for r, c in (("r0", "c0"), ("r1", "c1"), ("r1", "c1"), ("r2", None))]
    manifest = spark.createDataFrame([tuple(k.get(c) for c in m.COLUMNS) for k in known], ", ".join(f"{c} {m.MANIFEST_TYPES[c]}" for c in m.COLUMNS))
    log = [("a", 200, "r0"), ("a", 200, "r1"), ("a", 200, "r2"), ("a", 304, None), ("b", 200, "r0")]
    fetch = spark.createDataFrame([(u, "FETCH", s, None, None, r, 1, "t", None, None, "text/html", i) for i, (u, s, r) in enumerate(log)], storage.FETCH)
    blobs = spark.createDataFrame(list(pages.items()), "raw_hash string, body string")
    got = sorted((r.seq, r.reason, r.content_hash if r.reason == "unchanged-raw" else None, r.extractor_version) for r in build.extract(fetch, blobs, manifest).collect())
    v = row["extractor_version"]
    assert got == [(0, "unchanged-raw", "c0", v), (1, "unchanged-raw", "c1", v), (2, "new-content-html", None, v), (3, "304", None, v), (4, "new-content-html", None, v)]


def test_storage(spark, tmp_path):
    path = str(tmp_path)
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"url": "u", "status": 200, "seq": 1}\nnot json\n{"url": "v", "status": 404}\n')
    rows = storage.read_log(spark, f"{path}/log", "fetch").where("url IS NOT NULL").collect()
    assert [(r.url, r.status, r.error) for r in rows] == [("u", 200, None), ("v", 404, None)]
    blobs = spark.createDataFrame([("aa1", "x"), ("bb2", "y"), ("aa1", "x")], "raw_hash string, body string")
    assert storage.add_blobs(spark, blobs, f"{path}/raw") == 2 and storage.add_blobs(spark, blobs, f"{path}/raw") == 0
    assert storage.read_blobs(spark, f"{path}/raw").count() == 2
    (tmp_path / "md").mkdir()
    (tmp_path / "md/p.md").write_text('---\nurl: https://x/p\ncontent_hash: sha256:abc\nanchors: ["a"]\nbad line\ntier: LIVING\n---\n# Body\n')
    r = storage.read_pages(spark, f"{path}/md").first()
    assert (r.url, r.content_hash, r.anchors, r.tier, r.body) == ("https://x/p", "abc", ["a"], "LIVING", "# Body\n")
    storage.put_text(spark, f"{path}/t", "one")
    storage.put_text(spark, f"{path}/t", "two")
    assert storage.get_text(spark, f"{path}/t") == "two" and not storage.exists(spark, f"{path}/t.tmp") and storage.current(spark, path) is None
    with pytest.raises(ValueError):
        storage.table(spark, path, "pages")
    assert storage.verify_backup(spark, path)[0] is False


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", []
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"url": f"u{i}", "status": 200, "seq": i, "fetched_at": "2026-01-01T00:00:00Z"}) for i in range(5)))
    q = feeds.fold(feeds.log_stream(spark, str(src), "fetch"), lambda b, n: out.append((n, b.count())), str(tmp_path / "ck"))
    q.awaitTermination(60)
    (src / "b.json").write_text(json.dumps({"url": "u9", "status": 404, "seq": 9, "fetched_at": "2026-01-01T00:00:00Z"}))
    feeds.fold(feeds.log_stream(spark, str(src), "fetch"), lambda b, n: out.append((n, b.count())), str(tmp_path / "ck")).awaitTermination(60)
    assert out == [(0, 5), (1, 1)]
    from corpusloom.operators import manifest as m

    rows = spark.createDataFrame([(f"u{i}",) for i in range(12)], "url string").select(*(F.col("url") if c == "url" else F.lit({"state": "UNSEEN", "fail_count": 0, "unchanged_streak": 0}.get(c)).cast(t).alias(c) for c, t in m.MANIFEST_TYPES.items()))
    extract = spark.createDataFrame([(f"u{i}", "r", f"h{i}", "t", 1, "E", "v1", True, "ok", i) for i in range(12)], "url string, raw_hash string, content_hash string, title string, n_chars int, extractor_version string, normalizer_version string, ok boolean, reason string, seq long")
    apply = feeds.manifest_fold(spark, f"{tmp_path}/state", rows, extract, "2026-01-02T00:00:00Z", "r1")
    feeds.fold(feeds.log_stream(spark, str(src), "fetch"), apply, str(tmp_path / "ck3")).awaitTermination(60)
    (src / "c.json").write_text(json.dumps({"url": "u1", "status": 304, "seq": 20, "fetched_at": "2026-01-01T00:00:00Z"}))
    feeds.fold(feeds.log_stream(spark, str(src), "fetch"), apply, str(tmp_path / "ck3")).awaitTermination(60)
    state = {r.url: (r.state, r.unchanged_streak, r.content_hash) for r in feeds.manifest_state(spark, f"{tmp_path}/state").collect()}
    assert state["u0"] == ("FRESH", 0, "h0") and state["u1"] == ("FRESH", 1, "h1") and state["u9"][0] == "GONE" and state["u7"][0] == "UNSEEN"
    apply(spark.createDataFrame([], storage.FETCH), 1)
    assert storage.get_text(spark, f"{tmp_path}/state/last") == "1"
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text("\n".join(json.dumps({"seq": i, "url": f"u{i}", "run_id": f"r{i % 3}"}) for i in range(9)))
    runs = spark.createDataFrame([("r0", "published"), ("r1", "degraded"), ("r2", "published")], "run_id string, status string")
    feed = feeds.change_feed(spark, str(tmp_path / "log"), runs).writeStream.format("memory").queryName("feed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck4")).start()
    feed.awaitTermination(60)
    assert sorted(r.seq for r in spark.table("feed").collect()) == [0, 2, 3, 5, 6, 8]
    (tmp_path / "at").mkdir()
    (tmp_path / "at/x.json").write_text("\n".join(json.dumps({"host": h, "seq": i, "blocked": b}) for h, i, b in [("a", 4, True), ("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 3, False), ("b", 1, True), ("b", 2, True), ("b", 4, True), ("c", 3, True), ("c", 1, True), ("c", 2, True), ("c", 4, False)]))
    s = feeds.blocked_hosts(spark.readStream.schema("host string, seq long, blocked boolean").json(str(tmp_path / "at")))
    q = s.writeStream.outputMode("update").format("memory").queryName("hosts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.awaitTermination(90)
    time.sleep(0.2)
    assert {r.host: r.latched for r in spark.table("hosts").collect()} == {"a": False, "b": False, "c": True}
