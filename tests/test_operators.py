import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import artifacts, changes, corpus, evals, fetches, gates, integrity
from corpusloom.operators import manifest as m
from corpusloom.plans import config
from corpusloom.sources import seeds

BASE = {
    "url": "https://www.ato.gov.au/x", "tier": "LIVING", "state": "FRESH", "first_seen_at": "2026-01-01T00:00:00Z", "last_fetched_at": "2026-05-01T00:00:00Z", "last_attempted_at": "2026-05-01T00:00:00Z",
    "http_status": 200, "http_etag": 'W/"abc"', "raw_hash": "rawhash", "content_hash": "contenthash", "last_changed_at": "2026-04-01T00:00:00Z", "unchanged_streak": 2, "crawler_version": "v1.0.0",
    "extractor_version": "E", "normalizer_version": "v1", "classifier_version": "v1", "fail_count": 0,
}


def rows(spark, *changes_):
    return spark.createDataFrame([tuple((BASE | {"url": f"u{i}"} | c).get(k) for k in m.COLUMNS) for i, c in enumerate(changes_)], m.MANIFEST)


DECISIONS = [
    ({"tier": "FROZEN"}, None, "SKIP"), ({"tier": "FROZEN", "extractor_version": "old"}, None, "SKIP"), ({"tier": "FROZEN", "state": "UNSEEN", "content_hash": None, "last_fetched_at": None}, None, "FETCH"),
    ({"state": "GONE", "last_attempted_at": "2026-05-14T00:00:00Z"}, None, "SKIP"), ({"state": "GONE", "last_attempted_at": "2026-01-24T00:00:00Z"}, None, "TOMBSTONE_PURGE"),
    ({"state": "GONE", "last_attempted_at": "2026-05-14T00:00:00Z"}, "2026-05-23T00:00:00Z", "FETCH"), ({"state": "GONE", "last_attempted_at": None, "first_seen_at": "bad"}, None, "TOMBSTONE_PURGE"),
    ({"state": "FAILED", "fail_count": 3}, None, "FETCH"), ({"state": "FAILED", "fail_count": 100}, None, "SKIP"), ({"last_fetched_at": "2026-05-20T00:00:00Z"}, "2026-05-23T00:00:00Z", "FETCH_CONDITIONAL"),
    ({"last_fetched_at": "2026-05-23T23:00:00Z"}, "2026-05-01T00:00:00Z", "SKIP"), ({"last_fetched_at": "2026-05-23T00:00:00Z", "unchanged_streak": 0}, None, "SKIP"),
    ({"last_fetched_at": "2026-04-15T00:00:00Z", "unchanged_streak": 0}, None, "FETCH_CONDITIONAL"), ({"state": "UNSEEN", "last_fetched_at": None}, None, "FETCH"),
]


def test_decisions(spark):
    table = rows(spark, *(c | {"sitemap_lastmod_seen": mod} for c, mod, _ in DECISIONS))
    got = {r.url: (r.decision, r.reason) for r in m.plan(table, F.lit("2026-05-24T00:00:00").cast("timestamp")).collect()}
    assert [got[f"u{i}"][0] for i in range(len(DECISIONS))] == [d for _, _, d in DECISIONS]
    assert got["u11"][1].startswith("within-interval")
    assert table.limit(1).select(m.decide(F.lit("2026-05-24").cast("timestamp"), F.lit(None).cast("string"), known=F.lit(False))["decision"]).first()[0] == "FETCH"


def test_intervals_and_config(spark):
    d = spark.range(1).select(*(m.interval_days(F.lit("LIVING"), F.lit(k)).alias(f"c{k}") for k in (0, 2, 20))).first()
    assert tuple(d) == (7, 28, 90)
    c = config.load("[tiers.NEWS]\nfloor = 2\n[versions]\nextractor = 'X'")
    assert c.rhythm["NEWS"].floor == 2 and c.rhythm["NEWS"].ceiling == 7 and c.versions.extractor == "X"
    for bad in ("[tiers.NOPE]\nfloor = 1", "[tiers.NEWS]\nfloor = 0", "[tiers.NEWS]\nceiling = 0"):
        with pytest.raises(ValueError):
            config.load(bad)


def test_plan_options(spark):
    table = rows(spark, {"last_fetched_at": "2026-05-23T00:00:00Z", "browser_version": "b0"}, {"sitemap_lastmod_seen": "2026-05-23T00:00:00Z"})
    now = F.lit("2026-05-24").cast("timestamp")
    moved = m.Config(versions=m.Versions(browser="b1"))
    assert {r.url: r.decision for r in m.plan(table, now, config=moved).collect()}["u0"] == "FETCH_CONDITIONAL"
    given = spark.createDataFrame([("u1", None)], "url string, lastmod string")
    assert {r.url: r.sitemap_lastmod for r in m.plan(table, now, given).collect()} == {"u0": None, "u1": None}
    off = m.plan(table, now, browser_enabled=False, needs_browser=F.col("url") == "u0", only=spark.createDataFrame([("u0",)], "url string"))
    assert [r.decision for r in off.collect()] == ["SKIPPED_BROWSER_DISABLED"]


def test_times_are_utc_in_any_session(spark):
    texts = ["2026-05-24T00:00:00Z", "2026-05-24T00:00:00", "2026-05-24T00:00:00+00:00", "2026-05-24T10:00:00+10:00", "2026-05-24 00:00:00", "2026-05-24", "2026-05-23T14:00:00.5-10:00", "bad", None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Australia/Sydney"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_millis(m.at(F.col("t"))).alias("s")).collect()]
            assert got == [1779580800000] * 6 + [1779580800500, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


FETCH = "url string, decision string, status int, etag string, last_modified string, raw_hash string, raw_bytes long, fetched_at string, error string, browser_version string, content_type string, seq long"
EXTRACT = "url string, raw_hash string, content_hash string, title string, n_chars int, extractor_version string, normalizer_version string, ok boolean, reason string, seq long"


def test_commit_applies_every_result_of_a_url(spark):
    log = [("u0", 500, "boom"), ("u1", 500, "boom"), ("u1", 200, None), ("u2", 304, None), ("u0", 503, "bang"), ("u2", 304, None), ("u3", 404, None), ("u3", 200, None), ("u3", 410, None)]
    fetch = spark.createDataFrame([(u, "FETCH", s, None, None, "r", 5, "t", e, None, "text/html", i) for i, (u, s, e) in enumerate(log)], FETCH).repartition(3)
    extract = spark.createDataFrame([(u, "r", h, "t", 1, "E", "v1", True, "ok", i) for i, (u, h) in enumerate((("u1", "new"), ("u3", "contenthash")))], EXTRACT)
    table = rows(spark, *[{}] * 5)
    after, change = m.commit(table, fetch, extract, "NOW", "run")
    a = {r.url: r for r in after.collect()}
    assert (a["u0"].state, a["u0"].fail_count, a["u0"].last_error, a["u0"].http_status) == ("FAILED", 2, "bang", 503)
    assert (a["u1"].state, a["u1"].fail_count, a["u1"].content_hash) == ("FRESH", 0, "new") and a["u2"].unchanged_streak == 4 and a["u3"].state == "GONE"
    assert [(r.seq, r.url, r.change_type) for r in change.orderBy("seq").collect()] == [(2, "u1", "changed"), (6, "u3", "gone"), (8, "u3", "gone")]
    assert a["u4"].asDict() == table.where("url = 'u4'").first().asDict()
    assert m.commit_counters(table, fetch, extract).first().asDict() == {"applied": 9, "errors": 3, "not_modified": 2, "gone": 2, "fresh": 2, "changelog_added": 0, "changelog_changed": 1, "changelog_gone": 2}


def test_denied_calls_are_not_charged(spark):
    calls = [("a", 1, 6, False), ("a", 2, 6, False), ("a", 3, 3, False), ("a", 4, 1, True), ("a", 5, 1, False), ("a", 6, 1, False), ("b", 1, 11, False), (None, 1, 10, False), (None, 2, 1, False)]
    df = spark.createDataFrame(calls, "account string, seq long, cost long, refunded boolean").repartition(3)
    got = {(r.account, r.seq): (r.spent, r.allowed) for r in m.credits(df, 10).collect()}
    assert got == {("a", 1): (0, True), ("a", 2): (6, False), ("a", 3): (6, True), ("a", 4): (9, True), ("a", 5): (9, True), ("a", 6): (10, False), ("b", 1): (0, False), (None, 1): (0, True), (None, 2): (10, False)}


def test_sitemaps_are_walked_up_to_the_caps_in_order(spark):
    top = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</sitemapindex>'
    leaf = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</urlset>'
    maps = [("i", top.format("".join(f"<sitemap><loc>m{k}</loc></sitemap>" for k in (3, 1, 2)) + "<sitemap><loc>i</loc></sitemap>"))]
    maps += [(f"m{k}", leaf.format("".join(f"<url><loc>u{k}{j}</loc></url>" for j in range(3)))) for k in (1, 2, 3)]
    deep = [(f"d{k}", top.format(f"<sitemap><loc>d{k + 1}</loc></sitemap>")) for k in range(60)] + [("d60", leaf.format("<url><loc>deep</loc></url>"))]
    bodies, root = spark.createDataFrame(maps, "url string, body string"), spark.createDataFrame([("i",)], "url string")
    walk = lambda **caps: [r.url for r in seeds.walk_sitemaps(bodies, root, **caps).collect()]
    assert sorted(walk()) == [f"u{k}{j}" for k in (1, 2, 3) for j in range(3)]
    with pytest.warns(UserWarning, match="3 sitemaps"):
        assert sorted(walk(max_sitemaps=3)) == ["u10", "u11", "u12", "u30", "u31", "u32"]
    with pytest.warns(UserWarning, match="4 urls"):
        assert walk(max_urls=4) == ["u30", "u31", "u32", "u10"]
    three = spark.createDataFrame(deep[-4:], "url string, body string")
    assert [r.url for r in seeds.walk_sitemaps(three, spark.createDataFrame([("d57",)], "url string")).collect()] == ["deep"]
    assert seeds.walk_sitemaps(bodies, root.limit(0)).collect() == []


def test_proportional_samples_are_exact(spark):
    rows_ = [("a", f"a{i}") for i in range(5000)] + [("b", f"b{i}") for i in range(300)] + [("c", "c0")]
    df = spark.createDataFrame(rows_, "tier string, url string").repartition(5)
    h = lambda u: hashlib.sha256(f"l:{u}".encode()).hexdigest()
    for total in (1, 10, 100, 2000):
        want = []
        for t in "abc":
            own = sorted((u for s, u in rows_ if s == t), key=h)
            want += own[: max(1, round(total * len(own) / len(rows_)))]
        assert sorted(r.url for r in corpus.proportional(df, "tier", "url", "l", total).collect()) == sorted(sorted(want, key=h)[:total])


def test_commit_transitions(spark):
    table = rows(spark, {"state": "UNSEEN", "content_hash": None, "unchanged_streak": 0}, *[{}] * 6)
    log = [("u0", 200, None), ("u1", 200, None), ("u2", 200, None), ("u3", 304, None), ("u4", 404, None), ("u5", 500, "boom"), ("u6", 200, None), ("nope", 200, None)]
    fetch = spark.createDataFrame([(u, "FETCH", s, "e2", None, "r2", 5, "t", e, None, "text/html", i) for i, (u, s, e) in enumerate(log)], "url string, decision string, status int, etag string, last_modified string, raw_hash string, raw_bytes long, fetched_at string, error string, browser_version string, content_type string, seq long")
    hashes = {"u0": "new", "u1": "contenthash", "u2": "other", "u6": None}
    extract = spark.createDataFrame([(u, "r2", h, "t", 1, "E2", "v1", u != "u6", "extract-failed-html" if u == "u6" else "ok", i) for i, (u, h) in enumerate(hashes.items())], "url string, raw_hash string, content_hash string, title string, n_chars int, extractor_version string, normalizer_version string, ok boolean, reason string, seq long")
    after, change = m.commit(table, fetch, extract, "NOW", "run")
    a = {r.url: r for r in after.collect()}
    assert len(a) == 7 and (a["u0"].state, a["u0"].content_hash, a["u0"].unchanged_streak, a["u0"].last_changed_at) == ("FRESH", "new", 0, "NOW")
    assert a["u1"].unchanged_streak == 3 and a["u2"].unchanged_streak == 0 and a["u3"].unchanged_streak == 3 and a["u3"].raw_hash == "rawhash"
    assert a["u4"].state == "GONE" and a["u4"].content_hash == "contenthash" and (a["u5"].state, a["u5"].fail_count, a["u5"].last_error) == ("FAILED", 1, "boom")
    assert (a["u6"].state, a["u6"].last_error) == ("FAILED", "extract-failed-html")
    assert {(r.url, r.change_type, r.old_hash, r.new_hash) for r in change.collect()} == {("u0", "added", None, "new"), ("u2", "changed", "contenthash", "other"), ("u4", "gone", "contenthash", None)}


RUN = lambda k, s: (f"2026010{k}T000000Z", f"2026-01-0{k}T00:00:00Z", f"2026-01-0{k}T00:00:00Z", s)
LOG = [
    (1, "added", "u1", None, "a1", "LIVING"), (1, "added", "u2", None, "a2", "LIVING"), (1, "added", "u3", None, "a3", "LIVING"), (2, "changed", "u1", "a1", "b1", "LIVING"), (2, "gone", "u2", "a2", None, "LIVING"),
    (2, "changed", "u3", "a3", "b3", "LIVING"), (2, "added", "u4", None, "b4", "FROZEN"), (3, "changed", "u3", "b3", "c3", "LIVING"), (4, "added", "u5", None, "d5", "LIVING"),
]


@pytest.fixture
def history(spark):
    runs = spark.createDataFrame([RUN(1, "published"), RUN(2, "published"), RUN(3, "published"), RUN(4, "degraded")], "run_id string, started_at string, completed_at string, status string")
    log = spark.createDataFrame([(i, f"2026-01-0{k}T00:00:00Z", f"https://x/{u}", c, a, b, f"2026010{k}T000000Z", t) for i, (k, c, u, a, b, t) in enumerate(LOG)], "seq long, ts string, url string, change_type string, old_hash string, new_hash string, run_id string, tier string")
    return log, runs


def test_changed_since(spark, history):
    log, runs = history
    got = {(r.net, r.url[-2:], r.old_hash, r.new_hash) for r in changes.changed_since(log, runs, "20260101T000000Z").collect()}
    assert got == {("added", "u4", None, "b4"), ("removed", "u2", "a2", None), ("modified", "u1", "a1", "b1"), ("modified", "u3", "a3", "c3")}
    assert tuple(changes.delta_counts(log, runs, "2026-01-01T00:00:00Z").first()) == (1, 1, 2)
    assert [r.url[-2:] for r in changes.changed_since(log, runs, "20260102T000000Z").collect()] == ["u3"]
    assert changes.changed_since(log, runs, "20260103T000000Z").count() == 0
    assert [r.url[-2:] for r in changes.changed_since(log, runs, "20260101T000000Z", tier="FROZEN").collect()] == ["u4"]
    assert [r.url[-2:] for r in changes.changed_since(log, runs, "20260101T000000Z", prefix="https://x/u1").collect()] == ["u1"]
    paged = [r for r in changes.changed_since(log, runs, "20260101T000000Z", limit=1).collect() if r.net == "modified"]
    assert [(r.url[-2:], r.total) for r in paged] == [("u3", 2)]
    with pytest.raises(ValueError):
        changes.changed_since(log, runs, "nothing")
    at = {r.point: r.run_id for r in changes.as_of(runs, spark.createDataFrame([("2026-01-02T12:00:00Z",), ("20260101T000000Z",), ("2025-01-01T00:00:00Z",), ("2027-01-01T00:00:00Z",)], "point string")).collect()}
    assert at == {"2026-01-02T12:00:00Z": "20260102T000000Z", "20260101T000000Z": "20260101T000000Z", "2025-01-01T00:00:00Z": None, "2027-01-01T00:00:00Z": "20260103T000000Z"}


def fold(leaves):
    level = sorted(leaves)
    while len(level) > 1:
        level = level + [level[-1]] if len(level) % 2 else level
        level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2], strict=True)]
    return level[0] if level else None


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17])
def test_merkle(spark, n):
    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    df = spark.createDataFrame([(x,) for x in h], "leaf string")
    assert tuple(integrity.merkle_root(df).first()) == (fold(h), n)
    if n in (5, 17):
        for small, height in ((100, 16), (0, 16), (0, 1), (0, 2), (0, 3)):
            assert tuple(integrity.merkle_root(df, small, height).first()) == (fold(h), n)
            p = integrity.proofs(df, df, small, height).select("proof", "root", (integrity.fold(F.col("leaf"), F.col("proof")) == fold(h)).alias("ok")).collect()
            assert len(p) == n and all(r.ok and r.root == fold(h) and len(r.proof) == (n - 1).bit_length() for r in p)
        twice = df.unionByName(df.limit(3))
        few = df.limit(4).unionByName(spark.createDataFrame([("absent",), (None,)], "leaf string"))
        for small in (0, 100):
            p = integrity.proofs(twice, few, small, 2).collect()
            assert len(p) == 4 and {r.root for r in p} == {fold([r.leaf for r in twice.collect()])}


def test_envelopes(spark):
    pages = spark.createDataFrame([(f"https://x/{n}", hashlib.sha256(n.encode()).hexdigest()) for n in ("alpha", "beta", "gamma", "delta", "epsilon")] + [("https://x/none", None)], "url string, content_hash string")
    asked = spark.createDataFrame([("https://X/alpha/#y",), ("https://x/none",)], "url string")
    got = {r.url: r.asDict(True) for r in integrity.envelopes(pages, asked, "r1").collect()}
    good = got["https://X/alpha/#y"]
    e = good | {"url": good["proved_url"]}
    assert integrity.verify_envelope(e) == (True, "") and integrity.verify_envelope(e, "0" * 64)[0] is False
    assert not integrity.verify_envelope(e | {"content_hash": "x"})[0] and not integrity.verify_envelope(e | {"scheme": "y"})[0]
    assert got["https://x/none"]["included"] is False


def test_chain(spark):
    log = [(i, "t", f"https://x/{i}", "added", None, f"é{i}" if i == 2 else f"h{i}", "r", "LIVING") for i in range(6)]
    schema = "seq long, ts string, url string, change_type string, old_hash string, new_hash string, run_id string, tier string"
    first = integrity.append(spark.createDataFrame(log[:3], schema))
    tip = first.orderBy(F.desc("seq")).first()["entry_hash"]
    whole = first.unionByName(integrity.append(spark.createDataFrame(log[3:], schema), tip))
    entries = [r.asDict() for r in whole.orderBy("seq").collect()]
    prev = integrity.GENESIS
    for e in entries:
        body = json.dumps({k: e[k] for k in integrity.CHAINED}, sort_keys=True, separators=(",", ":"))
        assert e["prev_hash"] == prev and e["entry_hash"] == "sha256:" + hashlib.sha256((prev[7:] + body).encode()).hexdigest()
        prev = e["entry_hash"]
    check = lambda rows_: integrity.verify(spark.createDataFrame(rows_, whole.schema)).first()
    rows_ = [tuple(e[c] for c in whole.columns) for e in entries]
    assert check(rows_)["ok"]
    bad = [*rows_[:2], (*rows_[2][:5], "tampered", *rows_[2][6:]), *rows_[3:]]
    assert check(bad)["first_bad_seq"] == 2 and check(bad)["reason"] == "entry_hash mismatch"
    assert check(rows_[:3] + rows_[4:])["reason"] == "prev_hash mismatch"
    assert integrity.verify(whole.limit(0)).first()["ok"]


def test_gates(spark):
    table = rows(spark, {"url": "a"}, {"url": "b"}, {"url": "c", "state": "FAILED", "content_hash": None})
    page = lambda *x: spark.createDataFrame(list(x), "url string, path string, body string, content_hash string, tier string")
    from corpusloom.functions.text import normalize

    text = "long enough " * 10
    h = hashlib.sha256(normalize(text).encode()).hexdigest()
    good = page(("a", "a.md", text, h, "LIVING"), ("b", "b.md", text, "sha256:" + h, "LIVING"))
    assert gates.consistency(table, good).first()["passed"] and gates.hashes(good).first()["passed"] and gates.schema_sanity(good).first()["passed"]
    assert not gates.consistency(table, good.limit(1)).first()["passed"] and not gates.consistency(table, good.unionByName(page((None, "z.md", "x", "h", "LIVING")))).first()["passed"]
    assert not gates.hashes(page(("a", "a", "changed", h, "LIVING"))).first()["passed"] and not gates.schema_sanity(page(("a", "a", "short", h, "LIVING"))).first()["passed"]
    assert not gates.schema_sanity(page((None, "a", text, h, "LIVING"))).first()["passed"]
    assert not gates.coverage(table).first()["passed"] and gates.coverage(table, floor=0.5).first()["passed"] and gates.coverage(table.limit(0)).first()["passed"] and not gates.coverage(table, 10_000).first()["passed"]
    c = lambda *x: spark.createDataFrame(list(x), "genesis string, total long")
    ok = lambda p, n: gates.changelog_continuity(p, n).first()["passed"]
    assert ok(c(("x", 0)).limit(0), c(("g", 3))) and ok(c(("g", 3)), c(("g", 5))) and not ok(c(("h", 3)), c(("g", 5))) and not ok(c(("g", 5)), c(("g", 3))) and ok(c(("h", 0)), c(("g", 3)))
    both = gates.all_gates(gates.coverage(table), gates.determinism(table.withColumn("extractor_version", F.lit("E")), spark.createDataFrame([("a", "other", "E", True)], "url string, content_hash string, version string, ok boolean")))
    assert gates.published(both).first().asDict() == {"status": "degraded", "failed": ["coverage"]}


def test_reading(spark):
    pages = spark.createDataFrame([("a/x.md", "one\nTwo\nthree\nTWO", "h"), ("a/b/y.md", "two", "h"), ("z.md", "none", "h")], "path string, body string, content_hash string")
    assert [(r.path, r.line_no) for r in corpus.grep(pages, "two", ignore_case=True).collect()] == [("a/b/y.md", 1), ("a/x.md", 2), ("a/x.md", 4)]
    assert [(r.path, r.line_no) for r in corpus.grep(pages, "two", ignore_case=True, per_file=1).collect()] == [("a/b/y.md", 1), ("a/x.md", 2)]
    hit = corpus.grep_context(pages, "Two", 1).first()
    assert (hit.before, hit.after) == (["one"], ["three"])
    assert [r.path for r in corpus.glob(pages, "a*.md").collect()] == ["a/b/y.md", "a/x.md"] and [r.path for r in corpus.glob(pages, "[!a]*").collect()] == ["z.md"]
    assert [(r.name, r.kind) for r in corpus.list_dir(pages, "a").collect()] == [("b", "dir"), ("x.md", "file")]
    r = corpus.read(pages, "z.md", 1, 2, verify=True).first()
    assert (r.text, r.total, r.more, r.verified) == ("on", 4, True, False)
    rows_, more = corpus.query(spark, "SELECT path FROM p ORDER BY path", 2, p=pages)
    assert rows_.count() == 2 and more
    bad = ("DROP TABLE p", "INSERT INTO p VALUES (1)", "SET x=1", "WITH x AS (SELECT 1) INSERT INTO p SELECT * FROM x", "SELECT * FROM text.`/etc/hosts`", "SELECT (SELECT max(value) FROM text.`/etc/hosts`)", "SELECT * FROM q")
    bad += ("SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT `reflect` /* x */ ('a', 'b')", "SELECT IDENTIFIER('java_' || 'method')('a', 'b')", "SELECT * FROM IDENTIFIER('p')", "SELECT TRANSFORM(path) USING 'cat' FROM p")
    bad += ("SELECT 1" + ", 1" * 60 + ", reflect('a', 'b')", "SELECT sum(1) OVER w FROM p WINDOW w AS (ORDER BY java_method('a', 'b'))", "WITH x AS (SELECT * FROM parquet.`/x`) SELECT * FROM x")
    for text in bad:
        with pytest.raises(ValueError):
            corpus.query(spark, text, p=pages)
    spark.range(3).createOrReplaceTempView("kept")
    assert corpus.query(spark, "WITH x AS (SELECT path FROM p), y AS (SELECT 1) SELECT count(*) AS n FROM x, range(2)", p=pages, kept=pages)[0].first()["n"] == 6
    assert not spark.catalog.tableExists("p") and spark.table("kept").count() == 3
    spark.catalog.dropTempView("kept")
    assert corpus.safe_path("/r", "a/../b") and not corpus.safe_path("/r", "../x")
    d = spark.createDataFrame([("r1", "d1", "s", None, "h1", None, 3, 9), ("r2", "d2", "s", "dom", None, "D", 0, 90_000)], "root string, dirname string, slug string, domain string, first_host string, description string, fresh long, files long")
    assert [(x.slug, x.domain, x.page_count) for x in corpus.describe(d).collect()] == [("s@d1", "h1", 3), ("s@d2", "dom", 50_000)]
    assert corpus.sampled(spark.range(1000).selectExpr("cast(id as string) AS k"), "k", "r", "l", 0.01, 200).count() == 25


def test_small_operators(spark):
    urls = spark.createDataFrame([("https://h/a", "h", "/a"), ("https://h/b/x", "h", "/b/x"), ("https://o/", "o", "/")], "url string, host string, path string")
    rules = spark.createDataFrame([("h", "/", False), ("h", "/b", True)], "host string, pattern string, allow boolean")
    assert {r.url: r.allowed for r in seeds.robots_allowed(urls, rules).collect()} == {"https://h/a": False, "https://h/b/x": True, "https://o/": True}
    page = "<html>" + "".join(f"<a href='/p{i:02d}'>x</a>" for i in range(20)) + "</html>"
    pages = spark.createDataFrame([("https://h/", "r1")], "url string, raw_hash string")
    blobs = spark.createDataFrame([("r1", page)], "raw_hash string, body string")
    none = spark.createDataFrame([], "raw_hash string")
    new, done = seeds.frontier(pages, blobs, pages.select("url"), none, ["h"], 5)
    assert [r.url[-2:] for r in new.collect()] == ["00", "01", "02", "03", "04"] and done.count() == 0
    new, done = seeds.frontier(pages, blobs, pages.select("url"), none, ["h"], 50)
    assert new.count() == 20 and done.count() == 1
    found = seeds.discover_sitemaps(spark.createDataFrame([("https://a",), ("https://b",)], "base string"), spark.createDataFrame([("https://a", "User-agent: *\nSitemap: https://a/s.xml")], "base string, body string")).collect()
    assert [r.url for r in found if r.base == "https://a"] == ["https://a/s.xml"] and sum(r.base == "https://b" for r in found) == 7
    spark.dataSource.register(seeds.SeedSource)
    assert spark.read.format("loom_seeds").option("urls", "https://a https://b").load().count() == 2
    import gzip

    b = spark.createDataFrame([("a.gz", bytearray(gzip.compress(b"x"))), ("b.xml", bytearray(b"y")), ("c.gz", bytearray(b"broken"))], "n string, b binary")
    assert [r.t for r in b.select(seeds.inflate(F.col("n"), F.col("b")).alias("t")).collect()] == ["x", "y", "broken"]
    cells = spark.createDataFrame([("q1", "a", 4.0, None), ("q2", "a", 1.0, None), ("q3", "a", None, "boom")], "qid string, condition string, score double, error string")
    assert [r.qid for r in evals.low_scorers(cells, 2).collect()] == ["q3", "q2"]
    c = spark.createDataFrame([(["https://a/x"], ["https://a/y"]), (["https://a/x"], ["https://a/x"])], "cited array<string>, expected array<string>")
    assert [(r.exact, r.host) for r in evals.citations(c).collect()] == [(False, True), (True, True)]
    runs = spark.createDataFrame([("r", 10, {"plan": 1.0, "fetch": 3.0})], "run_id string, pages long, timings map<string,double>")
    assert {r.stage: (r.share, r.pages_per_second) for r in evals.performance(runs).collect()} == {"plan": (0.25, 2.5), "fetch": (0.75, 2.5)}
    f = spark.createDataFrame([(1, ["a", "b"], True), (2, ["a"], True), (3, [], True), (4, [], False)], "seq long, errors array<string>, known boolean")
    assert [tuple(r) for r in evals.facts_errors(f).collect()] == [("a", 2), ("b", 1)] and tuple(evals.facts_summary(f).first()) == (4, 1, 3, 1)
    facts = spark.createDataFrame([("s", "x", "u1"), ("s", "x", "u2")], "schema string, slug string, url string")
    assert [r.url for r in artifacts.distinct_facts(facts).collect()] == ["u2"]


def test_drift(spark):
    kind = "slug string, status string, fetched long, stages array<struct<stage:string,eval:string,rate:double>>"
    b = spark.createDataFrame([("a", "published", 100, [("x", "y", 0.9)]), ("b", "failed", 10, []), ("gone", "published", 1, [])], kind)
    c = spark.createDataFrame([("a", "failed", 50, [("x", "y", 0.5)]), ("b", "published", 10, []), ("new", "published", 1, [])], kind)
    got = [(r.slug, r.kind, r.severity) for r in evals.drift(b, c).orderBy(*evals.drift_order()).collect()]
    assert got == [("a", "count", "regression"), ("a", "rate:x.y", "regression"), ("a", "status", "regression"), ("b", "status", "improvement"), ("gone", "membership", "info"), ("new", "membership", "info")]
    assert tuple(evals.drift_tally(evals.drift(b, c)).first()) == (3, 1, 2)


def test_robots_rules(spark):
    text = "\ufeff# all\nUser-agent: *\nDisallow: /private # not this\nAllow: /private/open$\n\nUser-agent: other\nUser-agent: loombot\nDisallow: /x\nCrawl-delay: 5\nAllow:\nuser-agent: LOOM\ndisallow: /\n"
    robots = spark.createDataFrame([("a", 200, text), ("b", 503, None), ("c", 404, "User-agent: *\nDisallow: /"), ("d", None, None), ("e", 200, ""), ("f", 429, text)], "host string, status int, body string")
    got = lambda agent: sorted((r.host, r.pattern, r.allow) for r in seeds.robots_rules(robots, agent).collect())
    rest = [("b", "/", False), ("f", "/", False)]
    assert got("unknown/1.0") == [("a", "/private", False), ("a", "/private/open$", True), *rest]
    assert got("LoomBot/2.0") == [("a", "/x", False), *rest] and got("loom") == [("a", "/", False), *rest]
    urls = spark.createDataFrame([(f"{h}{p}", h, p) for h in "abcde" for p in ("/private/z", "/private/open", "/private/open2", "/")], "url string, host string, path string")
    allowed = {r.url: r.allowed for r in seeds.robots_allowed(urls, seeds.robots_rules(robots, "unknown")).collect()}
    assert [allowed[f"a{p}"] for p in ("/private/z", "/private/open", "/private/open2", "/")] == [False, True, False, True]
    assert not any(v for k, v in allowed.items() if k[0] == "b") and all(v for k, v in allowed.items() if k[0] in "cde")


def test_verified_leaves(spark):
    pages = lambda *rows_: spark.createDataFrame(list(rows_), "url string, content_hash string")
    a, b = pages(("u", "1"), ("v", "2")), pages(("u", "1"), ("v", "2"), ("w", "3"))
    root = lambda df: integrity.merkle_root(integrity.leaves(df).select("leaf")).first()["root"]
    assert integrity.verified_leaves([("pages", a), ("manifest", b)], root(a))[0] == "pages" and integrity.verified_leaves([("pages", a), ("manifest", b)], root(b))[0] == "manifest"
    for sources, stored in (([("pages", a)], root(b)), ([("pages", a)], None), ([("pages", pages(("u", "1"), ("u", "2")))], root(pages(("u", "1"), ("u", "2"))))):
        with pytest.raises(ValueError):
            integrity.verified_leaves(sources, stored)


def test_fetch_rules(spark):
    log = [("https://h/a", "x", None, None), ("https://evil/a", "x", None, None), ("https://api/a", "x", None, "https://api/q"), ("https://api/a", "x", None, None), ("", "x", None, None), ("https://h/b", "y" * (fetches.MAX_BODY + 1), None, None), ("https://evil/b", "x", "boom", None)]
    got = fetches.screened(spark.createDataFrame(log, "final_url string, body string, error string, api_url string"), ["H"]).collect()
    assert [r.error for r in got] == [None, "redirect-off-allowlist:evil", None, "redirect-off-allowlist:api", None, f"body-too-large:{fetches.MAX_BODY + 1}>{fetches.MAX_BODY}", "boom"]
    assert [r.body is None for r in got] == [False, True, False, True, False, True, True]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(fetches.wait(F.lit(k))) for k in (0, 1, 4, 9)] == [1.5, 3.0, 24.0, 30.0]
    assert one(fetches.wait(F.lit(0), F.lit("7"))) == 7.0 and one(fetches.wait(F.lit(3), F.lit("soon"))) == 12.0
    tiers = (F.array(F.lit(403), F.lit(429)), F.lit(None).cast("array<int>"), F.array(F.lit(503)))
    assert [one(fetches.escalated(F.lit(s), *tiers)) for s in (200, 403, 503)] == [False, True, True] and not one(fetches.escalated(F.lit(403)))
    events = spark.createDataFrame([([(301, {"ETag": "no"}), (200, {"ETag": "a", "X-Other": "b"}), (304, {"etag": "c", "Last-Modified": "d"}), (500, {"ETag": "e"})],), ([(500, {})],), ([],)], "e array<struct<status:int,headers:map<string,string>>>")
    assert [r.h for r in events.select(fetches.navigation_headers(F.col("e")).alias("h")).collect()] == [{"etag": "c", "last-modified": "d"}, None, None]
    assert {tuple(r) for r in fetches.histogram(spark.createDataFrame([(200,), (404,), (200,), (None,)], "status int")).collect()} == {(200, 2), (404, 1), (None, 1)}


def test_seed_unions_and_questions(spark):
    a, b = (spark.createDataFrame(x, "url string, lastmod string") for x in ([("u", None), ("v", "1")], [("u", "2")]))
    both = seeds.union(a.coalesce(1), b)
    assert [r.url for r in both.orderBy("seq").collect()] == ["u", "v", "u"] and {r.url: r.lastmod for r in seeds.first_seen(both).collect()} == {"u": None, "v": "1"}
    mapped = seeds.mapped_seeds(spark.createDataFrame([('{"links": ["https://h/a", "https://h/?dryrun=1", {"url": "https://h/fc_probe/x"}]}',)], "value string"))
    assert [r.url for r in mapped.collect()] == ["https://h/a"]
    q = spark.createDataFrame([("q1", "a", True), ("q2", "a", False), ("q3", "b", True)], "qid string, use_case string, fresh_sensitive boolean")
    assert [evals.questions(q, **x).count() for x in ({}, {"qid": "q2"}, {"use_case": "a"}, {"fresh": True}, {"use_case": "a", "fresh": True})] == [3, 1, 2, 2, 1]
