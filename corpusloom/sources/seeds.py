"""Seed sources: JSON lists, sitemaps, link maps, url files and the link frontier, as (url, lastmod) rows."""

from __future__ import annotations

import gzip
import warnings
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from corpusloom.functions._udf import vectorized
from corpusloom.functions.html import links
from corpusloom.functions.urls import allowed, canonical_url, excluded, host_of, malformed

SEED = "url string, lastmod string"
MAX_SITEMAPS, MAX_URLS = 2000, 500_000
#: Where sitemaps are usually found.
WELL_KNOWN = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap.xml.gz", "/sitemaps.xml", "/sitemap/sitemap.xml", "/sitemap1.xml")
_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"


def seeds_of_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """Seeds of JSON texts: {"links": [...]}, {"data": {"links": [...]}} or a bare list, of strings or of {url, lastmod or last_modified}. Blank urls go."""
    v = F.try_parse_json(F.col(column))
    items = F.coalesce(F.try_variant_get(v, "$.links", "array<variant>"), F.try_variant_get(v, "$.data.links", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    rows = texts.select(F.posexplode(items).alias("pos", "x"))
    text = lambda path: F.try_variant_get("x", path, "string")
    bare = F.when(F.schema_of_variant("x") == "STRING", text("$"))
    return rows.select(F.trim(F.coalesce(text("$.url"), bare)).alias("url"), F.coalesce(text("$.lastmod"), text("$.last_modified")).alias("lastmod")).where("coalesce(url, '') <> ''")


#: What marks probes of a map service among its links.
PROBES = ("fc_probe", "dryrun=", "pool_concurrency", "fc_fetch")


def mapped_seeds(texts: DataFrame, column: str = "value") -> DataFrame:
    """Seeds of a map service's answers: its links without its own probes."""
    probe = reduce(Column.__or__, (F.contains("url", F.lit(p)) for p in PROBES))
    return seeds_of_json(texts, column).where(~probe)


def union(*sources: DataFrame) -> DataFrame:
    """All seeds of several sources, as often as they come, in their order: seq, url, lastmod."""
    rows = [s.select(F.lit(i).alias("source"), "url", "lastmod").withColumn("row", F.monotonically_increasing_id()) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, rows).select(F.struct("source", "row").alias("seq"), "url", "lastmod")


def json_seeds(spark: SparkSession, path: str) -> DataFrame:
    return seeds_of_json(spark.read.text(path, wholetext=True))


@vectorized("string")
def inflate(name: pd.Series, body: pd.Series) -> pd.Series:
    """Text of a body that is compressed by its name or its first bytes; a broken archive is taken as it is."""

    def one(n, b):
        if b is None:
            return None
        if b[:2] == b"\x1f\x8b" or (n or "").endswith(".gz"):
            try:
                b = gzip.decompress(b)
            except (OSError, EOFError):
                pass
        return bytes(b).decode("utf-8", "replace")

    return pd.Series([one(*x) for x in zip(name, body, strict=True)])


@vectorized("array<struct<kind:string,loc:string,lastmod:string>>")
def sitemap_entries(body: pd.Series) -> pd.Series:
    """The entries of a sitemap (kind url) or of a sitemap index (kind sitemap); of any other text its http lines."""
    import xml.etree.ElementTree as E

    def one(text):
        text = (text or "").lstrip("﻿").strip()
        try:
            root = E.fromstring(text)
        except E.ParseError:
            root = None
        for kind, top in (("url", "urlset"), ("sitemap", "sitemapindex")):
            if root is not None and root.tag == f"{{{_NS}}}{top}":
                out = []
                for e in root.findall(f"{{{_NS}}}{kind}"):
                    loc, mod = ((e.findtext(f"{{{_NS}}}{k}") or "").strip() for k in ("loc", "lastmod"))
                    if loc:
                        out.append((kind, loc, mod or None))
                return out
        return [("url", x.strip(), None) for x in text.splitlines() if x.strip().startswith(("http://", "https://"))]

    return body.map(one)


def walk_sitemaps(sitemaps: DataFrame, roots: DataFrame, max_sitemaps: int = MAX_SITEMAPS, max_urls: int = MAX_URLS) -> DataFrame:
    """The urls reached from root sitemaps (url) through a table of sitemap bodies (url, body), each sitemap once.

    One join a level of nesting, to any depth. Sitemaps are taken level by level, roots by url, the others in the order in which they are
    named; the walk takes max_sitemaps of them and the first max_urls of their urls, and warns where either cuts it.
    """
    spark = sitemaps.sparkSession
    parsed = sitemaps.select("url", F.posexplode(sitemap_entries(F.col("body"))).alias("pos", "e")).select("url", "pos", "e.*").persist()
    order = F.row_number().over(W.orderBy("first"))  # at most max_sitemaps rows and those after them in one level
    level = roots.select("url").distinct().withColumn("first", F.struct(F.lit(0).alias("place"), F.lit(0).alias("pos"), "url"))
    seen, found, n = spark.createDataFrame([], "url string"), [], 0
    while n < max_sitemaps:
        taken = level.orderBy("first").limit(max_sitemaps - n).select("url", (order + n).alias("place")).persist()
        size = taken.count()
        if not size:
            break
        rest = n + size == max_sitemaps and level.count() > size
        n, seen = n + size, seen.union(taken.select("url"))
        here = parsed.join(taken, "url")
        found.append(here.where("kind = 'url'").select("place", "pos", F.col("loc").alias("url"), "lastmod"))
        children = here.where("kind = 'sitemap'").groupBy(F.col("loc").alias("url")).agg(F.min(F.struct("place", "pos", F.col("loc").alias("url"))).alias("first"))
        level = children.join(seen, "url", "left_anti").persist()
        if rest or (n == max_sitemaps and not level.isEmpty()):
            warnings.warn(f"the walk stopped at {max_sitemaps} sitemaps", stacklevel=2)
    rows = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "place int, pos int, url string, lastmod string")
    rows = rows.persist()
    if rows.count() > max_urls:
        warnings.warn(f"the walk stopped at {max_urls} urls", stacklevel=2)
        rows = rows.orderBy("place", "pos").limit(max_urls)
    return rows.select("url", "lastmod")


def discover_sitemaps(bases: DataFrame, robots: DataFrame) -> DataFrame:
    """Candidate sitemaps of each base (base): those its robots text (base, body) names, or else the well-known places; with their order."""
    named = robots.select("base", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))).alias("pos", "url"))
    rest = bases.join(named.select("base").distinct(), "base", "left_anti")
    usual = rest.select("base", F.posexplode(F.array(*map(F.lit, WELL_KNOWN))).alias("pos", "p")).select("base", "pos", F.concat("base", "p").alias("url"))
    return named.unionByName(usual)


def first_seen(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Each url once, as it first came."""
    return rows.groupBy("url").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "url"]), order).alias("r")).select("url", "r.*")


def url_file(spark: SparkSession, path: str) -> DataFrame:
    """Urls of a text file, a line each; blank lines and # lines go."""
    t = F.trim("value")
    return spark.read.text(path).where((t != "") & ~t.startswith("#")).select(canonical_url(t).alias("url"))


def screen(seeds: DataFrame, hosts: list[str], excludes: tuple[str, ...], robots_ok: Column | None = None) -> DataFrame:
    """Seeds with the first reason to skip each: malformed, host, exclude, robots; null for those that stay."""
    url = F.col("url")
    ok = F.lit(True) if robots_ok is None else robots_ok
    reason = F.when(malformed(url), "malformed").when(~allowed(url, hosts) if hosts else F.lit(False), "host").when(excluded(url, excludes), "exclude").when(~ok, "robots")
    return seeds.withColumn("url", canonical_url(url)).withColumn("skip", reason)


def seed_counters(screened: DataFrame) -> DataFrame:
    return screened.groupBy(F.coalesce("skip", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@vectorized("array<struct<pattern:string,allow:boolean>>")
def _robots_rules(body: pd.Series, agent: pd.Series) -> pd.Series:
    def one(text: str | None, agent: str) -> list[tuple[str, bool]]:
        groups: dict[str, list[tuple[str, bool]]] = {}
        named: list[str] = []
        open_ = False  # user-agent lines that follow each other share their rules
        for line in (text or "").lstrip("\ufeff").splitlines():
            key, colon, value = line.split("#", 1)[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if key == "user-agent" and colon:
                named = [*(named if open_ else []), value.lower()]
                open_ = True
                groups.setdefault(value.lower(), [])
            elif key in ("allow", "disallow") and colon:
                open_ = False
                for name in named if value else ():
                    groups[name].append((value, key == "allow"))
        mine = max((g for g in groups if g != "*" and g and agent.lower().startswith(g)), key=len, default="*")
        return groups.get(mine, [])

    return pd.Series([one(*x) for x in zip(body, agent, strict=True)], dtype=object)


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """The rules (host, pattern, allow) for a user agent, from fetched robots texts (host, status, body): those of the group with the
    longest name that the agent starts with, or else of *. A host that answers 429 or 5xx allows nothing, any other without 200 everything.
    """
    meant = robots.withColumn("meant", robots_status(F.col("status")))
    nothing = F.array(F.struct(F.lit("/").alias("pattern"), F.lit(False).alias("allow")))
    rules = F.when(F.col("meant") == "disallow", nothing).when(F.col("meant") == "parse", _robots_rules(F.col("body"), F.lit(agent)))
    return meant.select("host", F.explode(rules).alias("r")).select("host", "r.pattern", "r.allow")


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether robots rules (host, pattern, allow) let each url (url, host, path) be fetched: the longest match counts, allow wins ties; no match allows.

    Rules of one host are few; urls meet them by host.
    """
    like = F.regexp_replace(F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\$])", r"\\$1"), r"\*", ".*")
    like = F.regexp_replace(like, r"\\\$$", "\\$")  # at its end a dollar sign is the end of the path
    hit = F.expr("path rlike concat('^', like)")
    j = urls.join(rules.withColumn("like", like).withColumnRenamed("host", "rule_host"), (F.col("host") == F.col("rule_host")) & hit, "left")
    return j.groupBy("url").agg(F.coalesce(F.max_by("allow", F.struct(F.length("pattern"), "allow")), F.lit(True)).alias("allowed"))


def robots_status(status: Column) -> Column:
    """What a robots fetch means: parse its rules, disallow everything, or allow everything."""
    return F.when(status == 200, "parse").when((status == 429) | (status >= 500), "disallow").otherwise("allow")


def frontier(pages: DataFrame, blobs: DataFrame, manifest: DataFrame, drained: DataFrame, hosts: list[str] | DataFrame, max_urls: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(new urls linked from pages, the blobs that are drained by this pass).

    hosts are a list, or a table (host) of any size. pages (url, raw_hash) are read in url order, the links of a page in order; the first max_urls new ones are taken. A
    blob counts as drained only if none of its links was cut off.
    """
    todo = pages.join(drained.select("raw_hash"), "raw_hash", "left_anti").join(blobs, "raw_hash")
    named = F.lit(None).cast("string") if isinstance(hosts, DataFrame) else F.lit(",".join(h.lower() for h in hosts))
    found = todo.select("raw_hash", F.col("url").alias("page"), F.posexplode(links(F.col("body"), F.col("url"), named)).alias("pos", "url"))
    if isinstance(hosts, DataFrame):
        found = found.withColumn("host", host_of("url")).join(hosts.select(F.lower("host").alias("host")), "host", "left_semi").drop("host")
    new = found.join(manifest.select("url"), "url", "left_anti")
    first = new.groupBy("url").agg(F.min(F.struct("page", "pos")).alias("at"))
    taken = first.orderBy("at").limit(max_urls)
    cut = new.join(taken.select("url"), "url", "left_anti").select("raw_hash").distinct()
    return taken.select("url"), todo.select("raw_hash").distinct().join(cut, "raw_hash", "left_anti")


class SeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split() if u]

    def read(self, partition):
        for u in self.urls:
            yield u, None


class SeedSource(DataSource):
    """A plug-in source of seeds: spark.read.format("loom_seeds").option("urls", "https://a https://b")."""

    @classmethod
    def name(cls) -> str:
        return "loom_seeds"

    def schema(self) -> str:
        return SEED

    def reader(self, schema) -> SeedReader:
        return SeedReader(self.options)
