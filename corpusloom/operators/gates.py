"""Publish gates: each is a row (gate, passed, blocking, detail) computed over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash
from corpusloom.operators.manifest import INDEXED, TERMINAL

#: What the gates ask for.
COVERAGE, SHORT_CHARS, SHORT_SHARE = 0.99, 50, 0.05
ADVISORY = ("determinism",)


def _gate(rows: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("gate"), passed.alias("passed"), F.lit(name not in ADVISORY).alias("blocking"), detail.alias("detail"))


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def indexed(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("state").isin(*INDEXED) & (F.coalesce("content_hash", F.lit("")) != ""))


def missing(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """Indexed urls without a page."""
    return indexed(manifest).select("url").join(pages.select("url"), "url", "left_anti")


def orphans(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages whose url the manifest does not have; a page without url is one."""
    return pages.select("url", "path").join(manifest.select("url"), "url", "left_anti")


def consistency(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """No indexed url lacks its page and no page lacks its row."""
    both = missing(manifest, pages).select(F.lit("m").alias("k")).union(orphans(manifest, pages).select(F.lit("o")))
    n = both.agg(F.count_if(F.col("k") == "o").alias("o"), F.count_if(F.col("k") == "m").alias("m"))
    return _gate(n, "manifest_fs_integrity", (F.col("o") == 0) & (F.col("m") == 0), _text(F.col("o"), " orphans, ", F.col("m"), " missing"))


def hashes(pages: DataFrame, patterns: tuple = ()) -> DataFrame:
    """Every body still has its content hash."""
    bad = content_hash(F.col("body"), patterns) != F.regexp_replace("content_hash", "^sha256:", "")
    n = pages.agg(F.count_if(bad).alias("bad"), F.count("*").alias("n"))
    return _gate(n, "hash_sample", F.col("bad") == 0, _text(F.col("bad"), " of ", F.col("n"), " differ"))


def determinism(stored: DataFrame, again: DataFrame) -> DataFrame:
    """Extraction anew gives the stored hash; other versions and failures do not count. Advisory."""
    j = stored.select("url", "content_hash", "extractor_version").join(again.select("url", F.col("content_hash").alias("new"), F.col("version"), F.col("ok")), "url")
    same = F.col("ok") & (F.col("version") == F.col("extractor_version"))
    n = j.agg(F.count_if(same & (F.col("new") != F.col("content_hash"))).alias("bad"), F.count_if(same).alias("n"), F.count_if(~same).alias("skipped"))
    return _gate(n, "determinism", F.col("bad") == 0, _text(F.col("bad"), " of ", F.col("n"), " differ, ", F.col("skipped"), " skipped"))


def coverage(manifest: DataFrame, expected: int | None = None, floor: float = COVERAGE) -> DataFrame:
    """Enough of the expected urls are resolved; nothing expected passes."""
    n = manifest.agg(F.count_if(F.col("state").isin(*TERMINAL)).alias("done"), (F.count("*") if expected is None else F.lit(expected).cast("long")).alias("n"))
    return _gate(n, "coverage", F.when(F.col("n") == 0, True).otherwise(F.col("done") / F.col("n") >= floor), _text(F.col("done"), " of ", F.col("n")))


def schema_sanity(pages: DataFrame, share: float = SHORT_SHARE) -> DataFrame:
    """Every page has head, url and hash; few pages that are not frozen are short."""
    hard = F.coalesce("url", F.lit("")).eqNullSafe(F.lit("")) | F.coalesce("content_hash", F.lit("")).eqNullSafe(F.lit(""))
    short = (F.char_length(F.trim("body")) < SHORT_CHARS) & (F.col("tier") != "FROZEN")
    n = pages.agg(F.count_if(hard).alias("hard"), F.count_if(short).alias("short"), F.count("*").alias("n"))
    ok = (F.col("hard") == 0) & ((F.col("n") == 0) | (F.col("short") / F.col("n") <= share))
    return _gate(n, "schema_sanity", ok, _text(F.col("hard"), " incomplete, ", F.col("short"), " short of ", F.col("n")))


def facts_validation(checked: DataFrame) -> DataFrame:
    """Every fact (errors array, known schema) is valid."""
    n = checked.agg(F.count_if(~F.col("known") | (F.size("errors") > 0)).alias("bad"), F.count("*").alias("n"))
    return _gate(n, "facts_validation", F.col("bad") == 0, _text(F.col("bad"), " of ", F.col("n"), " invalid"))


def changelog_continuity(prior: DataFrame, now: DataFrame) -> DataFrame:
    """The chain starts where the last published one did and is no shorter; an empty or missing prior passes."""
    p = prior.agg(F.max("genesis").alias("pg"), F.max("total").alias("pt"))
    n = now.agg(F.max("genesis").alias("g"), F.coalesce(F.max("total"), F.lit(0)).alias("t")).join(F.broadcast(p))
    ok = F.when(F.col("pt").isNull() | (F.col("pt") == 0), True).otherwise(F.col("pg").eqNullSafe(F.col("g")) & (F.col("t") >= F.col("pt")))
    return _gate(n, "changelog_continuity", ok, _text(F.col("t"), " entries, ", F.coalesce("pt", F.lit(0)), " before"))


def filled(fill: DataFrame) -> DataFrame:
    """Forward filling left nothing missing."""
    n = fill.agg(F.count_if("linked").alias("linked"), F.count_if(~F.col("linked")).alias("missing"))
    return _gate(n, "consolidate_md_tree", F.col("missing") == 0, _text(F.col("linked"), " linked, ", F.col("missing"), " missing"))


def all_gates(*gates: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def published(gates: DataFrame) -> DataFrame:
    """One row: the status, and the blocking gates that failed."""
    bad = F.col("blocking") & ~F.col("passed")
    return gates.agg(F.when(F.count_if(bad) == 0, "published").otherwise("degraded").alias("status"), F.array_sort(F.collect_list(F.when(bad, F.col("gate")))).alias("failed"))


def expected_urls(manifest: DataFrame, tiers: list[str] | None = None, limit: int | None = None) -> int:
    """How many urls a run is held to: all, those of its tiers, or its limit if that is less."""
    n = manifest.count() if tiers is None else manifest.where(F.col("tier").isin(tiers)).count()
    return n if limit is None else min(limit, n)
