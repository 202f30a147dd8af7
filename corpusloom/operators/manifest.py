"""The manifest: seeds, refresh decisions, fetch results and commits, all as joins and column expressions over whole tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANIFEST = (
    "url string, tier string, parent_guide string, state string, sitemap_lastmod_seen string, first_seen_at string, last_fetched_at string, last_attempted_at string, "
    "http_status int, http_etag string, http_last_modified string, raw_hash string, content_hash string, last_changed_at string, unchanged_streak int, "
    "crawler_version string, extractor_version string, normalizer_version string, classifier_version string, browser_version string, fail_count int, last_error string"
)
MANIFEST_TYPES = dict(x.split() for x in MANIFEST.split(", "))
COLUMNS = list(MANIFEST_TYPES)
TIERS = ("FROZEN", "CURRENT_FORMS", "LIVING", "NEWS")
DECISIONS = ("FETCH", "FETCH_CONDITIONAL", "SKIP", "TOMBSTONE_PURGE", "SKIPPED_BROWSER_DISABLED")
INDEXED, TERMINAL = ("FRESH", "FROZEN"), ("FRESH", "GONE", "FROZEN", "SKIPPED_BROWSER_DISABLED")


@dataclass(frozen=True)
class Refresh:
    """Days between visits (least and most), days a tombstone lasts, failures before giving up."""

    floor: int
    ceiling: int
    tombstone: int
    failures: int

    def __post_init__(self):
        if self.floor <= 0 or self.ceiling < self.floor:
            raise ValueError("floor must be positive and no more than ceiling")


#: The refresh rhythm of each tier.
RHYTHM = {"NEWS": Refresh(1, 7, 30, 10), "LIVING": Refresh(7, 90, 90, 20), "CURRENT_FORMS": Refresh(14, 180, 180, 20), "FROZEN": Refresh(365, 730, 730, 5)}


@dataclass(frozen=True)
class Versions:
    crawler: str = "v1.0.0"
    extractor: str = "E"
    normalizer: str = "v1"
    classifier: str = "v1"
    browser: str | None = None


@dataclass(frozen=True)
class Config:
    rhythm: dict[str, Refresh] = field(default_factory=lambda: dict(RHYTHM))
    versions: Versions = Versions()


def at(text: Column) -> Column:
    """An ISO time as a timestamp, read as UTC unless it names an offset, whatever the session's zone; null where it cannot be read."""
    plain = F.regexp_replace(F.trim(text), "Z$", "")
    day = plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    return F.try_to_timestamp(F.when(day, F.concat(plain, F.lit("T00:00:00Z"))).when(plain.rlike(r"[T ]\d.*[+-]\d"), plain).otherwise(F.concat(plain, F.lit("Z"))))


def by_tier(tier: Column, config: Config, what: str) -> Column:
    out = F.lit(None).cast("int")
    for name, r in config.rhythm.items():
        out = F.when(tier == name, getattr(r, what)).otherwise(out)
    return out


def interval_days(tier: Column, streak: Column, config: Config = Config()) -> Column:
    """Days to the next visit: the floor doubled for each unchanged visit, up to the ceiling."""
    floor, ceiling = by_tier(tier, config, "floor"), by_tier(tier, config, "ceiling")
    doubled = floor * F.pow(F.lit(2), F.least(F.greatest(streak, F.lit(0)), F.lit(16)))
    return F.greatest(floor, F.least(doubled, ceiling)).cast("int")


def decide(now: Column, lastmod: Column, config: Config = Config(), known: Column | None = None) -> Column:
    """struct(decision, reason) from a manifest row's columns; known says whether there is a row. The first rule that applies decides."""
    c, v, days = F.col, config.versions, interval_days(F.col("tier"), F.col("unchanged_streak"), config)
    known = c("state").isNotNull() if known is None else known
    since = lambda t: now.cast("timestamp").cast("double") - t.cast("double")
    attempt = F.coalesce(at(c("last_attempted_at")), at(c("first_seen_at")))
    buried = attempt.isNotNull() & (since(attempt) < by_tier(c("tier"), config, "tombstone") * 86400)
    fetched, modified = at(c("last_fetched_at")), at(lastmod)
    say = lambda decision, reason: F.struct(F.lit(decision).alias("decision"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    gone, failed = c("state") == "GONE", c("state") == "FAILED"
    frozen = (c("tier") == "FROZEN") & (F.coalesce(c("content_hash"), F.lit("")) != "") & ~failed
    current = c("extractor_version").eqNullSafe(F.lit(v.extractor)) & c("normalizer_version").eqNullSafe(F.lit(v.normalizer))
    return (
        F.when(~known, say("FETCH", "unseen"))
        .when(gone & buried & (modified > attempt), say("FETCH", "gone-but-resurrected-in-sitemap"))
        .when(gone & buried, say("SKIP", "tombstoned"))
        .when(gone, say("TOMBSTONE_PURGE", "tombstone-ttl-expired"))
        .when(frozen & current, say("SKIP", "frozen-current-versions"))
        .when(frozen, say("SKIP", "frozen-extract-will-redrive"))
        .when(failed & (c("fail_count") < by_tier(c("tier"), config, "failures")), say("FETCH", F.concat(F.lit("retry-fail-count-"), c("fail_count").cast("string"))))
        .when(failed, say("SKIP", "failure-budget-exhausted"))
        .when(fetched.isNull(), say("FETCH", "never-fetched"))
        .when(modified > fetched, say("FETCH_CONDITIONAL", "sitemap-lastmod-after-last-fetch"))
        .when(since(fetched) < days * 86400, say("SKIP", F.concat(F.lit("within-interval-"), days.cast("string"), F.lit("d"))))
        .otherwise(say("FETCH_CONDITIONAL", "interval-elapsed"))
    )


def upsert_seeds(manifest: DataFrame, seeds: DataFrame, now: str, config: Config = Config()) -> DataFrame:
    """The manifest after seeds (seq, url, tier, parent_guide, lastmod), with an action: inserted, reclassified or noop.

    Seeds of one url collapse in their order first: the last classification counts; an inserted url gets the greatest
    lastmod, a reclassified one the greatest of the later ones and of the first or the stored one.
    """
    s = seeds.groupBy("url").agg(
        F.max_by(F.struct("tier", "parent_guide"), "seq").alias("s"), F.min_by("lastmod", "seq").alias("first_mod"), F.max("lastmod").alias("most_mod"), F.count("*").alias("n")
    )
    later = seeds.join(seeds.groupBy("url").agg(F.min("seq").alias("seq")), ["url", "seq"], "left_anti").groupBy("url").agg(F.max("lastmod").alias("later_mod"))
    s = s.join(later, "url", "left")
    m = manifest.withColumn("_known", F.lit(True))
    j = m.join(s.withColumn("_seeded", F.lit(True)), "url", "full")
    known, seeded = F.coalesce("_known", F.lit(False)), F.coalesce("_seeded", F.lit(False))
    moved = known & seeded & (~F.col("classifier_version").eqNullSafe(F.lit(config.versions.classifier)) | ~F.col("tier").eqNullSafe(F.col("s.tier")))
    stored = F.col("sitemap_lastmod_seen")
    mod = F.when(~known, F.col("most_mod")).when(moved, F.greatest(F.coalesce("first_mod", stored), F.col("later_mod"))).when(seeded, F.greatest(stored, F.col("most_mod"))).otherwise(stored)
    fresh = {
        "tier": F.when(~known | moved, F.col("s.tier")).otherwise(F.col("tier")),
        "parent_guide": F.when(~known | moved, F.col("s.parent_guide")).otherwise(F.col("parent_guide")),
        "classifier_version": F.when(~known | moved, F.lit(config.versions.classifier)).otherwise(F.col("classifier_version")),
        "sitemap_lastmod_seen": mod,
        "state": F.when(~known, "UNSEEN").otherwise(F.col("state")),
        "first_seen_at": F.when(~known, F.lit(now)).otherwise(F.col("first_seen_at")),
        "unchanged_streak": F.coalesce("unchanged_streak", F.lit(0)),
        "fail_count": F.coalesce("fail_count", F.lit(0)),
    }
    action = F.when(~known, "inserted").when(moved, "reclassified").when(seeded, "noop")
    return j.select(*(fresh.get(c, F.col(c)).alias(c) for c in COLUMNS), action.alias("action"))


def plan(manifest: DataFrame, now: Column, lastmods: DataFrame | None = None, only: DataFrame | None = None, browser_enabled: bool = True, needs_browser: Column | None = None, config: Config = Config()) -> DataFrame:
    """One decision per url (of only, if given). A lastmod of the map counts even if it is null; without one the stored value counts."""
    rows = manifest if only is None else manifest.join(only.select("url").distinct(), "url", "left_semi")
    if lastmods is not None:
        given = lastmods.groupBy("url").agg(F.max("lastmod").alias("_mod")).withColumn("_given", F.lit(True))
        rows = rows.join(given, "url", "left").withColumn("_lastmod", F.when(F.col("_given"), F.col("_mod")).otherwise(F.col("sitemap_lastmod_seen")))
    else:
        rows = rows.withColumn("_lastmod", F.col("sitemap_lastmod_seen"))
    d = decide(now, F.col("_lastmod"), config)
    browser = config.versions.browser
    moved = F.lit(False) if browser is None else (F.col("browser_version").isNotNull() & (F.col("browser_version") != browser))
    routed = F.lit(False) if needs_browser is None or browser_enabled else needs_browser
    rows = rows.withColumn("d", F.when(routed, F.struct(F.lit("SKIPPED_BROWSER_DISABLED").alias("decision"), F.lit("requires-browser-but-disabled").alias("reason"))).otherwise(d))
    redo = (F.col("d.decision") == "SKIP") & moved
    return rows.select(
        "url", "tier", "parent_guide",
        F.when(redo, "FETCH_CONDITIONAL").otherwise(F.col("d.decision")).alias("decision"),
        F.when(redo, "browser-version-changed").otherwise(F.col("d.reason")).alias("reason"),
        F.col("http_etag").alias("etag"), F.col("http_last_modified").alias("last_modified"), F.col("_lastmod").alias("sitemap_lastmod"),
    )


def plan_counters(planned: DataFrame) -> DataFrame:
    """Decisions by kind and by tier in one pass: dimension, key, n. Every known kind and tier has a row."""
    kinds = planned.groupingSets([[F.col("decision")], [F.col("tier")]], "decision", "tier").agg(F.count("*").alias("n"), F.grouping("decision").alias("g"))
    found = kinds.select(F.when(F.col("g") == 0, "decision").otherwise("tier").alias("dimension"), F.when(F.col("g") == 0, F.col("decision")).otherwise(F.col("tier")).alias("key"), "n")
    every = planned.sparkSession.createDataFrame([("decision", x) for x in DECISIONS] + [("tier", x) for x in TIERS], "dimension string, key string")
    return found.join(F.broadcast(every), ["dimension", "key"], "full").select("dimension", "key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def fetchable(planned: DataFrame, tiers: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """What to fetch, in url order if limited."""
    rows = planned.where(F.col("decision").isin("FETCH", "FETCH_CONDITIONAL"))
    rows = rows if tiers is None else rows.where(F.col("tier").isin(tiers))
    return rows if limit is None else rows.orderBy("url").limit(limit)


def remaining(planned: DataFrame, log: DataFrame) -> DataFrame:
    """Planned urls that the log does not have yet: what a resumed run still does."""
    return planned.join(log.select("url"), "url", "left_anti")


def purge(manifest: DataFrame, planned: DataFrame) -> DataFrame:
    """The manifest without what is planned to be purged."""
    return manifest.join(planned.where("decision = 'TOMBSTONE_PURGE'").select("url"), "url", "left_anti")


def last_per_url(log: DataFrame) -> DataFrame:
    """The last entry of each url by seq."""
    return log.groupBy("url").agg(F.max_by(F.struct(*[c for c in log.columns if c != "url"]), "seq").alias("r")).select("url", "r.*")


def _applied(c, f, now: str, v: Versions) -> tuple[dict[str, Column], Column]:
    """What one result f(...) makes of a manifest row c(...): its new columns, and the kind of change (null: none)."""
    worked = f("error").isNull() & (f("status") < 400) & (f("status") != 304)
    error = F.when(worked & (f("ok") == F.lit(False)), f("reason")).otherwise(f("error"))
    bad, gone, same = error.isNotNull(), f("status").isin(404, 410), f("status") == 304
    case = F.when(bad, "error").when(gone, "gone").when(same, "same").otherwise("new")
    is_ = lambda *names: case.isin(*names)
    hash_ = F.when(is_("new"), f("content_hash"))
    changed = hash_.isNotNull() & ~hash_.eqNullSafe(c("content_hash"))
    new = {
        "last_attempted_at": F.lit(now),
        "last_fetched_at": F.when(is_("gone", "same", "new"), F.lit(now)).otherwise(c("last_fetched_at")),
        "http_status": f("status"),
        "http_etag": F.when(is_("same"), F.coalesce(f("etag"), c("http_etag"))).when(is_("new"), f("etag")).otherwise(c("http_etag")),
        "http_last_modified": F.when(is_("same"), F.coalesce(f("last_modified"), c("http_last_modified"))).when(is_("new"), f("last_modified")).otherwise(c("http_last_modified")),
        "raw_hash": F.when(is_("new"), f("raw_hash")).otherwise(c("raw_hash")),
        "content_hash": F.coalesce(hash_, c("content_hash")),
        "last_changed_at": F.when(is_("new") & (changed | c("content_hash").isNull()), F.lit(now)).otherwise(c("last_changed_at")),
        "unchanged_streak": F.when(is_("same") | (is_("new") & ~changed), c("unchanged_streak") + 1).when(is_("new"), 0).otherwise(c("unchanged_streak")),
        "fail_count": F.when(is_("error"), c("fail_count") + 1).when(is_("same", "new"), 0).otherwise(c("fail_count")),
        "last_error": F.when(is_("error"), error),
        "state": F.when(is_("error"), "FAILED").when(is_("gone"), "GONE").otherwise("FRESH"),
        "crawler_version": F.lit(v.crawler),
        "extractor_version": F.when(is_("new"), F.coalesce(f("extractor_version"), c("extractor_version"))).otherwise(c("extractor_version")),
        "normalizer_version": F.when(is_("new"), F.coalesce(f("normalizer_version"), c("normalizer_version"))).otherwise(c("normalizer_version")),
        "browser_version": F.coalesce(f("browser_version"), c("browser_version")),
    }
    kind = F.when(is_("gone") & ~c("state").eqNullSafe(F.lit("GONE")), "gone").when(is_("new") & changed, F.when(c("content_hash").isNull(), "added").otherwise("changed"))
    return new, kind


_RESULT = "seq long, status int, etag string, last_modified string, raw_hash string, error string, browser_version string, content_hash string, ok boolean, reason string, extractor_version string, normalizer_version string"
_CHANGE = "seq long, change_type string, old_hash string, new_hash string"


def results(fetch_log: DataFrame, extract_log: DataFrame) -> DataFrame:
    """url and results: those of the log in its order (seq), each with the last extraction of the url."""
    e = last_per_url(extract_log).select("url", F.struct("content_hash", "ok", "reason", "extractor_version", "normalizer_version").alias("x"))
    columns = [x.split()[0] for x in _RESULT.split(", ")]
    there = ("seq", "status", "etag", "last_modified", "raw_hash", "error", "browser_version")
    rows = fetch_log.join(e, "url", "left").select("url", F.struct(*(F.col(c if c in there else f"x.{c}").alias(c) for c in columns)).cast(f"struct<{_RESULT.replace(' ', ':').replace(',:', ',')}>").alias("r"))
    return rows.groupBy("url").agg(F.array_sort(F.collect_list("r")).alias("results"))


def commit(manifest: DataFrame, fetch_log: DataFrame, extract_log: DataFrame, now: str, run_id: str, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(the manifest after the log, the new change log rows in log order, unchained).

    Every result of a url is applied, in the order of seq, to what the one before left. An extraction that failed on a fetch that worked is
    an error. Results of unknown urls change nothing. One row holds a url's results of one run, which are its retries.
    """
    j = manifest.join(results(fetch_log, extract_log), "url", "left")
    none = F.array().cast(f"array<struct<{_CHANGE.replace(' ', ':').replace(',:', ',')}>>")
    start = F.struct(*(F.col(c).alias(c) for c in COLUMNS), none.alias("log"))

    def step(s: Column, r: Column) -> Column:
        new, kind = _applied(lambda x: s[x], lambda x: r[x], now, config.versions)
        entry = F.struct(r["seq"].alias("seq"), kind.alias("change_type"), s["content_hash"].alias("old_hash"), F.when(kind != "gone", r["content_hash"]).alias("new_hash"))
        log = F.when(kind.isNull(), s["log"]).otherwise(F.concat(s["log"], F.array(entry)))
        return F.struct(*(new.get(c, s[c]).cast(MANIFEST_TYPES[c]).alias(c) for c in COLUMNS), log.alias("log"))

    done = j.select(F.when(F.col("results").isNull(), start).otherwise(F.aggregate("results", start, step)).alias("s"))
    after = done.select(*(F.col(f"s.{c}") for c in COLUMNS))
    log = done.select("s.url", "s.tier", F.explode("s.log").alias("e"))
    return after, log.select("e.seq", F.lit(now).alias("ts"), "url", "e.change_type", "e.old_hash", "e.new_hash", F.lit(run_id).alias("run_id"), "tier")


def commit_counters(manifest: DataFrame, fetch_log: DataFrame, extract_log: DataFrame) -> DataFrame:
    """applied, errors, not_modified, gone, fresh of all results of a log, and the changes by kind that they make."""
    _, log = commit(manifest, fetch_log, extract_log, "", "")
    made = log.agg(*(F.count_if(F.col("change_type") == k).alias(f"changelog_{k}") for k in ("added", "changed", "gone")))
    r = results(fetch_log, extract_log).join(manifest.select("url"), "url", "left_semi").select(F.explode("results").alias("r")).select("r.*")
    bad = F.col("error").isNotNull() | ((F.col("status") < 400) & (F.col("status") != 304) & (F.col("ok") == F.lit(False)))
    counted = r.agg(
        F.count("*").alias("applied"), F.count_if(bad).alias("errors"), F.count_if(~bad & (F.col("status") == 304)).alias("not_modified"),
        F.count_if(~bad & F.col("status").isin(404, 410)).alias("gone"), F.count_if(~bad & ~F.col("status").isin(304, 404, 410)).alias("fresh"),
    )
    return counted.join(F.broadcast(made))


def counts(manifest: DataFrame) -> DataFrame:
    """Rows by state and by tier: dimension, key, n."""
    one = manifest.groupingSets([[F.col("state")], [F.col("tier")]], "state", "tier").agg(F.count("*").alias("n"), F.grouping("state").alias("g"))
    return one.select(F.when(F.col("g") == 0, "state").otherwise("tier").alias("dimension"), F.when(F.col("g") == 0, F.col("state")).otherwise(F.col("tier")).alias("key"), "n")


def coverage(manifest: DataFrame, expected: Column | None = None) -> DataFrame:
    """Shares of the expected urls that are indexed and resolved, to four places; null of none."""
    indexed = F.count_if(F.col("state").isin(*INDEXED) & (F.coalesce("content_hash", F.lit("")) != ""))
    resolved, total = F.count_if(F.col("state").isin(*TERMINAL)), F.count("*") if expected is None else F.max(expected)
    share = lambda n: F.when(total > 0, F.bround(n / total, 4))
    return manifest.agg(indexed.alias("indexed"), resolved.alias("resolved"), total.alias("expected"), share(indexed).alias("indexed_share"), share(resolved).alias("resolved_share"))


def host_floor(attempts: DataFrame, blocks: int = 3) -> DataFrame:
    """For each host (host, seq, blocked) whether so many blocked attempts came without a success between: a latched host stays latched."""
    w = W.partitionBy("host").orderBy("seq")
    ok_before = F.sum(F.when(F.col("blocked"), 0).otherwise(1)).over(w)
    runs = attempts.withColumn("run", ok_before).groupBy("host", "run").agg(F.count_if("blocked").alias("n"))
    return runs.groupBy("host").agg((F.max("n") >= blocks).alias("latched"), F.max("n").alias("longest"))


def credits(calls: DataFrame, cap: int) -> DataFrame:
    """Paid calls (account, seq, cost, refunded) in order against a budget: spent before each call and whether it was let through.

    A call is let through if what was spent leaves room for its cost; only such a call, and if it is not refunded, is charged. Each
    call depends on the one before, so an account's calls stream through one task in their order, with one number kept.
    """

    def run(batches):
        import pyarrow as pa

        at, total = object(), 0
        for b in batches:
            spent, allowed = [], []
            for account, cost, refunded in zip(*(b.column(c).to_pylist() for c in ("account", "cost", "refunded")), strict=True):
                if account != at:
                    at, total = account, 0
                spent.append(total)
                allowed.append(total + (cost or 0) <= cap)
                total += (cost or 0) if allowed[-1] and not refunded else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spent, pa.int64()), pa.array(allowed, pa.bool_())], [*b.schema.names, "spent", "allowed"])

    shape = calls.withColumn("spent", F.lit(0).cast("long")).withColumn("allowed", F.lit(True)).schema
    return calls.repartition("account").sortWithinPartitions("account", "seq").mapInArrow(run, shape)


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Of the attempts (url, tier_rank, thin, status, ...) that pass the gate the one of the cheapest transport."""
    good = attempts.where((F.col("status") < 400) & ~F.col("thin"))
    return good.groupBy("url").agg(F.min_by(F.struct(*[c for c in attempts.columns if c != "url"]), "tier_rank").alias("r")).select("url", "r.*")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MANIFEST)
