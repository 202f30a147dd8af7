"""The build: seeds and recorded responses in, a published snapshot out. Every phase is a function of tables; phases are written and read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.facts import FACTS_VERSION, checked, looks_like_rates, payload, rate_facts
from corpusloom.functions.html import extractor
from corpusloom.functions.profiles import GENERIC, Profile
from corpusloom.functions.text import admitted, front_matter, normalizer_version
from corpusloom.functions.urls import md_path
from corpusloom.operators import artifacts, changes, corpus, gates, integrity
from corpusloom.operators import manifest as m
from corpusloom.shipping import ship
from corpusloom.sources import storage


def extract(log: DataFrame, blobs: DataFrame, manifest: DataFrame, profile: Profile = GENERIC) -> DataFrame:
    """The extract log with the pages' markdown. The cheap rules come first; only what is left is parsed.

    Each row of the log gives one row, also where the manifest repeats a url: what any of its rows knows is unchanged.
    """
    version = normalizer_version(profile.dynamic)
    known = manifest.groupBy("url").agg(F.sort_array(F.collect_set(F.struct("raw_hash", "content_hash", "extractor_version", "normalizer_version"))).alias("known"))
    j = log.join(blobs.select("raw_hash", "body"), "raw_hash", "left").join(known, "url", "left")
    kind = profile.body_kind(F.col("body"), F.col("url"), F.col("content_type"))
    j = j.withColumn("kind", kind).withColumn("version", F.concat(F.lit("loom-html-1-"), "kind"))
    alike = lambda k: (k["raw_hash"] == F.col("raw_hash")) & (k["extractor_version"] == F.col("version")) & (k["normalizer_version"] == version) & (F.coalesce(k["content_hash"], F.lit("")) != "")
    j = j.withColumn("same", F.get(F.filter("known", alike), 0)).withColumn("old_extractor", F.coalesce("same.extractor_version", F.get("known", 0)["extractor_version"]))
    skip = (
        F.when(F.col("status") == 304, "304")
        .when(F.col("error").isNotNull() | (F.col("status") >= 400), F.concat(F.lit("http-"), F.coalesce(F.col("status").cast("string"), F.lit("error"))))
        .when(F.col("raw_hash").isNull() | F.col("body").isNull(), "no-raw-hash")
        .when(F.col("same").isNotNull(), "unchanged-raw")
    )
    j = j.withColumn("skip", skip)
    done = j.where("skip IS NOT NULL").select(
        "url", "raw_hash", F.when(F.col("skip") == "unchanged-raw", F.col("same.content_hash")).alias("content_hash"), F.lit(None).cast("string").alias("title"), F.lit(0).alias("n_chars"),
        F.col("old_extractor").alias("extractor_version"), F.lit(version).alias("normalizer_version"), F.col("skip").isin("304", "unchanged-raw").alias("ok"), F.col("skip").alias("reason"), "seq",
        F.lit(None).cast("string").alias("md"), F.lit(None).cast("array<string>").alias("anchors"),
    )
    run = extractor(profile.dynamic, profile.strategies, profile.enrichers)
    todo = j.where("skip IS NULL").withColumn("x", run(F.col("body"), F.col("kind")))
    fine = ~F.col("x.ok") | admitted(F.col("body"), F.col("x.md"), F.col("content_type"))
    keep = lambda c: F.when(fine, F.col(f"x.{c}"))
    new = todo.select(
        "url", "raw_hash", keep("content_hash").alias("content_hash"), keep("title").alias("title"), F.coalesce(F.char_length(keep("md")), F.lit(0)).alias("n_chars"),
        F.col("x.version").alias("extractor_version"), F.lit(version).alias("normalizer_version"), (F.col("x.ok") & fine).alias("ok"),
        F.when(fine, F.col("x.reason")).otherwise("admission-challenge-page").alias("reason"), "seq", keep("md").alias("md"), keep("anchors").alias("anchors"),
    )
    return done.unionByName(new)


def re_extract(manifest: DataFrame, blobs: DataFrame, now: str, profile: Profile = GENERIC, tiers: list[str] | None = None, frozen: bool = True) -> tuple[DataFrame, DataFrame]:
    """(a fetch log as if every stored body had just been fetched, its extract log): what a new extractor makes of what is there."""
    rows = manifest.where(F.col("state").isin("FRESH", *(["FROZEN"] if frozen else [])) & F.col("raw_hash").isNotNull())
    rows = rows if tiers is None else rows.where(F.col("tier").isin(tiers))
    log = rows.select(
        "url", F.lit("FETCH").alias("decision"), F.lit(200).alias("status"), F.col("http_etag").alias("etag"), F.col("http_last_modified").alias("last_modified"), "raw_hash", F.lit(0).cast("long").alias("raw_bytes"),
        F.lit(now).alias("fetched_at"), F.lit(None).cast("string").alias("error"), "browser_version", F.lit(None).cast("string").alias("content_type"), F.xxhash64("url").alias("seq"),
    )
    return log, extract(log, blobs, manifest.withColumn("raw_hash", F.lit(None).cast("string")), profile)


def pages(manifest: DataFrame, extracted: DataFrame, profile: Profile = GENERIC) -> DataFrame:
    """Page rows with their front matter and rendered text."""
    x = extracted.where("md IS NOT NULL").select("url", "title", "md", "anchors")
    j = manifest.join(x, "url")
    j = j.withColumn("audience", profile.audience(F.col("url"))).withColumn("fy_years", profile.fy_years(F.col("url"))).withColumn("md_path", md_path(F.col("url")))
    row = {c: F.col(c) for c in ("url", "title", "raw_hash", "content_hash", "crawler_version", "extractor_version", "normalizer_version", "tier", "parent_guide", "audience", "fy_years", "anchors", "http_status")}
    row |= {"fetched_at": F.col("last_fetched_at"), "sitemap_lastmod": F.col("sitemap_lastmod_seen")}
    return j.select("url", "md_path", F.col("md_path").alias("path"), "title", "content_hash", "tier", "audience", "fy_years", "anchors", "parent_guide", F.col("md").alias("body"), F.concat(front_matter(row), F.col("md")).alias("page"), "extractor_version")


def rate_table_facts(profile: Profile):
    """The fact extractor of rate tables: (name, pages, rows to facts)."""

    def found(rows: DataFrame) -> DataFrame:
        rows = rows.where(looks_like_rates(F.col("body")))
        rates = rate_facts(rows, F.col("body"), F.get(profile.fy_years(F.col("url")), 0)).select("url", "content_hash", F.explode("facts").alias("f"))
        return rates.select(
            F.lit("ato-rate-table-v1").alias("schema"), F.concat(F.lit("individual-resident-"), F.col("f.fy")).alias("slug"), "url", F.concat(F.lit("sha256:"), "content_hash").alias("content_hash"),
            F.col("f.fy").alias("fy"), F.lit("individual_resident").alias("audience"), F.col("f.brackets").alias("brackets"), F.col("f.effective_from").alias("effective_from"), F.col("f.effective_to").alias("effective_to"), F.lit(FACTS_VERSION).alias("extractor_version"),
        )

    return "rate-tables", profile.fact_pages, found


def facts(manifest: DataFrame, blobs: DataFrame, profile: Profile = GENERIC) -> DataFrame:
    """The facts of the pages that have them, by the profile's extractors and that of rate tables: one row a schema and slug."""
    pages = gates.indexed(manifest)
    every = [make(pages.where(wanted(F.col("url"))).join(blobs, "raw_hash")) for _, wanted, make in (rate_table_facts(profile), *profile.extractors)]
    return artifacts.distinct_facts(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every))


def extracted_again(pages: DataFrame, manifest: DataFrame, blobs: DataFrame, run_id: str, profile: Profile = GENERIC, rate: float = 0.01, most: int = 200) -> DataFrame:
    """A sample of the pages (its size is what the gate asks for), extracted anew from their bodies: url, content_hash, version, ok."""
    some = corpus.sampled(pages.select("url"), "url", run_id, "determinism", rate, most)
    rows = some.join(manifest.select("url", "raw_hash"), "url").join(blobs.select("raw_hash", "body"), "raw_hash")
    run = extractor(profile.dynamic, profile.strategies, profile.enrichers)
    x = rows.select("url", run(F.col("body"), profile.body_kind(F.col("body"), F.col("url"), F.lit(None).cast("string"))).alias("x"))
    return x.select("url", "x.content_hash", "x.version", "x.ok")


def run(spark: SparkSession, root: str, seeds: DataFrame, fetch_log: DataFrame, blobs: DataFrame, now: str, run_id: str, profile: Profile = GENERIC, config: m.Config = m.Config(), coverage: float = gates.COVERAGE, year: int = 2025) -> bool:
    """Seed, plan, extract, commit, publish over a fetch log that answers the plan; whether the run was published. A run that raises is marked failed."""
    with storage.guarded(ship(spark), root, run_id):
        return _run(spark, root, seeds, fetch_log, blobs, now, run_id, profile, config, coverage, year)


def _run(spark, root, seeds, fetch_log, blobs, now, run_id, profile, config, coverage, year) -> bool:
    before = storage.current(spark, root)
    manifest = storage.table(spark, root, "manifest") if before else m.empty(spark)
    tagged = seeds.select("seq", "url", "lastmod", profile.tier(F.col("url"), year).alias("tier"), profile.parent_guide(F.col("url")).alias("parent_guide"))
    seeded = _keep(spark, m.upsert_seeds(manifest, tagged, now, config).drop("action"), root, run_id, "seeded")
    planned = _keep(spark, m.plan(seeded, m.at(F.lit(now)), needs_browser=profile.requires_browser(F.col("url")), config=config), root, run_id, "plan")
    log = fetch_log.join(m.fetchable(planned).select("url"), "url", "left_semi")
    extracted = _keep(spark, extract(log, blobs, seeded, profile), root, run_id, "extract_log")
    after, changed = m.commit(seeded, log, extracted.drop("md", "anchors"), now, run_id, config)
    after = _keep(spark, m.purge(after, planned), root, run_id, "manifest")
    old_log = storage.changelog(spark, root) if before else spark.createDataFrame([], storage.CHANGELOG)
    last = old_log.agg(F.max_by("entry_hash", "seq").alias("h"), F.coalesce(F.max("seq") + 1, F.lit(0)).alias("n")).first()
    new = integrity.ranked(changed, "seq").withColumn("seq", F.col("i") + last["n"]).drop("i")
    # Only the run's own entries are written; the log is those of the run before and its predecessors, and these.
    own = _keep(spark, integrity.append(new, last["h"]).select(*old_log.columns), root, run_id, "changelog")
    storage.put_text(spark, f"{root}/runs/{run_id}/after", before or "")
    chained = old_log.unionByName(own)
    fresh = pages(after, extracted, profile)
    kept = storage.table(spark, root, "pages").withColumn("run_id", F.lit(before)) if before else spark.createDataFrame([], fresh.schema).withColumn("run_id", F.lit(""))
    # Indexed pages that this run did not read again are filled in from the last published run.
    fill = changes.forward_fill(gates.indexed(after), fresh, kept, fresh.columns)
    held = fresh.unionByName(fill.where("linked").select(*fresh.columns)).join(gates.indexed(after).select("url"), "url", "left_semi")
    held = _keep(spark, held, root, run_id, "pages")
    found = _keep(spark, checked(facts(after, blobs, profile), profile.schemas, payload()), root, run_id, "facts")
    genesis = lambda df: df.agg(F.min_by("run_id", "seq").alias("genesis"), F.count("*").alias("total"))
    all_ = gates.all_gates(
        gates.consistency(after, held), gates.hashes(held, profile.dynamic), gates.coverage(after, floor=coverage), gates.schema_sanity(held), gates.changelog_continuity(genesis(old_log), genesis(chained)),
        gates.filled(fill), gates.facts_validation(found), gates.determinism(held, extracted_again(held, after, blobs, run_id, profile)),
    )
    all_ = _keep(spark, all_, root, run_id, "gates")
    tree = integrity.merkle_root(integrity.leaves(gates.indexed(after).select("url", "content_hash")))
    snapshot = artifacts.snapshot(after, tree, all_, run_id, now)
    url = F.col("url")
    tables = {"snapshot": snapshot, "routes": artifacts.routes(after, held), "by_guide": artifacts.by_guide(after, held), "guides": artifacts.guides(after, profile.fy_years(url)), "sections": artifacts.section_lines(after, held, profile.audience(url), profile.fy_years(url), (profile.forms,))}
    order = spark.createDataFrame([(slug, i, title) for i, (slug, _, title) in enumerate(profile.sections)], "slug string, place int, title string")
    texts = {"INDEX.md": artifacts.render_index(artifacts.sections(after, order).collect(), profile.host or "Index"), "llms.txt": artifacts.render_listing(artifacts.listing(after).collect(), profile.host or "site", run_id)}
    return storage.publish(spark, root, run_id, tables, all_, texts)


def _keep(spark: SparkSession, df: DataFrame, root: str, run_id: str, name: str) -> DataFrame:
    path = f"{root}/runs/{run_id}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def robots_gate(url: Column, allowed_page: Column, allowed_api: Column, api: Column) -> Column:
    """A page that is read through an API needs leave for both."""
    return allowed_page & (api.isNull() | allowed_api)
