"""What a snapshot shows: routes, indexes of sections and guides, facts, and the snapshot row. Text is rendered last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.urls import md_path, top_segment
from corpusloom.operators.gates import indexed

#: The columns of the routes table, and the pages of a tier that are listed.
ROUTES = ("url", "md_path", "title", "tier", "audience", "parent_guide", "content_hash")
LISTED = 200


def routes(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """One line an indexed url, for a tab-separated file in url order."""
    rows = indexed(manifest).select("url", "tier", "parent_guide", "content_hash").join(pages.select("url", "title", "audience"), "url", "left")
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]+", " ")
    return rows.select("url", md_path(F.col("url")).alias("md_path"), clean(F.col("title")).alias("title"), "tier", F.coalesce("audience", F.lit("")).alias("audience"), F.coalesce("parent_guide", F.lit("")).alias("parent_guide"), "content_hash")


def sections(manifest: DataFrame, order: DataFrame) -> DataFrame:
    """Sections with pages: the curated ones (slug, place, title) in their order, then the rest by name; the root is counted but not listed."""
    n = indexed(manifest).groupBy(top_segment(F.col("url")).alias("slug")).agg(F.count("*").alias("n"))
    j = n.join(F.broadcast(order), "slug", "left").where("slug <> ''")
    return j.select("slug", F.coalesce("title", F.initcap(F.translate("slug", "-", " "))).alias("title"), "n", F.row_number().over(W.orderBy(F.coalesce("place", F.lit(2**30)), "slug")).alias("place"))


def guides(manifest: DataFrame, years: Column | None = None) -> DataFrame:
    """Per guide: pages, first url and the distinct financial years (array; by default none) of its urls."""
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_set("years"))))
    rows = indexed(manifest).where("parent_guide IS NOT NULL").withColumn("years", F.array().cast("array<string>") if years is None else years)
    return rows.groupBy("parent_guide").agg(F.count("*").alias("n"), F.min("url").alias("first_url"), every.alias("years"))


def listing(manifest: DataFrame, most: int = LISTED) -> DataFrame:
    """Per tier, with its pages in all: its guides with count and first url, and the first ungrouped pages by url."""
    rows = indexed(manifest)
    grouped = rows.where("parent_guide IS NOT NULL").groupBy("tier", F.col("parent_guide").alias("name")).agg(F.count("*").alias("n"), F.min("url").alias("url"))
    place = F.row_number().over(W.partitionBy("tier").orderBy("url"))
    single = rows.where("parent_guide IS NULL").withColumn("k", place).where(F.col("k") <= most).select("tier", F.lit(None).cast("string").alias("name"), F.lit(1).cast("long").alias("n"), "url")
    total = rows.groupBy("tier").agg(F.count("*").alias("total"))
    return grouped.unionByName(single).join(F.broadcast(total), "tier")


def by_guide(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of each guide one after the other in url order."""
    rows = indexed(manifest).where("parent_guide IS NOT NULL").select("url", "parent_guide").join(pages.select("url", "body"), "url")
    return rows.groupBy("parent_guide").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("url", "body"))), lambda s: s["body"]), "\n\n").alias("body"), F.count("*").alias("n"))


def distinct_facts(facts: DataFrame) -> DataFrame:
    """One fact for each schema and slug: that of the last url."""
    last = F.row_number().over(W.partitionBy("schema", "slug").orderBy(F.desc("url")))
    return facts.withColumn("k", last).where("k = 1").drop("k")


def fact_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("schema").agg(F.count("*").alias("n"))


def snapshot(manifest: DataFrame, root: DataFrame, gates: DataFrame, run_id: str, completed_at: str) -> DataFrame:
    """One row: counts by state and tier, coverage, the root, and the gates."""
    by = lambda c: manifest.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"counts_by_{c}"))
    held = gates.agg(F.array_sort(F.collect_list(F.struct("gate", "passed", "detail"))).alias("gates"), (F.count_if(F.col("blocking") & ~F.col("passed")) == 0).alias("ok"))
    one = by("state").join(by("tier")).join(root).join(held)
    return one.select(F.lit(run_id).alias("run_id"), F.lit(completed_at).alias("completed_at"), F.when(F.col("ok"), "published").otherwise("degraded").alias("status"), "counts_by_state", "counts_by_tier", F.col("root").alias("merkle_root"), "leaf_count", "gates")


def render_index(rows: list, title: str) -> str:
    """The markdown of a few section rows (slug, title, n)."""
    return "\n".join([f"# {title}", "", *(f"- [{r['title']}](sections/{r['slug']}/INDEX.md) ({r['n']} pages)" for r in sorted(rows, key=lambda r: r["place"])), ""])


def render_listing(rows: list, host: str, run_id: str) -> str:
    """The text of the listing (tier, name, n, url) for language models: by tier its guides, then its first ungrouped pages."""
    out = [f"# {host} LLM index", "", f"Run: {run_id}", ""]
    for tier in sorted({r["tier"] for r in rows}):
        own = [r for r in rows if r["tier"] == tier]
        out += [f"## {tier} ({max(r['total'] for r in own)} pages)", ""]
        out += [f"- [{r['name']}]({r['url']}) — {r['n']} pages" for r in sorted((r for r in own if r["name"] is not None), key=lambda r: r["name"])]
        out += [*(f"- {r['url']}" for r in sorted((r for r in own if r["name"] is None), key=lambda r: r["url"])), ""]
    return "\n".join(out)


def section_lines(manifest: DataFrame, pages: DataFrame, audience: Column, years: Column, grouped: tuple[str, ...] = ("forms-and-instructions",)) -> DataFrame:
    """The lines of every section's index (slug, kind, key, line): one a page by url; in grouped sections one a guide, with its pages and years.

    A section's head (kind 0) has its audience and number of pages. Sections of any size are rows; their files are a view, ordered by kind and key.
    """
    rows = indexed(manifest).select("url", "parent_guide", top_segment(F.col("url")).alias("slug"), audience.alias("audience"), years.alias("years"))
    rows = rows.join(pages.select("url", "title", "md_path"), "url", "left").where("slug <> ''")
    head = rows.groupBy("slug").agg(F.count("*").alias("n"), F.min("audience").alias("audience"))
    head = head.select("slug", F.lit(0).alias("kind"), F.lit("").alias("key"), F.concat(F.lit("Audience: `"), "audience", F.lit("` · Pages: "), F.col("n").cast("string")).alias("line"))
    by_guide = F.col("slug").isin(*grouped) & F.col("parent_guide").isNotNull()
    guide = rows.where(by_guide).groupBy("slug", "parent_guide").agg(F.count("*").alias("n"), F.min("url").alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("years")))).alias("years"))
    named = F.when(F.size("years") > 0, F.concat(F.lit(" · "), F.array_join("years", ", "))).otherwise("")
    guide = guide.select("slug", F.lit(1).alias("kind"), F.col("parent_guide").alias("key"), F.concat(F.lit("- ["), "parent_guide", F.lit("]("), "first", F.lit(") — "), F.col("n").cast("string"), F.lit(" pages"), named).alias("line"))
    single = rows.where(~by_guide).select("slug", F.lit(2).alias("kind"), F.col("url").alias("key"), F.concat(F.lit("- ["), F.coalesce("title", "url"), F.lit("]("), F.coalesce("md_path", "url"), F.lit(")")).alias("line"))
    return head.unionByName(guide).unionByName(single)
