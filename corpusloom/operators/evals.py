"""Evaluation: fetch rates, structure and text kept, facts coverage, drift between suites, agent runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import HTML_ELEMENTS, html_elements, md_elements, preservation
from corpusloom.functions.urls import host_of

#: Pass marks.
FETCH_PASS, CONDITIONAL_PASS, STRUCTURE_PASS, ANCHOR_PASS, USE_CASE_PASS = 0.95, 0.80, 0.85, 0.95, 0.95
HEADINGS_FLAG, TABLES_FLAG, TEXT_LOW, TEXT_HIGH = 0.40, 0.70, 0.10, 3.0
DRIFT_RATE, DRIFT_COUNT = 0.05, 0.20


def fetch_success(manifest: DataFrame) -> DataFrame:
    """Per host the share of fresh among fresh and failed."""
    n = manifest.groupBy(host_of(F.col("url")).alias("host")).agg(F.count_if(F.col("state") == "FRESH").alias("fresh"), F.count_if(F.col("state") == "FAILED").alias("failed"))
    rate = F.when(F.col("fresh") + F.col("failed") > 0, F.col("fresh") / (F.col("fresh") + F.col("failed"))).otherwise(0.0)
    return n.withColumn("rate", rate).withColumn("passed", F.col("rate") >= FETCH_PASS)


def conditional_gets(planned: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Of the fetches of urls planned as conditional the share answered 304."""
    j = fetch_log.join(planned.where("decision = 'FETCH_CONDITIONAL'").select("url"), "url", "left_semi")
    n = j.agg(F.count("*").alias("total"), F.count_if(F.col("status") == 304).alias("not_modified"))
    rate = F.when(F.col("total") > 0, F.col("not_modified") / F.col("total")).otherwise(0.0)
    return n.withColumn("rate", rate).withColumn("passed", (F.col("total") > 0) & (F.col("rate") >= CONDITIONAL_PASS))


def structure(pages: DataFrame) -> DataFrame:
    """Mean preservation by kind over (html, md) pages, and the mean of the kinds."""
    kept = preservation(F.col("html"), F.col("md"))
    means = pages.agg(*(F.avg(c).alias(k) for k, c in kept.items()), F.count("*").alias("pages"))
    mean = sum((F.col(k) for k in HTML_ELEMENTS), F.lit(0.0)) / len(HTML_ELEMENTS)
    return means.withColumn("mean", mean).withColumn("passed", F.col("mean") >= STRUCTURE_PASS)


def element_totals(pages: DataFrame) -> DataFrame:
    """Elements of html and md, summed: kind, in_html, in_md."""
    h, m = html_elements(F.col("html")), md_elements(F.col("md"))
    sums = pages.agg(*(F.sum(h[k]).alias(f"h_{k}") for k in h), *(F.sum(m[k]).alias(f"m_{k}") for k in m))
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"h_{k}").alias("in_html"), F.col(f"m_{k}").alias("in_md")) for k in h))
    return sums.select(F.inline(rows))


def anchors(pages: DataFrame) -> DataFrame:
    """The share of headings with an anchor over pages (md) with headings, and pages where an anchor repeats."""
    heads = F.regexp_count("md", F.lit(r"(?m)^#{1,6}\s+\S"))
    ids = F.regexp_extract_all("md", F.lit(r"(?m)^#{1,6}\s+.*\{#([^}]+)\}\s*$"), F.lit(1))
    rows = pages.select(heads.alias("heads"), ids.alias("ids")).where("heads > 0")
    n = rows.agg(F.avg(F.least(F.lit(1.0), F.size("ids") / F.col("heads"))).alias("ratio"), F.sum(F.size("ids") - F.size(F.array_distinct("ids"))).alias("duplicates"))
    return n.withColumn("passed", (F.col("ratio") >= ANCHOR_PASS) & (F.col("duplicates") == 0))


def patterns_kept(pages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """For each pattern the mean share of the page's matches that the markdown has, over pages that match."""
    out = []
    for name, p in patterns.items():
        h, m = F.regexp_count("html", F.lit(p)), F.regexp_count("md", F.lit(p))
        out.append(F.struct(F.lit(name).alias("pattern"), F.avg(F.when(h > 0, F.least(F.lit(1.0), m / h))).alias("kept"), F.count_if(h > 0).alias("pages")))
    return pages.agg(F.array(*out).alias("x")).select(F.inline("x"))


def structural_flags(counts: DataFrame) -> DataFrame:
    """Ratios and flags of pages with html_* and md_* counts; tables by rows, three to a table; infinite ratios are null."""
    ratio = lambda a, b: F.when(b > 0, a / b)
    heads, tables = ratio(F.col("md_headings"), F.col("html_headings")), ratio(F.col("md_table_rows"), 3 * F.col("html_tables"))
    text = ratio(F.col("md_chars"), F.col("html_chars"))
    flags = F.filter(
        F.array(F.when(heads < HEADINGS_FLAG, "headings"), F.when(tables < TABLES_FLAG, "tables"), F.when(text < TEXT_LOW, "text-lost"), F.when(text > TEXT_HIGH, "text-grown")),
        lambda f: f.isNotNull(),
    )
    return counts.select("url", heads.alias("heading_ratio"), tables.alias("table_ratio"), text.alias("text_ratio"), flags.alias("flags"))


def medians(flagged: DataFrame) -> DataFrame:
    """Exact medians of the ratios, to three places, and the pages with flags."""
    med = lambda c: F.bround(F.percentile(c, F.lit(0.5)), 3).alias(c)
    return flagged.agg(med("heading_ratio"), med("table_ratio"), med("text_ratio"), F.count_if(F.size("flags") > 0).alias("flagged"), F.count("*").alias("pages"))


def efficiency(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """Distinct bodies for each fetched page, bytes in all and a page."""
    m = manifest.where("state = 'FRESH' AND raw_hash IS NOT NULL").agg(F.count("*").alias("pages"), F.count_distinct("raw_hash").alias("blobs"))
    b = blobs.agg(F.sum("bytes").alias("bytes"))
    return m.join(b).select("pages", "blobs", F.when(F.col("pages") > 0, F.bround(F.col("blobs") / F.col("pages"), 4)).alias("dedup_ratio"), "bytes", F.when(F.col("pages") > 0, F.col("bytes") / F.col("pages")).alias("bytes_per_page"))


def performance(runs: DataFrame) -> DataFrame:
    """Per run its stage shares and pages a second, from (run_id, pages, timings map)."""
    rows = runs.select("run_id", "pages", F.explode("timings").alias("stage", "seconds"))
    total = rows.groupBy("run_id").agg(F.sum("seconds").alias("total"))
    j = rows.join(total, "run_id")
    return j.select("run_id", "stage", "seconds", F.bround(F.col("seconds") / F.col("total"), 4).alias("share"), F.bround(F.col("pages") / F.col("total"), 2).alias("pages_per_second"))


def facts_errors(checked: DataFrame, top: int = 10, per_fact: int = 5) -> DataFrame:
    """The most frequent messages, five a fact at most, equal counts in order of first sight."""
    rows = checked.select("seq", F.posexplode(F.slice("errors", 1, per_fact)).alias("pos", "message"))
    return rows.groupBy("message").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("first")).orderBy(F.desc("n"), "first").limit(top).select("message", "n")


def facts_summary(checked: DataFrame) -> DataFrame:
    ok = F.col("known") & (F.size("errors") == 0)
    return checked.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.count_if(~F.col("known")).alias("no_schema"))


def fact_gaps(pages: DataFrame, facts: DataFrame, shaped: Column) -> DataFrame:
    """Pages that look like facts but gave none, by section."""
    from corpusloom.functions.urls import top_segment

    gap = pages.where(shaped).select("url").join(facts.select("url"), "url", "left_anti")
    return gap.groupBy(top_segment(F.col("url")).alias("section")).agg(F.count("*").alias("n"))


def drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Two suites (slug, status, fetched, stages array<struct<stage,eval,rate>>) compared: one row a finding.

    Fixtures on one side only are membership; a status that gets worse is a regression; rates that move by more than
    the mark, and counts by more than their share of the larger one, are findings as well.
    """
    rank = lambda c: F.array_position(F.array(F.lit("failed"), F.lit("degraded"), F.lit("published")), c)
    j = baseline.alias("b").join(current.alias("c"), F.col("b.slug") == F.col("c.slug"), "full")
    slug = F.coalesce("b.slug", "c.slug")
    both = F.col("b.slug").isNotNull() & F.col("c.slug").isNotNull()
    row = lambda kind, severity, detail: F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), detail.alias("detail"))
    move = lambda better: F.when(better, "improvement").otherwise("regression")
    member = F.when(F.col("b.slug").isNull(), row("membership", F.lit("info"), F.lit("added"))).when(F.col("c.slug").isNull(), row("membership", F.lit("info"), F.lit("removed")))
    status = F.when(both & (F.col("b.status") != F.col("c.status")), row("status", move(rank(F.col("c.status")) > rank(F.col("b.status"))), F.concat_ws(" -> ", "b.status", "c.status")))
    gap = F.abs(F.col("c.fetched") - F.col("b.fetched")) / F.greatest("b.fetched", "c.fetched", F.lit(1))
    count = F.when(both & (gap > DRIFT_COUNT), row("count", move(F.col("c.fetched") > F.col("b.fetched")), F.concat_ws(" -> ", F.col("b.fetched").cast("string"), F.col("c.fetched").cast("string"))))
    whole = j.select(slug.alias("slug"), F.explode(F.filter(F.array(member, status, count), lambda x: x.isNotNull())).alias("x")).select("slug", "x.*")
    ev = lambda df, r: df.select("slug", F.inline("stages")).select("slug", "stage", "eval", F.col("rate").alias(r))
    rates = ev(baseline, "old").join(ev(current, "new"), ["slug", "stage", "eval"]).where(F.abs(F.col("new") - F.col("old")) > DRIFT_RATE)
    rates = rates.select("slug", F.concat(F.lit("rate:"), "stage", F.lit("."), "eval").alias("kind"), move(F.col("new") > F.col("old")).alias("severity"), F.concat_ws(" -> ", F.col("old").cast("string"), F.col("new").cast("string")).alias("detail"))
    return whole.unionByName(rates)


def drift_order() -> list[Column]:
    severity = F.array_position(F.array(F.lit("regression"), F.lit("improvement"), F.lit("info")), F.col("severity"))
    return [severity, F.col("slug"), F.col("kind")]


def drift_tally(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "regression").alias("regressions"), F.count_if(F.col("severity") == "improvement").alias("improvements"), F.count_if(F.col("kind") == "membership").alias("membership"))


def headline(suite: DataFrame) -> DataFrame:
    """Sites by status, and the sums of pages and credits."""
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("published", "degraded", "failed")]
    return suite.agg(*by, F.coalesce(F.sum("fetched"), F.lit(0)).alias("pages"), F.coalesce(F.sum("credits"), F.lit(0)).alias("credits"))


def conditions(cells: DataFrame) -> DataFrame:
    """Per condition the mean of scores above 0, the share passed of all, and tokens."""
    return cells.groupBy("condition").agg(F.avg(F.when(F.col("score") > 0, F.col("score"))).alias("mean_score"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.sum("tokens").alias("tokens"), F.count("*").alias("cells"))


def use_cases(cells: DataFrame, names: list[str], questions: DataFrame | None = None) -> DataFrame:
    """Mean score by use case, that of the cells' questions (qid, use_case) if they are given, a column for each condition."""
    cells = cells if questions is None else cells.drop("use_case").join(questions.select("qid", "use_case"), "qid")
    return cells.groupBy("use_case").pivot("condition", names).agg(F.avg(F.when(F.col("score") > 0, F.col("score"))))


def grid(questions: DataFrame, names: DataFrame, done: DataFrame) -> DataFrame:
    """The (question, condition) cells still to run; the conditions are a few rows."""
    return questions.select("qid").join(F.broadcast(names.select("condition"))).join(done.select("qid", "condition"), ["qid", "condition"], "left_anti")


def questions(rows: DataFrame, qid: str | None = None, use_case: str | None = None, fresh: bool = False) -> DataFrame:
    """The questions (qid, use_case, fresh_sensitive) of an id, of a use case, or those that need fresh pages."""
    rows = rows if qid is None else rows.where(F.col("qid") == qid)
    rows = rows if use_case is None else rows.where(F.col("use_case") == use_case)
    return rows.where("fresh_sensitive") if fresh else rows


def citations(answers: DataFrame) -> DataFrame:
    """Whether an answer (cited array, expected array) cites an expected page, or at least its host."""
    host = lambda u: F.lower(F.regexp_extract(u, r"^[^/]*//([^/]*)", 1))
    exact = F.arrays_overlap("cited", "expected")
    near = F.exists("cited", lambda u: F.array_contains(F.transform("expected", host), host(u)))
    return answers.withColumn("exact", exact).withColumn("host", near)


def low_scorers(cells: DataFrame, n: int = 15) -> DataFrame:
    """The lowest scores, errors first."""
    return cells.orderBy(F.col("error").isNull(), F.col("score").asc_nulls_first(), "qid").limit(n)
