"""Reading a published corpus: regex and path search, directories, page reads, guarded SQL, status."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash, truncated

#: Caps of the read tools.
READ_CHARS, GREP_HITS, LINE_CHARS, GLOB_HITS, SQL_ROWS, DIR_ROWS, FAN_LINES = 20_000, 200, 240, 500, 500, 500, 60


def lines(pages: DataFrame) -> DataFrame:
    """path, line number from 1, line."""
    return pages.select("path", F.posexplode(F.split("body", "\n")).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def grep(pages: DataFrame, pattern: str, path_prefix: str = "", ignore_case: bool = False, limit: int = GREP_HITS, per_file: int | None = None, width: int = LINE_CHARS) -> DataFrame:
    """Matching lines in order of path and line, cut at width characters. Pages without a match are dropped before their lines are made."""
    p = f"(?i){pattern}" if ignore_case else pattern
    some = pages.where(F.col("path").startswith(path_prefix)) if path_prefix else pages
    hits = lines(some.where(F.col("body").rlike(f"(?m){p}"))).where(F.col("line").rlike(p))
    if per_file is not None:
        hits = hits.withColumn("k", F.row_number().over(W.partitionBy("path").orderBy("line_no"))).where(F.col("k") <= per_file).drop("k")
    return hits.orderBy("path", "line_no").limit(limit).select("path", "line_no", F.substring("line", 1, width).alias("line"))


def grep_files(pages: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Paths with a match, and how many lines match."""
    p = f"(?i){pattern}" if ignore_case else pattern
    n = F.size(F.filter(F.split("body", "\n"), lambda x: x.rlike(p)))
    return pages.select("path", n.alias("n")).where("n > 0")


def grep_context(pages: DataFrame, pattern: str, context: int, limit: int = GREP_HITS) -> DataFrame:
    """Matching lines with so many lines around each: path, line_no, before, line, after. The lines around are cut from the page's own row."""
    rows = pages.where(F.col("body").rlike(f"(?m){pattern}")).select("path", F.split("body", "\n").alias("all"))
    at = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.get("all", i).rlike(pattern))
    before = lambda i: F.slice("all", F.greatest(F.lit(1), i + 1 - context), F.least(i, F.lit(context)))
    hit = lambda i: F.struct(i.alias("i"), before(i).alias("before"), F.get("all", i).alias("line"), F.slice("all", i + 2, context).alias("after"))
    found = rows.select("path", F.explode(F.transform(at, hit)).alias("h"))
    return found.select("path", (F.col("h.i") + 1).alias("line_no"), "h.before", "h.line", "h.after").orderBy("path", "line_no").limit(limit)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression; * crosses directories."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end]
            out += "[" + ("^" + inside[1:] if inside.startswith("!") else inside).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"(?s)^{out}$"


def glob(pages: DataFrame, pattern: str, limit: int = GLOB_HITS) -> DataFrame:
    return pages.where(F.col("path").rlike(glob_regex(pattern))).select("path").orderBy("path").limit(limit)


def list_dir(pages: DataFrame, directory: str = "", limit: int = DIR_ROWS) -> DataFrame:
    """The children of a directory: directories first, then files with their size, by name."""
    base = directory.strip("/") + "/" if directory.strip("/") else ""
    rest = F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))
    rows = pages.where(F.col("path").startswith(base)).withColumn("rest", rest)
    is_file = ~F.col("rest").contains("/")
    rows = rows.groupBy(F.substring_index("rest", "/", 1).alias("name"), is_file.alias("is_file")).agg(F.sum(F.octet_length("body")).alias("bytes"), F.count("*").alias("files"))
    return rows.orderBy("is_file", "name").limit(limit).select("name", F.when(F.col("is_file"), "file").otherwise("dir").alias("kind"), F.when(F.col("is_file"), F.col("bytes")).alias("size"), "files")


def read(pages: DataFrame, path: str, offset: int = 0, limit: int = READ_CHARS, patterns: tuple = (), verify: bool = False) -> DataFrame:
    """Part of a page by characters; with verify, whether its body still has its content hash."""
    row = pages.where(F.col("path") == path)
    cols = ["path", F.substring(F.col("body"), F.lit(offset + 1), F.lit(limit)).alias("text"), F.char_length("body").alias("total"), (F.char_length("body") > offset + limit).alias("more")]
    return row.select(*cols, *([(content_hash(F.col("body"), patterns) == F.regexp_replace("content_hash", "^sha256:", "")).alias("verified")] if verify else []))


def read_facts(facts: DataFrame, schema: str | None = None, slug: str | None = None, limit: int = READ_CHARS) -> DataFrame:
    """Facts as a reader sees them: path, a head of schema, source and content hash, and the fact as JSON with sorted keys, cut at limit characters."""
    rows = facts if schema is None else facts.where(F.col("schema") == schema)
    rows = rows if slug is None else rows.where(F.col("slug") == slug)
    path = F.concat(F.lit("facts/"), "schema", F.lit("/"), "slug", F.lit(".json"))
    say = lambda c: F.coalesce(c, F.lit(f"<no {c}>"))
    head = F.concat(F.lit("# "), path, F.lit("\nschema: "), say("schema"), F.lit("\nsource_url: "), say("url"), F.lit("\ncontent_hash: "), say("content_hash"), F.lit("\n---\n"))
    names = {"schema": "$schema", "url": "source_url"}
    body = F.struct(*(F.col(c).alias(n) for n, c in sorted((names.get(c, c), c) for c in facts.columns if c != "slug")))
    return rows.select(path.alias("path"), F.concat(head, truncated(F.to_json(body, {"pretty": "true"}), limit)).alias("text"))


def read_capped(pages: DataFrame, limit: int = 30_000) -> DataFrame:
    return pages.select("path", truncated(F.col("body"), limit).alias("text"))


#: Table functions that read nothing but their arguments, and functions that call Java or name functions at run time.
TABLE_FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack")
_REFLECTION = r"(?is)\b(java_method|reflect|try_reflect|identifier)`?(\s|/\*.*?\*/|--[^\n]*\n)*\("
_COMMANDS = r"(?m)^\W*'?(Insert|Create|Drop|Alter|Delete|Update|Merge|SetCommand|Add|ScriptTransformation|PlanWithUnresolvedIdentifier)\w*"


def read_only(spark: SparkSession, sql: str, tables: Iterable[str]) -> None:
    """Refuse (ValueError) a text that is no query, or a query that reads anything but the tables, its own common table expressions and
    TABLE_FUNCTIONS, or that calls Java or a script. A literal that spells such a call is refused too.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    if not re.match(r"\s*(select|with|\()", sql, re.I) or re.search(_COMMANDS, plan) or re.search(_REFLECTION, sql):
        raise ValueError("only SELECT and WITH are allowed, without scripts and reflection")
    own = {x.strip().lower() for names in re.findall(r"(?m)^\W*CTE \[(.*?)\]", plan) for x in names.split(",")}
    names = [x.lower() for x in re.findall(r"UnresolvedRelation \[(.*?)\], \[", plan)]
    calls = [x.lower() for x in re.findall(r"UnresolvedTableValuedFunction \[(.*?)\]", plan)]
    bad = sorted({x for x in names if x not in own | {t.lower() for t in tables}} | {x for x in calls if x not in TABLE_FUNCTIONS})
    if bad:
        raise ValueError(f"no such table: {', '.join(bad)}")


def query(spark: SparkSession, sql: str, limit: int = SQL_ROWS, **tables: DataFrame) -> tuple[DataFrame, bool]:
    """A read-only SQL query over named tables, run once: at most limit rows, and whether there are more."""
    read_only(spark, sql, tables)
    shadowed = {n: spark.table(n) for n in tables if spark.catalog.tableExists(n) and spark.catalog.getTable(n).isTemporary}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        rows = spark.sql(sql)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
        for name, df in shadowed.items():
            df.createOrReplaceTempView(name)
    head = rows.limit(limit + 1).collect()
    return spark.createDataFrame(head[:limit], rows.schema), len(head) > limit


def fan_out(results: DataFrame, per_index: int = FAN_LINES) -> DataFrame:
    """At most so many lines of each index, in its own order (index, pos)."""
    return results.withColumn("k", F.row_number().over(W.partitionBy("index").orderBy("pos"))).where(F.col("k") <= per_index).drop("k")


def inventory(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def status(manifest: DataFrame, runs: DataFrame, last: int = 5) -> tuple[DataFrame, DataFrame]:
    """(one row of totals and the share of rendered pages that can be revalidated, the last runs). Works on an empty root."""
    rendered = F.col("browser_version").isNotNull()
    cached = rendered & (F.col("http_etag").isNotNull() | F.col("http_last_modified").isNotNull())
    totals = manifest.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "UNSEEN").alias("unseen"), F.count_if(rendered).alias("rendered"), F.when(F.count_if(rendered) > 0, F.count_if(cached) / F.count_if(rendered)).alias("cache_share"))
    return totals, runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(last)


def describe(indexes: DataFrame) -> DataFrame:
    """Registry rows (root, dirname, slug, domain, first_host, description, fresh, files) with their fallbacks; equal slugs get @dirname; by slug."""
    n = F.count("*").over(W.partitionBy("slug"))
    slug = F.when(n > 1, F.concat("slug", F.lit("@"), "dirname")).otherwise(F.col("slug"))
    pages = F.when(F.col("fresh") > 0, F.col("fresh")).otherwise(F.least("files", F.lit(50_000)))
    domain = F.coalesce("domain", "first_host", "dirname")
    return indexes.select(slug.alias("slug"), domain.alias("domain"), F.coalesce("description", F.concat(F.lit("Indexed pages of "), domain)).alias("description"), pages.alias("page_count"), "root").orderBy("slug")


def sampled(rows: DataFrame, key: str, run_id: str, label: str, rate: float, most: int, least: int = 25) -> DataFrame:
    """A sample that depends on run, label and key alone: min(most, max(least, rate of all)) rows, those of least hash."""
    n = rows.count()
    k = min(n, most, max(least, int(n * rate)))
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(run_id), F.lit(label), F.col(key)), 256), key).limit(k)


def stratified(rows: DataFrame, by: str, key: str, label: str, n: int) -> DataFrame:
    """At most n rows of each stratum, those of least hash."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.sha2(F.concat_ws(":", F.lit(label), F.col(key)), 256), key))
    return rows.withColumn("_k", place).where(F.col("_k") <= n).drop("_k")


def proportional(rows: DataFrame, by: str, key: str, label: str, total: int) -> DataFrame:
    """total rows shared out in proportion to the strata (half-even, one at least), those of least hash in each; cut at total by hash.

    Sizes come from one aggregation. Hashes are uniform, so a threshold a little above a stratum's quota lets through few more
    rows than it needs; only these are sorted. A stratum that falls short of its quota keeps all its rows in a second pass.
    """
    size = F.broadcast(rows.groupBy(by).agg(F.count("*").alias("_n")))
    n = rows.count()
    quota = F.greatest(F.lit(1), F.bround(F.lit(float(total)) * F.col("_n") / max(n, 1)).cast("int"))
    order = F.sha2(F.concat_ws(":", F.lit(label), F.col(key)), 256)
    marked = rows.join(size, by).withColumn("_quota", quota).withColumn("_h", order)
    share = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    near = share <= (F.col("_quota") + 8 * F.sqrt(F.col("_quota")) + 8) / F.col("_n")
    enough = marked.where(near).groupBy(by).agg(F.count("*").alias("_near"))
    marked = marked.join(F.broadcast(enough), by, "left").where(near | (F.coalesce("_near", F.lit(0)) < F.col("_quota")))
    place = F.row_number().over(W.partitionBy(by).orderBy("_h", key))
    return marked.withColumn("_k", place).where(F.col("_k") <= F.col("_quota")).orderBy("_h", key).limit(total).select(*rows.columns)


def safe_path(root: str, path: str) -> bool:
    """Whether a relative path stays below its root."""
    import posixpath

    full = posixpath.normpath(posixpath.join(root, path))
    return full == root.rstrip("/") or full.startswith(root.rstrip("/") + "/")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)
