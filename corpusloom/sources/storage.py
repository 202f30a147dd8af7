"""Logs, bodies, pages and snapshots on storage: explicit schemas, write-once bodies, versioned tables and a pointer written last."""

from __future__ import annotations

import contextlib
import json
import platform
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import split_front

PLAN = "decision string, etag string, last_modified string, parent_guide string, reason string, sitemap_lastmod string, tier string, url string"
FETCH = "url string, decision string, status int, etag string, last_modified string, raw_hash string, raw_bytes long, fetched_at string, error string, browser_version string, content_type string, seq long"
EXTRACT = "url string, raw_hash string, content_hash string, title string, n_chars int, extractor_version string, normalizer_version string, ok boolean, reason string, seq long"
CHANGELOG = "seq long, ts string, url string, change_type string, old_hash string, new_hash string, run_id string, tier string, prev_hash string, entry_hash string"
LOGS = {"plan": PLAN, "fetch": FETCH, "extract": EXTRACT, "changelog": CHANGELOG}


def read_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A log of JSON lines under its schema; lines that cannot be read are skipped, fields that are absent are null."""
    return spark.read.schema(LOGS[kind]).option("mode", "DROPMALFORMED").json(path)


def write_log(df: DataFrame, path: str) -> None:
    """Append JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("append").option("ignoreNullFields", "false").json(path)


def add_blobs(spark: SparkSession, new: DataFrame, path: str) -> int:
    """Add bodies (raw_hash, body) that are not there yet, by the first two hex digits; how many were new."""
    rows = new.dropDuplicates(["raw_hash"]).withColumn("shard", F.substring("raw_hash", 1, 2))
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select("raw_hash"), "raw_hash", "left_anti")
    rows = rows.repartition("shard").persist()
    n = rows.count()
    if n:
        rows.write.mode("append").partitionBy("shard").option("compression", "gzip").parquet(path)
    rows.unpersist()
    return n


def read_blobs(spark: SparkSession, path: str, hashes: DataFrame | None = None) -> DataFrame:
    blobs = spark.read.parquet(path).select("raw_hash", "body")
    return blobs if hashes is None else blobs.join(hashes.select("raw_hash").distinct(), "raw_hash", "left_semi")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A tree of markdown files: path, head as a map, body, url and content hash. Lists that are malformed and hashes that are empty read null."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    head, body = split_front(F.col("value"))
    rows = rows.select("path", head.alias("head"), body.alias("body"))
    get = lambda k: F.try_element_at("head", F.lit(k))
    clean = F.regexp_replace(get("content_hash"), "^sha256:", "")
    return rows.select("path", "head", "body", get("url").alias("url"), F.when(clean != "", clean).alias("content_hash"), F.from_json(get("anchors"), T.ArrayType(T.StringType())).alias("anchors"), get("tier").alias("tier"))


def write_pages(pages: DataFrame, path: str, column: str = "page") -> None:
    """Rendered pages as a table by url; their text files are a view of it."""
    pages.select("url", "md_path", column).write.mode("overwrite").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.orderBy("url").write.mode("overwrite").csv(path, sep="\t", header=True, quote="")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: to a name beside it first, which then replaces it in one step, so a reader always finds the old or the new one."""
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    whole = p.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    hadoop.FileContext.getFileContext(whole.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp.makeQualified(fs.getUri(), fs.getWorkingDirectory()), whole, options)


def get_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def changelog(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """The change log up to a run, or to the published one: its own entries and those of the published runs before it."""
    run, paths = run_id or current(spark, root), []
    while run:
        paths.append(f"{root}/runs/{run}/changelog")
        run = (get_text(spark, f"{root}/runs/{run}/after") or "").strip()
    if not paths:
        raise ValueError("nothing is published")
    return spark.read.schema(CHANGELOG).parquet(*paths)


def publish(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame], gates: DataFrame, texts: dict[str, str] | None = None) -> bool:
    """Write a run's tables, texts and its snapshot, and turn the pointer to it if every blocking gate passed."""
    for name, text in (texts or {}).items():
        put_text(spark, f"{root}/runs/{run_id}/{name}", text)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/runs/{run_id}/{name}")
    failed = [r["gate"] for r in gates.where("blocking AND NOT passed").collect()]
    put_text(spark, f"{root}/runs/{run_id}/snapshot.json", json.dumps({"run_id": run_id, "status": "degraded" if failed else "published", "failed_gates": sorted(failed), "environment": environment()}, sort_keys=True, indent=2))
    put_text(spark, f"{root}/runs/{run_id}/status.json", json.dumps({"status": "degraded" if failed else "published"}))
    if not failed:
        put_text(spark, f"{root}/current", run_id)
    return not failed


def current(spark: SparkSession, root: str) -> str | None:
    return (get_text(spark, f"{root}/current") or "").strip() or None


def table(spark: SparkSession, root: str, name: str, run_id: str | None = None) -> DataFrame:
    """A table of a run, or of the published one."""
    run = run_id or current(spark, root)
    if run is None:
        raise ValueError("nothing is published")
    return spark.read.parquet(f"{root}/runs/{run}/{name}")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Every run that has a snapshot: run_id, completed_at, status."""
    if not exists(spark, f"{root}/runs"):
        return spark.createDataFrame([], "run_id string, completed_at string, status string")
    fs, p = _fs(spark, f"{root}/runs")
    paths = [f"{x.getPath().toString()}/snapshot" for x in fs.listStatus(p)]
    some = [x for x in paths if exists(spark, x)]
    return spark.read.parquet(*some).select("run_id", "completed_at", "status") if some else spark.createDataFrame([], "run_id string, completed_at string, status string")


def table_as_of(spark: SparkSession, root: str, name: str, point: str) -> tuple[str, DataFrame]:
    """(run, its table) that a published run's id or a time names: for a time, of the last run completed by then. Anything else is refused."""
    point, done = point.strip(), runs(spark, root)
    named = done.where(F.col("run_id") == point).first()
    if named is not None:
        if named["status"] != "published":
            raise ValueError(f"run {point} was not published")
        return point, table(spark, root, name, point)
    if not re.match(r"\d{4}-\d\d-\d\d", point):
        raise ValueError(f"{point} is no run and no time")
    last = done.where((F.col("status") == "published") & (F.col("completed_at") <= point)).orderBy(F.desc("completed_at"), F.desc("run_id")).first()
    if last is None:
        raise ValueError(f"nothing was published by {point}")
    return last["run_id"], table(spark, root, name, last["run_id"])


def discover(spark: SparkSession, path: str) -> DataFrame:
    """The indexes at a path: itself, or its immediate children, as rows for corpus.describe."""
    fs, p = _fs(spark, path)
    held = [path] if exists(spark, f"{path}/runs") else [x.getPath().toString() for x in fs.listStatus(p) if x.isDirectory() and exists(spark, f"{x.getPath().toString()}/runs")] if fs.exists(p) else []
    rows = []
    for root in held:
        meta = json.loads(get_text(spark, f"{root}/index.json") or "{}")
        run = current(spark, root)
        manifest = table(spark, root, "manifest", run) if run else None
        first = manifest.agg(F.min("url")).first()[0] if run else None
        fresh = manifest.where("state IN ('FRESH', 'FROZEN')").count() if run else 0
        name = root.rstrip("/").rpartition("/")[2]
        rows.append((root, name, meta.get("slug") or name, meta.get("domain"), re.sub(r"^[^/]*//([^/?#]*).*$", r"\1", first or "") or None, meta.get("description"), fresh, table(spark, root, "pages", run).count() if run else 0))
    return spark.createDataFrame(rows, "root string, dirname string, slug string, domain string, first_host string, description string, fresh long, files long")


@contextlib.contextmanager
def guarded(spark: SparkSession, root: str, run_id: str):
    """Mark a run as running, and as failed, with the error, if what is done under it raises."""
    put_text(spark, f"{root}/runs/{run_id}/status.json", json.dumps({"status": "running"}))
    try:
        yield
    except Exception as e:
        put_text(spark, f"{root}/runs/{run_id}/status.json", json.dumps({"status": "failed", "error": f"{type(e).__name__}: {e}"[:1000]}))
        raise


def environment() -> dict[str, str]:
    """The versions on which content hashes depend."""
    import pyspark

    return {"python": platform.python_version(), "unicode": unicodedata.unidata_version, "pyspark": pyspark.__version__}


def backup(spark: SparkSession, root: str, to: str, keep: int = 7) -> tuple[str, str]:
    """(path, SHA-256) of a copy of the published run's manifest, snapshot and change log and of the table of runs, under the run's id; the
    oldest copies beyond keep (one at least), by the time of their digests, are removed. The digest is over the names and digests of the files.
    """
    run = current(spark, root)
    if run is None:
        raise ValueError("nothing is published")
    path = f"{to}/{run}"
    for name, df in (("manifest", table(spark, root, "manifest")), ("snapshot", table(spark, root, "snapshot")), ("changelog", changelog(spark, root)), ("runs", runs(spark, root))):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    named = files.select(F.concat_ws(":", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1), F.sha2("content", 256)).alias("line"))
    digest = named.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256)).first()[0]
    put_text(spark, f"{path}/sha256", digest)
    fs, p = _fs(spark, to)
    copies = [(fs.getFileStatus(_fs(spark, f"{x.getPath().toString()}/sha256")[1]).getModificationTime(), x.getPath()) for x in fs.listStatus(p) if exists(spark, f"{x.getPath().toString()}/sha256")]
    for _, old in sorted(copies, key=lambda x: (x[0], x[1].getName()), reverse=True)[max(1, keep) :]:
        fs.delete(old, True)
    return path, digest


def verify_backup(spark: SparkSession, path: str) -> tuple[bool, str]:
    """Whether a backup has a manifest with its columns and a table of runs."""
    from corpusloom.operators.manifest import COLUMNS

    for name, columns in (("manifest", COLUMNS), ("runs", ["run_id", "status"])):
        if not exists(spark, f"{path}/{name}"):
            return False, f"table {name} is missing"
        lacking = set(columns) - set(spark.read.parquet(f"{path}/{name}").columns)
        if lacking:
            return False, f"{name} lacks {', '.join(sorted(lacking))}"
    return True, ""
