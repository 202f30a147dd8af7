"""What changed: runs resolved by id or time, net deltas over a window of the change log, pages and differences at two runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import unified_diff


def newest(runs: DataFrame) -> DataFrame:
    """The newest published run."""
    return runs.where("status = 'published'").orderBy(F.desc("completed_at"), F.desc("run_id")).limit(1)


def as_of(runs: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (a run id or a time) the published run it names: that run, or else the last one completed by then.

    Each distinct point has one row. Points and runs are sorted together by time within hours, and hours, which are few, pass their last
    run on; nothing is crossed.
    """
    points = points.select("point").distinct()
    done = runs.where("status = 'published'").select("run_id", "completed_at")
    exact = points.join(done.select(F.col("run_id").alias("point"), F.col("run_id").alias("exact")), "point", "left")
    marks = exact.select("point", "exact", F.col("point").alias("t"), F.lit(None).cast("string").alias("run"), F.lit(1).alias("kind"))
    marks = marks.unionByName(done.select(F.lit(None).cast("string").alias("point"), F.lit(None).cast("string").alias("exact"), F.col("completed_at").alias("t"), F.col("run_id").alias("run"), F.lit(0).alias("kind")))
    # Marks meet by hour; an hour without a run of its own takes the last one of the hours before.
    marks = marks.withColumn("hour", F.substring("t", 1, 13))
    own = F.last("run", ignorenulls=True).over(W.partitionBy("hour").orderBy("t", "kind", "run"))
    tails = marks.groupBy("hour").agg(F.max_by("run", F.when(F.col("run").isNotNull(), F.struct("t", "run"))).alias("tail"))
    carried = tails.withColumn("carried", F.last("tail", ignorenulls=True).over(W.orderBy("hour").rowsBetween(W.unboundedPreceding, -1))).select("hour", "carried")
    found = marks.withColumn("own", own).where("kind = 1").join(F.broadcast(carried), "hour")
    return found.select("point", F.coalesce("exact", "own", "carried").alias("run_id"))


def since_time(runs: DataFrame, since: str) -> str | None:
    """The time that a cursor stands for: the completion (or start) of the run it names, or itself if it is a time."""
    row = runs.where(F.col("run_id") == since).select(F.coalesce("completed_at", "started_at").alias("t")).first()
    if row is not None:
        return row["t"]
    return since if len(since) >= 10 and since[4:5] == "-" else None


def net_delta(window: DataFrame) -> DataFrame:
    """Per url over change log rows (seq, url, change_type, old_hash, new_hash, ts, tier): first old, last new, and the net kind.

    An entry that ends gone or without hash is removed, one that began without hash is added, one whose hash moved is modified;
    what came and went, or came back to its hash, is no change.
    """
    d = window.groupBy("url").agg(
        F.min("seq").alias("first_seq"),
        F.min_by(F.struct("old_hash"), "seq")["old_hash"].alias("old_hash"),
        F.max_by(F.struct("new_hash", "ts", "change_type", "tier"), "seq").alias("last"),
    ).select("url", "first_seq", "old_hash", "last.*")
    gone = (F.col("change_type") == "gone") | F.col("new_hash").isNull()
    kind = F.when(gone, F.when(F.col("old_hash").isNotNull(), "removed")).when(F.col("old_hash").isNull(), "added").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return d.withColumn("net", kind).where("net IS NOT NULL")


def window(changelog: DataFrame, runs: DataFrame, since: str) -> DataFrame:
    """The change log rows of published runs after since, up to the newest published run."""
    done = runs.where("status = 'published'").select("run_id", "completed_at")
    upto = newest(runs).select(F.col("completed_at").alias("upto"))
    rows = changelog.join(done, "run_id").where(F.col("completed_at") > F.lit(since_time(runs, since)))
    return rows.join(F.broadcast(upto)).where("completed_at <= upto").drop("upto")


def changed_since(changelog: DataFrame, runs: DataFrame, since: str, prefix: str = "", tier: str | None = None, limit: int = 500, offset: int = 0) -> DataFrame:
    """Net changes after a run or time, newest first in each group, ties in log order; total is the group's size before paging."""
    if since_time(runs, since) is None:
        raise ValueError(f"unknown run or time: {since}")
    d = net_delta(window(changelog, runs, since))
    d = d.where(F.col("url").startswith(prefix)) if prefix else d
    d = d if tier is None else d.where(F.col("tier") == tier)
    place = F.row_number().over(W.partitionBy("net").orderBy(F.desc("ts"), F.asc("first_seq")))
    total = d.groupBy("net").agg(F.count("*").alias("total"))
    return d.withColumn("place", place).where((F.col("place") > offset) & (F.col("place") <= offset + limit)).join(F.broadcast(total), "net").select("net", "place", "url", "old_hash", "new_hash", "ts", "tier", "total")


def delta_counts(changelog: DataFrame, runs: DataFrame, since: str) -> DataFrame:
    d = net_delta(window(changelog, runs, since))
    return d.agg(*(F.count_if(F.col("net") == k).alias(k) for k in ("added", "removed", "modified")))


def chain_tip(changelog: DataFrame) -> DataFrame:
    return changelog.agg(F.max_by("entry_hash", "seq").alias("tip"), F.min_by("run_id", "seq").alias("genesis_run"), F.count("*").alias("entries"))


def page_changes(before: DataFrame, after: DataFrame, key: str = "url", value: str = "content_hash") -> DataFrame:
    """The status of each page between two states: added, removed, modified or unchanged."""
    a, b = before.select(key, F.col(value).alias("old")), after.select(key, F.col(value).alias("new"))
    a, b = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    j = a.join(b, key, "full")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("modified")
    return j.select(key, status.alias("status"), "old", "new")


def diffs(before: DataFrame, after: DataFrame, context: int = 3, cap: int = 16_000) -> DataFrame:
    """The differences of the pages (url, content_hash, body) that were modified, cut at cap characters, with counts."""
    moved = page_changes(before, after).where("status = 'modified'").select("url")
    j = moved.join(before.select("url", F.col("body").alias("a")), "url").join(after.select("url", F.col("body").alias("b")), "url")
    d = j.select("url", unified_diff(F.col("a"), F.col("b"), F.lit(context)).alias("d"))
    return d.select("url", F.substring("d.diff", 1, cap).alias("diff"), "d.added", "d.removed", (F.char_length("d.diff") > cap).alias("truncated"))


def forward_fill(wanted: DataFrame, current: DataFrame, earlier: DataFrame, columns: Sequence[str] = ("body",)) -> DataFrame:
    """For wanted urls that the current run lacks: the page (columns) of the newest earlier run that has it (linked), or none (missing)."""
    more = [c for c in columns if c != "url"]
    lacking = wanted.select("url").join(current.select("url"), "url", "left_anti")
    newest_ = earlier.join(lacking, "url", "left_semi").groupBy("url").agg(F.max_by(F.struct("run_id", *more), "run_id").alias("r"))
    return lacking.join(newest_, "url", "left").select("url", F.col("r.run_id").alias("from_run"), *(F.col(f"r.{c}").alias(c) for c in more), F.col("r").isNotNull().alias("linked"))


def streaks(observations: DataFrame) -> DataFrame:
    """Of the visits (url, seq, content_hash) of each url the number at its end without a change."""
    w = W.partitionBy("url").orderBy("seq")
    moved = (~F.col("content_hash").eqNullSafe(F.lag("content_hash").over(w))).cast("int")
    runs = observations.withColumn("run", F.sum(moved).over(w))
    return runs.groupBy("url", "run").agg(F.count("*").alias("n")).groupBy("url").agg((F.max_by("n", "run") - 1).alias("unchanged_streak"))


def kept_backups(backups: DataFrame, keep: int) -> DataFrame:
    """Backups (name, mtime) with whether rotation keeps them: the newest so many, at least one."""
    place = F.row_number().over(W.partitionBy("root").orderBy(F.desc("mtime"), F.desc("name")))
    return backups.withColumn("kept", place <= max(1, keep))
