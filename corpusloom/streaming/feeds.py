"""Streams: the state of a manifest folded from result logs, a change feed, hosts that block, and windows over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.manifest import at, commit
from corpusloom.sources import storage
from corpusloom.sources.storage import LOGS


def log_stream(spark: SparkSession, path: str, kind: str, files: int = 100) -> DataFrame:
    """New files of a log folder, so many a batch."""
    return spark.readStream.schema(LOGS[kind]).option("maxFilesPerTrigger", files).json(path)


def once_per_run(stream: DataFrame, hours: int = 48) -> DataFrame:
    """Each (url, fetched_at) once; state older than the watermark goes."""
    return stream.withColumn("at", at(F.col("fetched_at"))).withWatermark("at", f"{hours} hours").dropDuplicatesWithinWatermark(["url", "fetched_at"])


def fold(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Apply each batch of results to the manifest, once: apply(batch, number) must give the same for the same number."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest_fold(spark: SparkSession, root: str, manifest: DataFrame, extract_log: DataFrame, now: str, run_id: str) -> Callable[[DataFrame, int], None]:
    """For fold(): commits each batch of fetch results to the manifest kept below root, the first one to the manifest given.

    A batch writes its state whole and then turns the pointer, in one step, so a batch that is repeated after a failure changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = int(storage.get_text(spark, f"{root}/last") or -1)
        if number > last:
            before = manifest if last < 0 else spark.read.parquet(f"{root}/state-{last}")
            after, log = commit(before, batch, extract_log, now, run_id)
            after.write.mode("overwrite").parquet(f"{root}/state-{number}")
            log.write.mode("overwrite").parquet(f"{root}/changes-{number}")
            storage.put_text(spark, f"{root}/last", str(number))

    return apply


def manifest_state(spark: SparkSession, root: str) -> DataFrame:
    """The manifest after the last batch."""
    return spark.read.parquet(f"{root}/state-{storage.get_text(spark, f'{root}/last')}")


def blocked_hosts(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """From a stream of attempts (host, seq, blocked): the tally of each host and whether it is latched.

    A success clears the tally of a host that is not latched; a latched one stays so. The attempts of a trigger, which the
    source bounds, are taken in the order of seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tally, latched = state.get if state.exists else (0, False)
        for blocked in pd.concat(batches).sort_values("seq", kind="stable")["blocked"]:
            if not latched:
                tally = tally + 1 if blocked else 0
                latched = tally >= limit
        state.update((tally, latched))
        yield pd.DataFrame({"host": [key[0]], "tally": [tally], "latched": [latched]})

    return attempts.groupBy("host").applyInPandasWithState(step, "host string, tally int, latched boolean", "tally int, latched boolean", "update", GroupStateTimeout.NoTimeout)


def change_feed(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """The change log as a stream; rows of runs (run_id, status) that are not published are withheld."""
    return log_stream(spark, path, "changelog").join(runs.where("status = 'published'").select("run_id"), "run_id", "left_semi")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in windows, late ones up to the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """The sessions of each user: events closer than the gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
