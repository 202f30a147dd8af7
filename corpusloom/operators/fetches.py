"""Fetch results: what is refused after a fetch, retries and escalation, and counts by status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.urls import host_of

#: The largest body, the statuses that may pass, the waits between attempts in seconds, the headers that are kept.
MAX_BODY = 25 * 1024 * 1024
TRANSIENT = (408, 429, 500, 502, 503, 504)
BACKOFF, LONGEST_WAIT = 1.5, 30.0


def refused(final_url: Column, body: Column, hosts: list[str], api_url: Column | None = None) -> Column:
    """Why the body of a fetch is not stored: it came from a host that is not allowed (the page's own API host is), or is too large; else null."""
    host, size = host_of(final_url), F.octet_length(body)
    known = (host == "") | host.isin([h.lower() for h in hosts])
    known = known if api_url is None else known | F.coalesce(host == host_of(api_url), F.lit(False))
    return F.when(~known, F.concat(F.lit("redirect-off-allowlist:"), host)).when(size > MAX_BODY, F.concat(F.lit("body-too-large:"), size.cast("string"), F.lit(f">{MAX_BODY}")))


def screened(results: DataFrame, hosts: list[str]) -> DataFrame:
    """Fetch results (final_url, body, error, and api_url where there is one) whose refused bodies are null and whose error says why."""
    why = refused(F.col("final_url"), F.col("body"), hosts, F.col("api_url") if "api_url" in results.columns else None)
    rows = results.withColumn("error", F.coalesce("error", why))
    return rows.withColumn("body", F.when(F.col("error").isNull(), F.col("body")))


def transient(status: Column, error: Column) -> Column:
    return error.isNotNull() | status.isin(*TRANSIENT)


def wait(attempt: Column, retry_after: Column | None = None) -> Column:
    """Seconds before the attempt after this one (from 0): doubled each time up to the longest wait; Retry-After, if it is a number, may raise it."""
    seconds = F.least(F.lit(LONGEST_WAIT), F.lit(BACKOFF) * F.pow(F.lit(2.0), attempt))
    return seconds if retry_after is None else F.greatest(seconds, F.coalesce(retry_after.try_cast("double"), F.lit(0.0)))


def escalated(status: Column, *tiers: Column) -> Column:
    """Whether any transport that is there (an array of the statuses at which it takes over; null: not there) takes over."""
    none = F.array().cast("array<int>")
    every = F.array_distinct(F.flatten(F.array(*(F.coalesce(t, none) for t in tiers)))) if tiers else none
    return F.array_contains(every, status)


def histogram(log: DataFrame) -> DataFrame:
    """Results by status."""
    return log.groupBy("status").agg(F.count("*").alias("n"))


def navigation_headers(events: Column, kept: tuple[str, ...] = ("etag", "last-modified", "content-type")) -> Column:
    """Of the responses to a navigation (array of status and headers) the kept headers, by name in lower case, of the last 200 or 304; null without one."""
    last = F.try_element_at(F.filter(events, lambda e: e["status"].isin(200, 304)), F.lit(-1))["headers"]
    pairs = F.transform(F.map_entries(last), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    some = F.filter(pairs, lambda e: e["key"].isin(*kept))
    return F.aggregate(some, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
