"""Operational state as tables: usage, latencies, circuit breaker, rate limits, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import ordered

THRESHOLD, BASE_MS, MAX_MS, ALPHA = 4, 30_000, 600_000, 0.3


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """For each name the value at place floor(p * n) of the sorted values of a key (the last one at most).

    A histogram of distinct values is pre-aggregated before anything is ordered, so a hot key's rows never meet in one task.
    """
    hist = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*keys)
    own = hist.withColumn("_to", F.sum("_c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    at = lambda p: F.least(F.col("_n"), F.floor(F.lit(p) * F.col("_n")) + 1)
    return own.groupBy(*keys).agg(*[F.min(F.when(F.col("_to") >= at(p), F.col(value))).alias(name) for name, p in percents.items()])


def usage(events: DataFrame) -> DataFrame:
    """(op, requests, avg_ms, p50, p95, error_rate, cache_rate). events: (op, ms, ok, cached)."""
    totals = events.groupBy("op").agg(F.count("*").alias("requests"), F.avg("ms").alias("avg_ms"), F.avg((~F.col("ok")).cast("double")).alias("error_rate"), F.avg(F.col("cached").cast("double")).alias("cache_rate"))
    return totals.join(nearest_rank(events, ["op"], "ms", {"p50": 0.5, "p95": 0.95}), "op")


def provider_success(events: DataFrame) -> DataFrame:
    """(provider, calls, success_rate) where a row may name several providers, joined by plus signs."""
    return events.select(F.explode(F.split("provider", r"\+")).alias("provider"), "ok").groupBy("provider").agg(F.count("*").alias("calls"), F.avg(F.col("ok").cast("double")).alias("success_rate"))


def health(events: DataFrame) -> DataFrame:
    """(op, calls, success_rate), the least reliable first, of equal ones those with more calls. events: (op, ok)."""
    own = events.groupBy("op").agg(F.count("*").alias("calls"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"))
    return own.orderBy("success_rate", F.desc("calls"), "op")


def last_samples(events: DataFrame, keys: list[str], order: list[Column], most: int = 500) -> DataFrame:
    return events.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def failure_streaks(calls: DataFrame, key: str, order: list[str]) -> DataFrame:
    """calls with `streak`: failures in a row up to each call, 0 at a success."""
    run = F.sum(F.col("ok").cast("int")).over(W.partitionBy(key).orderBy(*order))
    own = calls.withColumn("_run", run)
    return own.withColumn("streak", F.sum((~F.col("ok")).cast("int")).over(W.partitionBy(key, "_run").orderBy(*order))).drop("_run")


def cooldown_ms(failures: Column) -> Column:
    return F.least(F.lit(MAX_MS), BASE_MS * F.pow(F.lit(2), F.greatest(F.lit(0), failures - THRESHOLD))).cast("long")


def smoothed(calls: DataFrame, key: str, order: list[str], value: str, size: int = ordered.BLOCK) -> DataFrame:
    """(key, ema): exponential smoothing, rounded at each step, begun anew from 0."""
    return ordered.smoothed(calls, key, order, value, ALPHA, size)


#: Failures beyond which a pause grows no more: modes of the breaker are failures so far, up to here.
MOST_FAILURES = next(f for f in range(THRESHOLD, 64) if BASE_MS * 2 ** (f - THRESHOLD) >= MAX_MS)


def _breaker_step(modes, columns):
    """A success closes; a failure is one more, and from the threshold on begins a pause."""
    import numpy as np

    failed = np.minimum(modes + 1, MOST_FAILURES)
    pause = np.where(failed >= THRESHOLD, np.minimum(MAX_MS, BASE_MS * 2 ** np.maximum(failed - THRESHOLD, 0)), 0)
    ok = columns["ok"].astype(bool)
    return np.where(ok, 0, failed), np.where(ok, 0, pause)


def breaker(calls: DataFrame, key: str = "source", tie: list[str] | None = None, size: int = ordered.BLOCK) -> DataFrame:
    """(key, ts, tie, ok, asked, state): a source with four failures in a row is skipped until its pause ends, then probed once.

    calls: (key, ts in ms, ok): what each call would bring; a null counts as a failure. Equal times go by tie, then failures first.
    """
    tie = [*(tie or []), "ok"]
    own = calls.select(key, "ts", *tie[:-1], F.coalesce("ok", F.lit(False)).alias("ok"))
    out = ordered.jump_machine(own, key, "ts", tie, _breaker_step, MOST_FAILURES + 1, list(range(THRESHOLD, MOST_FAILURES + 1)), ["ok"], size)
    state = F.when(~F.col("asked"), "open").when(F.col("mode") >= THRESHOLD, "half-open").otherwise("closed")
    return out.select(key, "ts", *tie, "asked", state.alias("state"))


def fixed_window(hits: DataFrame, key: str, limit: int, window_ms: int, tie: list[str] | None = None, size: int = ordered.BLOCK) -> DataFrame:
    """(key, ts, tie, count, allowed, retry_ms): windows begin with the first hit after the last one's end. hits: (key, ts in ms)."""
    step = lambda modes, columns: (modes * 0, modes * 0 + window_ms)
    out = ordered.jump_machine(hits.select(key, "ts", *(tie or [])), key, "ts", tie or [], step, 1, [0], [], size)
    allowed = F.col("since") <= limit
    return out.select(key, "ts", *(tie or []), F.col("since").alias("count"), allowed.alias("allowed"), F.when(allowed, F.lit(0).cast("long")).otherwise(F.col("until") - F.col("ts")).alias("retry_ms"))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts, each behind its length, so that no two lists of parts run together."""
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def ttl_seconds(by_intent: Column, freshness_hours: Column) -> Column:
    return F.when(freshness_hours.isNull(), by_intent).otherwise(F.least(by_intent.cast("double"), freshness_hours * 3600, F.lit(21600.0)))


def as_of(probes: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Each probe (key, probe_id, at) with the latest entry (key, stored_at, expires_at, payload) that is valid at its time.

    One sorted pass instead of a range join: entries and probes of a key are ordered together and the last entry is carried on.
    """
    e = entries.select(key, F.col("stored_at").alias("at"), F.lit(None).cast("long").alias("probe_id"), F.struct("stored_at", "expires_at", "payload").alias("e"))
    p = probes.select(key, "at", F.col("probe_id").cast("long").alias("probe_id"), F.lit(None).cast(e.schema["e"].dataType).alias("e"))
    w = W.partitionBy(key).orderBy("at", F.col("probe_id").isNotNull(), "probe_id").rowsBetween(W.unboundedPreceding, 0)
    own = e.unionByName(p).withColumn("e", F.last("e", True).over(w)).where("probe_id is not null")
    valid = F.col("e.expires_at") > F.col("at")
    return own.select("probe_id", key, "at", F.when(valid, F.col("e.payload")).alias("payload"), F.coalesce(valid, F.lit(False)).alias("hit"))


def least_recent(entries: DataFrame, most: int = 1000) -> DataFrame:
    """The `most` entries of the latest access, by a top-k that keeps `most` rows a task."""
    return entries.orderBy(F.desc("last_access"), "key").limit(most)
