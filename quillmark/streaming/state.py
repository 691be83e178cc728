"""Ingest state as tables: cursors, quarantine, permanent faults, staleness, rates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = 3
KINDS = 5


@dataclass(frozen=True)
class CursorPolicy:
    """How a source moves on: by modified time with an overlap read again, by appending only, or not at all."""

    kind: str
    overlap_seconds: int = 0
    stale_seconds: int = 2 * 86400


# Fixed values.
POLICIES = {
    "sessions": CursorPolicy("modified", 3600),
    "github": CursorPolicy("modified", 3600),
    "dropbox": CursorPolicy("modified", 3600),
    "ticktick": CursorPolicy("none"),
    "chatgpt": CursorPolicy("none"),
    "claude-web": CursorPolicy("none"),
    "substack": CursorPolicy("none"),
    "research": CursorPolicy("append", 300),
    "sota-watch": CursorPolicy("append", 300),
}
FAILURES_BEFORE_BACKOFF, BACKOFF_CAP_SECONDS = 5, 6 * 3600


def window_rows(df: DataFrame, column: str, mark: Column | None, overlap_seconds: int) -> DataFrame:
    """Rows after the mark less the overlap; all rows without a mark. Rows read twice merge by their hash."""
    return df if mark is None else df.where(F.col(column) > mark - F.make_interval(secs=F.lit(overlap_seconds)))


def advance(runs: DataFrame) -> DataFrame:
    """Cursors only go forward and a run without one erases none."""
    return runs.groupBy("source").agg(F.max("cursor_value").alias("cursor_value"), F.sum("rows_seen").alias("rows_seen"))


def after_run(state: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """The state table after runs(source, ok, cursor_value, rows_seen, error).

    A good run resets the failures; from the fifth failure on, the next attempt waits a jittered delay that doubles.
    """
    s, r = state.alias("s"), runs.alias("r")
    joined = s.join(r, F.col("s.source") == F.col("r.source"), "full_outer")
    ran, good = F.col("r.source").isNotNull(), F.coalesce("r.ok", F.lit(False))
    failures = F.when(~ran, F.col("s.consecutive_failures")).when(good, F.lit(0)).otherwise(F.coalesce("s.consecutive_failures", F.lit(0)) + 1)
    delay = F.rand(7) * F.least(F.lit(float(BACKOFF_CAP_SECONDS)), 60 * F.pow(F.lit(2.0), failures - FAILURES_BEFORE_BACKOFF))
    waits = F.when(ran & ~good & (failures >= FAILURES_BEFORE_BACKOFF), now + F.make_interval(secs=delay.cast("decimal(18,6)"))).when(~ran, F.col("s.next_attempt_at"))
    return joined.select(
        F.coalesce("r.source", "s.source").alias("source"),
        F.when(good, F.greatest("s.cursor_value", "r.cursor_value")).otherwise(F.col("s.cursor_value")).alias("cursor_value"),
        F.when(ran, now).otherwise(F.col("s.last_run_at")).alias("last_run_at"), F.when(good, now).otherwise(F.col("s.last_ok_at")).alias("last_ok_at"),
        (F.coalesce("s.rows_seen", F.lit(0)) + F.when(good, F.coalesce("r.rows_seen", F.lit(0))).otherwise(0)).alias("rows_seen"),
        failures.cast("long").alias("consecutive_failures"), F.when(ran, F.when(~good, F.col("r.error"))).otherwise(F.col("s.last_error")).alias("last_error"), waits.alias("next_attempt_at"),
    )


def quarantine_summary(held: DataFrame) -> DataFrame:
    return held.groupBy("source", "error_type", (F.col("attempts") >= TERMINAL).alias("terminal")).agg(F.count("*").alias("n"))


def retry_due(held: DataFrame, now: Column) -> DataFrame:
    """Rows that may be tried again: not terminal, and their wait is over."""
    return held.where((F.col("attempts") < TERMINAL) & (F.coalesce("next_retry_at", now) <= now))


def quarantine(held: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """held after failed(source, record_key, error_type, error_detail): attempts count up, waits double from 15 minutes to a day.

    A payload, where there is one, stays until the row fails with another.
    """
    held, failed = (df if "payload" in df.columns else df.withColumn("payload", F.lit(None).cast("string")) for df in (held, failed))
    h, f = held.alias("h"), failed.alias("f")
    joined = h.join(f, (F.col("h.source") == F.col("f.source")) & (F.col("h.record_key") == F.col("f.record_key")), "full_outer")
    again = F.col("f.record_key").isNotNull()
    attempts = F.coalesce("h.attempts", F.lit(0)) + again.cast("long")
    wait = F.least(F.lit(86400.0), 900 * F.pow(F.lit(2.0), attempts - 1))
    return joined.select(
        F.coalesce("f.source", "h.source").alias("source"), F.coalesce("f.record_key", "h.record_key").alias("record_key"),
        F.coalesce("f.error_type", "h.error_type").alias("error_type"), F.coalesce("f.error_detail", "h.error_detail").alias("error_detail"),
        attempts.alias("attempts"), F.coalesce("h.first_seen_at", now).alias("first_seen_at"), F.when(again, now).otherwise(F.col("h.last_seen_at")).alias("last_seen_at"),
        F.when(again, now + F.make_interval(secs=wait.cast("decimal(18,6)"))).otherwise(F.col("h.next_retry_at")).alias("next_retry_at"),
        F.coalesce("f.payload", "h.payload").alias("payload"),
    )


def release(held: DataFrame, written: DataFrame) -> DataFrame:
    """Held rows but for those that were written at last."""
    return held.join(written.select("source", "record_key"), ["source", "record_key"], "left_anti")


def reconcile_faults(stored: DataFrame, seen: DataFrame, stamps: DataFrame) -> DataFrame:
    """fault_key, status: new, known, released (not seen although its input changed), or unchanged (not read again)."""
    s, n = stored.alias("s"), seen.select("fault_key").distinct().alias("n")
    joined = s.join(n, F.col("s.fault_key") == F.col("n.fault_key"), "full_outer")
    flat = joined.select(F.coalesce("n.fault_key", "s.fault_key").alias("fault_key"), F.col("s.fault_key").isNotNull().alias("stored"), F.col("n.fault_key").isNotNull().alias("seen"), F.col("s.scope_stamp").alias("old"))
    moved = flat.join(stamps, "fault_key", "left")
    status = F.when(~F.col("stored"), "new").when(F.col("seen"), "known").when(~F.col("old").eqNullSafe(F.col("stamp")), "released").otherwise("unchanged")
    return moved.select("fault_key", status.alias("status"))


def stale_episodes(inputs: DataFrame, told: DataFrame, now: Column) -> DataFrame:
    """inputs(source, input_at, threshold_seconds) that are older than allowed and weren't told of at this time and threshold."""
    old = inputs.where(F.unix_seconds(now) - F.unix_seconds("input_at") > F.col("threshold_seconds"))
    return old.join(told.select("source", "input_at", "threshold_seconds"), ["source", "input_at", "threshold_seconds"], "left_anti")


def rate(samples: DataFrame, key: str, at: str, tie: str, depth: int = 8) -> DataFrame:
    """Rows and seconds since the oldest of the last few samples, at each sample."""
    frame = Window.partitionBy(key).orderBy(at, tie).rowsBetween(-(depth - 1), 0)
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    return samples.select(key, tie, (F.col("n") - F.first("n").over(frame)).cast("long").alias("rows_done"), (seconds(F.col(at)) - seconds(F.first(at).over(frame))).alias("seconds"))
