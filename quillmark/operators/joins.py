"""Joins that ingest and upkeep need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def observations_with_kind(observations: DataFrame, sessions: DataFrame) -> DataFrame:
    return observations.join(sessions.select("session_id", "kind"), "session_id", "left")


def paths_left(observations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Archive paths of sessions that still have observations without an author class."""
    left = observations.where("provenance IS NULL").select("session_id").distinct()
    return sessions.where("jsonl_path IS NOT NULL").join(left, "session_id", "left_semi").select("jsonl_path").distinct()


def present_keys(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(table.select(key), key, "left_semi")


def orphans(observations: DataFrame, sessions: DataFrame) -> DataFrame:
    return observations.join(sessions.select("session_id"), "session_id", "left_anti")


def newest_wins(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key: the greatest by the order, partial maxima before the shuffle."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row")
    return rows.groupBy(key).agg(best).select(*[F.col(f"row.{c}").alias(c) for c in rows.columns])


def first_claim_wins(rows: DataFrame, key: str, modified: str, path: str, position: str) -> DataFrame:
    """The newest file's first row of each key; the greater path at equal times."""
    return newest_wins(rows, key, F.col(modified), F.col(path), -F.col(position))


def merge_two_sources(backup: DataFrame, polled: DataFrame, key: str = "task_id") -> DataFrame:
    """Both as one row per key: the later observation wins, and a measured end beats a guessed one of any age."""
    both = backup.unionByName(polled, allowMissingColumns=True)
    measured = F.max_by(F.when(~F.col("inferred"), F.col("completed_at")), F.when(~F.col("inferred") & F.col("completed_at").isNotNull(), F.col("observed_at"))).alias("measured")
    last = F.max_by(F.struct(*both.columns), F.struct("observed_at", "origin")).alias("row")
    merged = both.groupBy(key).agg(last, measured)
    columns = [F.coalesce("measured", "row.completed_at").alias(c) if c == "completed_at" else (F.col("row.inferred") & F.col("measured").isNull()).alias(c) if c == "inferred" else F.col(f"row.{c}").alias(c) for c in both.columns]
    return merged.select(*columns)


def vanished(before: DataFrame, now: DataFrame, covered: DataFrame) -> DataFrame:
    """Tasks open before and absent now, of projects that the poll covered; an uncovered project infers nothing."""
    return before.join(now.select("task_id"), "task_id", "left_anti").join(covered.select("project_id"), "project_id", "left_semi")


def uncovered(before: DataFrame, now: DataFrame, covered: DataFrame) -> DataFrame:
    """Per project that the poll missed: tasks retained and since when they are reported."""
    kept = before.join(now.select("task_id"), "task_id", "left_anti").join(covered.select("project_id"), "project_id", "left_anti")
    return kept.groupBy("project_id").agg(F.array_sort(F.collect_list("task_id")).alias("task_ids"), F.min("first_reported_at").alias("since"))
