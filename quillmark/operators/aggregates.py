"""Inventory and progress aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_by_source(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """name, n: records per source, sessions per origin, and all sessions as 'sessions'."""
    parts = [
        records.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")),
        sessions.groupBy(F.col("origin").alias("name")).agg(F.count("*").alias("n")),
        sessions.agg(F.lit("sessions").alias("name"), F.count("*").alias("n")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def tag_progress(records: DataFrame) -> DataFrame:
    """Per source: rows, tagged rows, rows whose tags are missing or older than the text, and the state of it all."""
    stale = F.col("llm_tags").isNull() | ~F.col("llm_tags_src_hash").eqNullSafe(F.col("src_hash"))
    out = records.groupBy("source").agg(F.count("*").alias("n"), F.count_if(~stale).alias("tagged"), F.count_if(stale).alias("pending"))
    return out.withColumn("state", F.when(F.col("pending") == 0, "done").when(F.col("tagged") == 0, "none").otherwise("partial"))


def top_tags(records: DataFrame, most: int = 20) -> DataFrame:
    """The commonest tags of each source; a tag counts once a record."""
    both = F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("llm_tags", F.array().cast("array<string>"))))
    counts = records.select("source", F.explode(both).alias("tag")).groupBy("source", "tag").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), F.asc("tag")))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


def span(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """The earliest and latest time of either family."""
    r = records.agg(F.least(F.min("created_at"), F.min("updated_at")).alias("lo"), F.greatest(F.max("created_at"), F.max("updated_at")).alias("hi"))
    s = sessions.agg(F.min("first_ts").alias("lo"), F.max("last_ts").alias("hi"))
    return r.union(s).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def orphan_roots(sessions: DataFrame) -> DataFrame:
    """Placeholders for roots that no session row has: first and last time of the streams under them."""
    have = sessions.select(F.col("session_id").alias("root_session_id"))
    grouped = sessions.groupBy("root_session_id").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.count("*").alias("streams"))
    return grouped.join(have, "root_session_id", "left_anti")


def distinct_agent_types(sessions: DataFrame, most: int = 20) -> DataFrame:
    return sessions.where("agent_type IS NOT NULL").select("agent_type").distinct().orderBy("agent_type").limit(most)


def unclassified(observations: DataFrame) -> DataFrame:
    return observations.agg(F.count_if(F.col("provenance").isNull()).alias("n"), F.coalesce(F.bool_or(F.col("provenance").isNull()), F.lit(False)).alias("any_left"))


def fold_faults(faults: DataFrame, kinds: int = 5) -> DataFrame:
    """Per file: each message and how often, the commonest few; the rest as one line."""
    counts = faults.groupBy("file", "message").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), F.asc("message")))
    line = F.when(F.col("rank") <= kinds, F.col("message")).otherwise("other messages")
    return counts.withColumn("rank", rank).groupBy("file", line.alias("message")).agg(F.sum("n").alias("n"))


def payload_census(observations: DataFrame) -> DataFrame:
    return observations.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("body", F.lit("")))).alias("chars"))
