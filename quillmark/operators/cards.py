"""What a session's card shows, for all sessions of a page at once: first prompt, number of hits, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROMPT_CHARS, PREVIEWS, PREVIEW_CHARS = 280, 5, 1500


def first_prompts(observations: DataFrame) -> DataFrame:
    """root_session_id, prompt: the earliest turn of type user under the root."""
    turns = observations.where("type = 'user' AND body IS NOT NULL")
    first = turns.groupBy("root_session_id").agg(F.min_by("body", F.struct(F.coalesce("ts", F.lit("9999-12-31").cast("timestamp")), F.col("obs_id"))).alias("body"))
    return first.select("root_session_id", F.substring("body", 1, PROMPT_CHARS).alias("prompt"))


def hit_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("root_session_id").agg(F.count("*").alias("matches"))


def previews(hits: DataFrame, most: int = PREVIEWS, budget: int = PREVIEW_CHARS) -> DataFrame:
    """The first few hits of each root while those before them leave some of the budget; the last is cut to what is left."""
    order = Window.partitionBy("root_session_id").orderBy(F.asc_nulls_first("ts"), "obs_id")
    size = F.length(F.coalesce("body", F.lit("")))
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = hits.withColumn("rank", F.row_number().over(order)).withColumn("left", F.lit(budget) - before)
    kept = ranked.where((F.col("rank") <= most) & (F.col("left") > 0))
    return kept.select("root_session_id", "obs_id", "rank", F.left(F.coalesce("body", F.lit("")), F.col("left").cast("int")).alias("preview"))


def cards(sessions: DataFrame, observations: DataFrame, hits: DataFrame) -> DataFrame:
    joined = sessions.join(first_prompts(observations), "root_session_id", "left").join(hit_counts(hits), "root_session_id", "left")
    return joined.withColumn("matches", F.coalesce("matches", F.lit(0)))
