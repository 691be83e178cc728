"""Order, union and pages. Ties end at the id, so pages neither repeat nor lose rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import snippet, wrapped
from quillmark.workspace import stored

ORDERS = {
    "records": (F.desc_nulls_last, "updated_at", "stable_id"),
    "sessions": (F.desc_nulls_last, "last_ts", "session_id"),
    "observations": (F.asc_nulls_first, "ts", "obs_id"),
}


def _newest() -> list[Column]:
    return [F.desc_nulls_last("ts"), F.asc("arm"), F.asc("id")]


def ordered(df: DataFrame, table: str) -> DataFrame:
    way, by, key = ORDERS[table]
    return df.orderBy(way(by), F.asc(key))


def page(df: DataFrame, table: str, offset: int, size: int) -> DataFrame:
    """size rows and one more, which says whether there is a next page."""
    return ordered(df, table).offset(offset).limit(size + 1)


def _placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """place (from 0), id, total of all rows of df(id, ..) by an order that no two rows share.

    Rows are dealt by ranges of the order and sorted in their parts, as a table; a part's start is the sum of the parts
    before it, a row for each part.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "places")
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    found = rows.withColumn("part", part).join(F.broadcast(starts), "part")  # as many rows as the shuffle has parts
    return found.select((F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"), "id", "total")


def placed(df: DataFrame, table: str) -> DataFrame:
    """The places of all rows in the order of page()."""
    way, by, key = ORDERS[table]
    return _placed(df.select(by, F.col(key).alias("id")), [way(by), F.asc("id")])


def union_placed(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """The places of all items in the order of union_by_time()."""
    both = record_items(records).unionByName(session_items(sessions))
    return _placed(both.select("ts", "arm", "id"), _newest())


def record_items(records: DataFrame, full: bool = False) -> DataFrame:
    content = wrapped(F.col("stable_id"), F.col("body")) if full else F.lit("")
    return records.select(
        F.lit(0).alias("arm"), F.col("stable_id").alias("id"), "source", F.coalesce("subject", F.lit("")).alias("subject"),
        F.coalesce("updated_at", "created_at").alias("ts"), content.alias("content"),
    )


def session_items(sessions: DataFrame) -> DataFrame:
    source = F.when(F.col("kind") == "subagent", "subagents").when(F.col("origin") == "claude-code", "sessions").otherwise(F.col("origin"))
    context = F.array_join(F.array_compact(F.array("cwd", "git_branch")), " @ ")
    return sessions.select(F.lit(1).alias("arm"), F.col("session_id").alias("id"), source.alias("source"), context.alias("subject"), F.col("last_ts").alias("ts"), F.lit("").alias("content"))


def observation_items(observations: DataFrame, terms: Sequence[str], full: bool = False) -> DataFrame:
    head = F.btrim(F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+", " "))
    subject = F.when(head == "", F.col("type")).otherwise(F.substring(head, 1, 120))
    text = wrapped(F.col("obs_id"), F.col("body")) if full else snippet(F.col("body"), terms)
    return observations.select(F.lit(2).alias("arm"), F.col("obs_id").alias("id"), F.col("type").alias("source"), subject.alias("subject"), "ts", text.alias("content"))


def union_by_time(records: DataFrame, sessions: DataFrame, offset: int, size: int) -> DataFrame:
    """Items of both, newest first, those without a time last, records before sessions at equal times.

    Each arm gives its first offset + size + 1 rows only, as no more of it can be on the page.
    """
    newest, reach = _newest(), offset + size + 1
    both = record_items(records).orderBy(*newest).limit(reach).unionByName(session_items(sessions).orderBy(*newest).limit(reach))
    return both.orderBy(*newest).offset(offset).limit(size + 1)


def by_date(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def keyset(df: DataFrame, key: str, after: str | None, size: int) -> DataFrame:
    """The next rows in order of a unique key, after the last one seen: the cost doesn't grow with how far the scan is."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(size)
