"""Text matching: conjuncts within a row, the relaxation ladder, conjuncts spread over a session.

Frames have a column `terms` made by token_text or stemmed_text; phrases are lists of tokens of the same making.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import has_phrase, let

STRICT, OR, PREFIX = 3, 2, 1
TIER_NAMES = {STRICT: None, OR: "or", PREFIX: "prefix"}


def _column(terms: str | Column) -> Column:
    return F.col(terms) if isinstance(terms, str) else terms


def match_all(phrases: list[list[str]], terms: str | Column = "terms") -> Column:
    return reduce(and_, [has_phrase(_column(terms), p) for p in phrases]) if phrases else F.lit(False)


def match_any(phrases: list[list[str]], terms: str | Column = "terms") -> Column:
    return reduce(or_, [has_phrase(_column(terms), p) for p in phrases]) if phrases else F.lit(False)


def match_prefix(phrases: list[list[str]], terms: str | Column = "terms") -> Column:
    """Any conjunct, the last of them as a beginning."""
    if not phrases:
        return F.lit(False)
    last = has_phrase(_column(terms), phrases[-1], prefix=True)
    return last if len(phrases) == 1 else match_any(phrases[:-1], terms) | last


def tier_of(phrases: list[list[str]], terms: str = "terms") -> Column:
    """The strictest tier that a row meets, 0 for none. With one conjunct the OR tier is the strict one. terms are made once."""
    return let(F.col(terms), lambda t: F.when(match_all(phrases, t), STRICT).when(match_any(phrases, t), OR).when(match_prefix(phrases, t), PREFIX).otherwise(0))


def ladder(df: DataFrame, phrases: list[list[str]], terms: str = "terms") -> DataFrame:
    """Rows of the strictest tier that has any, with that tier. One plan: flags, their maximum as a scalar, a filter."""
    flagged = df.withColumn("tier", tier_of(phrases, terms))
    best = flagged.agg(F.max("tier").alias("best"))
    return flagged.where((F.col("tier") > 0) & (F.col("tier") >= best.scalar()))


def session_roots(observations: DataFrame, phrases: list[list[str]], terms: str = "terms") -> DataFrame:
    """root_session_id of sessions in which every conjunct is met by some row: one pass, partial aggregates."""
    flags = [F.bool_or(has_phrase(F.col(terms), p)).alias(f"c{i}") for i, p in enumerate(phrases)]
    grouped = observations.groupBy("root_session_id").agg(*flags) if flags else observations.groupBy("root_session_id").agg(F.lit(False).alias("c0"))
    every = reduce(and_, [F.col(f"c{i}") for i in range(max(1, len(flags)))])
    return grouped.where(every).select("root_session_id")


def session_scope_rows(observations: DataFrame, phrases: list[list[str]], terms: str = "terms") -> DataFrame:
    """Rows that meet any conjunct, of sessions that meet all."""
    return observations.where(match_any(phrases, terms)).join(session_roots(observations, phrases, terms), "root_session_id", "left_semi")


def hit_sessions(sessions: DataFrame, hits: DataFrame) -> DataFrame:
    """A top session shows on any hit under its root, a subagent on hits of its own stream only."""
    top = sessions.where("kind <> 'subagent'").join(hits.select("root_session_id").distinct(), "root_session_id", "left_semi")
    own = sessions.where("kind = 'subagent'").join(hits.select("session_id").distinct(), "session_id", "left_semi")
    return top.select(*sessions.columns).unionByName(own.select(*sessions.columns))
