"""Row filters of the three tables, as Columns that reach the scan where they can."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.scalar import overlap
from quillmark.model import ORIGINS
from quillmark.plans.dsl import QueryAST, machine_values


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions) if conditions else F.lit(True)


def has_tag(tag: str) -> Column:
    """Exact but for ASCII case, over both tag arrays."""
    every = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("llm_tags", F.array().cast("array<string>")))
    return F.exists(every, lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") == "".join(c.lower() if c.isascii() else c for c in tag))


def record_filter(ast: QueryAST) -> Column:
    """Dates are met by created or updated, for from and to each on its own."""
    out = [F.col("source") == ast.source] if ast.source and ast.source != "records" else []
    if ast.from_date:
        out.append((F.col("created_at") >= F.lit(ast.from_date)) | (F.col("updated_at") >= F.lit(ast.from_date)))
    if ast.to_date:
        out.append((F.col("created_at") <= F.lit(ast.to_date)) | (F.col("updated_at") <= F.lit(ast.to_date)))
    return F.coalesce(_all(out + [has_tag(t) for t in ast.tags]), F.lit(False))


def _source(ast: QueryAST) -> list[Column]:
    if ast.source == "subagents":
        return [F.col("kind") == "subagent"]
    if ast.source in ORIGINS:
        return [F.col("origin") == ast.source]
    return []


def session_filter(ast: QueryAST) -> Column:
    """Tags match no session; top beats session; an active window beats from and to."""
    if ast.tags:
        return F.lit(False)
    out = _source(ast)
    if ast.top_session_id:
        out.append(F.col("session_id") == ast.top_session_id)
    elif ast.session_id:
        out.append(F.col("root_session_id") == ast.session_id)
    if ast.agent_id:
        out.append(F.col("agent_id") == ast.agent_id)
    low, high = (ast.active_from, ast.active_to) if ast.active_from or ast.active_to else (ast.from_date, ast.to_date)
    out.append(overlap(F.col("first_ts"), F.col("last_ts"), F.lit(low) if low else None, F.lit(high) if high else None))
    return F.coalesce(_all(out), F.lit(False))


def authored(by: str) -> Column:
    return F.coalesce(F.col("provenance").isin(*machine_values(by)), F.lit(False))


def observation_rows(observations: DataFrame, sessions: DataFrame, ast: QueryAST) -> DataFrame:
    """Observations that pass; what is known of their sessions only is a semi join."""
    if ast.tags:
        return observations.where(F.lit(False))
    out = []
    if ast.top_session_id:
        out.append(F.col("session_id") == ast.top_session_id)
    elif ast.session_id:
        out.append(F.col("root_session_id") == ast.session_id)
    if ast.obs_type:
        out.append(F.col("type") == ast.obs_type)
    if ast.provenance:
        out.append(authored(ast.provenance))
    if ast.from_date:
        out.append(F.col("ts") >= F.lit(ast.from_date))
    if ast.to_date:
        out.append(F.col("ts") <= F.lit(ast.to_date))
    found = observations.where(F.coalesce(_all(out), F.lit(False)))
    of_session = _source(ast) + ([F.col("agent_id") == ast.agent_id] if ast.agent_id else [])
    if ast.active_from or ast.active_to:
        of_session.append(overlap(F.col("first_ts"), F.col("last_ts"), F.lit(ast.active_from) if ast.active_from else None, F.lit(ast.active_to) if ast.active_to else None))
    return found.join(sessions.where(_all(of_session)).select("session_id"), "session_id", "left_semi") if of_session else found


#: Values up to which a list of them is a condition of the scan; a longer one is a table to join.
MOST_VALUES = 500


def among(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose column is among the values, however many these are; repeated ones and null count for nothing."""
    known = sorted({v for v in values if v is not None})
    if len(known) <= MOST_VALUES:
        return df.where(F.col(column).isin(known))
    return df.join(df.sparkSession.createDataFrame([(v,) for v in known], f"{column} string"), column, "left_semi")
