"""Tags by a pluggable model: which rows need them, batches to the model, strict checks of what it says, the write."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TAGS, BATCH, MOST_FAILURES = 8, 15, 3
SHAPE = re.compile(r"[a-z0-9][a-z0-9-]{0,39}")


def pending(records: DataFrame) -> DataFrame:
    """Never tagged, or changed since; newest first."""
    stale = F.col("llm_tags").isNull() | ~F.col("llm_tags_src_hash").eqNullSafe(F.col("src_hash"))
    return records.where(stale).orderBy(F.desc_nulls_last("updated_at"), "stable_id")


def read_tags(text: str) -> list[str] | None:
    """A JSON list of tag words, the first few that have the shape; None if it is no such list."""
    try:
        said = json.loads(text)
    except ValueError:
        return None
    if not isinstance(said, list) or not all(isinstance(t, str) for t in said):
        return None
    return list(dict.fromkeys(t for t in said if SHAPE.fullmatch(t)))[:MOST_TAGS]


def tag(records: DataFrame, model: Callable[[list[str]], list[str]], batch: int = BATCH) -> DataFrame:
    """stable_id, llm_tags, llm_tags_src_hash of rows that the model gave usable tags.

    A task stops asking after three failures in a row; rows it didn't reach stay pending.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failures = 0
        for df in frames:
            out = []
            for at in range(0, len(df), batch):
                if failures >= MOST_FAILURES:
                    break
                part = df.iloc[at : at + batch]
                try:
                    said = [read_tags(x) for x in model(part["body"].tolist())]
                    failures = 0
                except Exception:  # the model's failure counts and its rows stay pending
                    failures += 1
                    continue
                out += [(i, t, h) for i, t, h in zip(part["stable_id"], said, part["src_hash"], strict=True) if t is not None]
            yield pd.DataFrame(out, columns=["stable_id", "llm_tags", "llm_tags_src_hash"])

    return records.select("stable_id", "body", "src_hash").mapInPandas(scan, "stable_id string, llm_tags array<string>, llm_tags_src_hash string")


def write_tags(records: DataFrame, tagged: DataFrame) -> DataFrame:
    new = tagged.select("stable_id", F.col("llm_tags").alias("_tags"), F.col("llm_tags_src_hash").alias("_hash"))
    joined = records.join(new, "stable_id", "left")
    values = {"llm_tags": F.coalesce("_tags", "llm_tags"), "llm_tags_src_hash": F.coalesce("_hash", "llm_tags_src_hash")}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in records.columns])


def classify_missing(observations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Observations with an author class everywhere: stored ones stay, the rest follow from type, body and session kind."""
    from quillmark.functions.authorship import author

    kinds = sessions.select("session_id", F.col("kind").alias("_kind"))
    joined = observations.join(kinds, "session_id", "left")
    filled = F.coalesce("provenance", author(F.col("type"), F.col("body"), F.col("_kind")))
    return joined.withColumn("provenance", filled).select(*observations.columns)
