"""Author classes for turns that lack one, in chunks, by what their transcripts say about them.

That a class is null is the cursor: a chunk fills its rows in one commit, and what is null afterwards is still to be done,
whether the run was stopped or never begun. A chunk is a range of hashes of the session, so that it reads the transcripts
of its own sessions only. Where a transcript is gone, type, text and the session's kind decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.authorship import author
from quillmark.operators.joins import paths_left
from quillmark.sources import transcripts
from quillmark.sources.splits import numbered_lines
from quillmark.store import Store
from quillmark.workspace import staging

CHUNK_ROWS = 200_000
STRUCTURE = ("is_sidechain", "is_meta", "is_compact_summary", "prompt_source", "origin_kind")


def by_structure(observations: DataFrame, sessions: DataFrame, structure: DataFrame) -> DataFrame:
    """observations with a class everywhere: stored ones stay, the rest follow from structure(obs_id, is_meta ..), text and kind.

    Of several lines with one id the first in order of its values counts; ids without a line go by type, text and kind.
    """
    kinds = sessions.select("session_id", F.col("kind").alias("_kind")).dropDuplicates(["session_id"])
    one = structure.groupBy("obs_id").agg(F.min(F.struct(*STRUCTURE)).alias("_s"))
    joined = observations.join(kinds, "session_id", "left").join(one, "obs_id", "left")
    filled = F.coalesce("provenance", author(F.col("type"), F.col("body"), F.col("_kind"), **{c: F.col(f"_s.{c}") for c in STRUCTURE}))
    return joined.withColumn("provenance", filled).select(*observations.columns)


def _chunk(rows: DataFrame, k: int, of: int) -> Column:
    """Is the row's session in the k-th of so many ranges of the hash?"""
    width = (1 << 32) // of
    at = F.pmod(F.xxhash64("session_id"), F.lit(1 << 32))
    return (at >= k * width) & (at < ((k + 1) * width if k + 1 < of else 1 << 32))


def archived(store: Store, paths: list[str]) -> DataFrame:
    """obs_id and structure of the lines of those transcripts that are still there."""
    spark = store.spark
    there = []
    for p in paths:
        path = store.path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            there.append(p)
    if not there:
        return spark.createDataFrame([], "obs_id string, is_sidechain boolean, is_meta boolean, is_compact_summary boolean, prompt_source string, origin_kind string")
    return transcripts.structure(transcripts.parse(numbered_lines(spark.read, there))[0])


def backfill(store: Store, chunk_rows: int = CHUNK_ROWS, stop: Callable[[], bool] | None = None) -> int:
    """Fill the classes that are null, a chunk a commit; how many rows were filled. A stop takes effect between chunks."""
    todo = store.read("observations").where("provenance IS NULL").count()
    chunks, done = max(1, -(-todo // chunk_rows)), 0
    for k in range(chunks):
        if stop and stop():
            break
        base = store.manifest()["version"]
        with staging(store.spark) as work:
            rows = store.read("observations").where("provenance IS NULL").where(_chunk(store.read("observations"), k, chunks))
            rows = work.keep(rows, "blank")
            if n := rows.count():
                sessions = store.read("sessions").join(rows.select("session_id").distinct(), "session_id", "left_semi")
                paths = [r["jsonl_path"] for r in paths_left(rows, sessions).collect()]  # of one chunk's sessions
                store.commit(deltas={"observations": work.keep(by_structure(rows, sessions, archived(store, paths)), "filled")}, base=base)
                done += n
    return done
