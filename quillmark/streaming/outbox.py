"""What a run has to tell, kept until a channel has carried it.

Lines go into the outbox in the same commit as the rows they speak of. deliver() writes those that nobody has read as a
batch of text files in a spool folder, which is the channel: whoever shows them reads complete batches. A line is
delivered where a complete batch holds it as a whole line; acknowledgement says so in one commit with the state that
waits for it (a project told of, a stale input told of), so that nothing falls silent that wasn't read. A batch that was
acknowledged is renamed. A run that dies between any two of these steps neither loses nor repeats a line: what is in the
store and not in a batch is still to be sent, and what is in a batch and not acknowledged is acknowledged first.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.redact import redact
from quillmark.model import OUTBOX
from quillmark.store import Store

KINDS = ("fault", "held", "uncovered", "poll", "stale", "failure")


def lines(df: DataFrame, source: Column, kind: str, line: Column, subject: Column, at: Column, clean: bool = False) -> DataFrame:
    """Outbox rows of df, one for each different (source, kind, subject, at); a line is redacted, unless it is clean, and has no line ends."""
    said = F.btrim(F.regexp_replace(line, r"\s+", " "))
    said = said if clean else redact(said)
    made = df.select(source.alias("source"), F.lit(kind).alias("kind"), said.alias("line"), subject.cast("string").alias("subject"), at.alias("created_at"))
    key = F.sha2(F.to_json(F.struct("source", "kind", "subject", "created_at")), 256)
    full = made.withColumn("line_id", key).withColumn("acked_at", F.lit(None).cast("timestamp")).withColumn("batch", F.lit(None).cast("string"))
    return full.dropDuplicates(["line_id"]).select(*[f.name for f in OUTBOX.fields])


def carried_by(due: DataFrame, batches: DataFrame) -> DataFrame:
    """due with carried, the first of batches(line, carried) that has the line as a whole."""
    return due.join(batches.groupBy("line").agg(F.min("carried").alias("carried")), "line")


def unread(due: DataFrame, sent: DataFrame) -> DataFrame:
    """Lines of due that sent(line) doesn't have as whole lines."""
    return due.join(sent.select("line"), "line", "left_anti")


def pending(store: Store) -> DataFrame:
    return store.read("outbox").where("acked_at IS NULL")


def _spool(store: Store, spool: str):
    path = store.path(spool)
    return path.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration()), path


def _batches(store: Store, spool: str) -> tuple[list[str], list[str]]:
    """Names of batches that are complete, and of those that a writer has left unfinished."""
    fs, path = _spool(store, spool)
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    found = [n for n in names if n.startswith("batch-")]
    whole = [n for n in found if fs.exists(store.path(f"{spool}/{n}/_SUCCESS"))]
    return whole, [n for n in found if n not in whole]


def acknowledge(store: Store, spool: str, now: datetime | None = None) -> int:
    """Mark the pending lines that complete batches carry, move the state that waited for them, and set the batches aside."""
    spool = spool.rstrip("/")
    whole, _ = _batches(store, spool)
    if not whole:
        return 0
    fs, _ = _spool(store, spool)
    when, base = F.lit(now or datetime.now(UTC)).cast("timestamp"), store.manifest()["version"]
    done = {r["batch"] for r in store.read("outbox").where(F.col("batch").isin(whole)).select("batch").distinct().collect()}
    n = 0
    if new := [b for b in whole if b not in done]:
        carried = store.spark.read.text([f"{spool}/{b}" for b in new]).select(F.col("value").alias("line"), F.regexp_extract(F.col("_metadata.file_path"), r"/(batch-[0-9a-f]+)/", 1).alias("carried"))
        acked = carried_by(pending(store), carried)
        acked = acked.withColumn("acked_at", when).withColumn("batch", F.col("carried")).select(*[f.name for f in OUTBOX.fields])
        n = acked.count()
        if n:
            store.commit(deltas={"outbox": acked} | _moved(store, acked, when), base=base)
    for b in whole:
        fs.rename(store.path(f"{spool}/{b}"), store.path(f"{spool}/sent-{b.removeprefix('batch-')}"))
    return n


def _moved(store: Store, acked: DataFrame, when: Column) -> dict[str, DataFrame]:
    """Rows of state that waited for the acknowledged lines."""
    out = {}
    told = acked.where("kind = 'stale'").select("source", F.get_json_object("subject", "$.input_at").cast("timestamp").alias("input_at"), F.get_json_object("subject", "$.threshold_seconds").cast("long").alias("threshold_seconds"))
    if not told.isEmpty():
        out["stale_told"] = told
    missed = acked.where("kind = 'uncovered'").select("source", F.get_json_object("subject", "$.project_id").alias("project_id"), F.get_json_object("subject", "$.missed_at").cast("timestamp").alias("missed_at"))
    known = store.read("open_tasks")
    read = known.where("told_at IS NULL").join(missed.distinct(), ["source", "project_id", "missed_at"], "left_semi").withColumn("told_at", when).select(*known.columns)
    if not missed.isEmpty() and not read.isEmpty():
        out["open_tasks"] = read
    return out


def deliver(store: Store, spool: str, now: datetime | None = None) -> int:
    """Send what is pending as one batch; how many lines were acknowledged. One deliverer a spool at a time."""
    spool = spool.rstrip("/")
    n = acknowledge(store, spool, now)
    fs, _ = _spool(store, spool)
    for b in _batches(store, spool)[1]:  # cut short: nobody has read it
        fs.delete(store.path(f"{spool}/{b}"), True)
    todo = pending(store)
    if todo.isEmpty():
        return n
    todo.select("line").distinct().write.text(f"{spool}/batch-{uuid.uuid4().hex}")
    return n + acknowledge(store, spool, now)
