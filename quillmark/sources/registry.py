"""The nine sources by name. A source that can't be made is reported and the others go on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources import chats, files, hits, polls, splits, tasks, transcripts
from quillmark.streaming import outbox


@dataclass(frozen=True)
class Source:
    """shape is 'records' or 'entities'; read(spark, root, since=None, now=None) gives frames by table name, and 'faults'.

    since leaves out input that hasn't been modified since, where the source's files say so; now is the time of the run.
    """

    name: str
    shape: str
    read: Callable[..., dict[str, DataFrame]]
    #: What follows from the stored rows and the frames just read, as further frames' rows: finish(read table, frames, now).
    finish: Callable[[Callable[[str], DataFrame], dict[str, DataFrame], datetime], dict[str, DataFrame]] | None = None


def _transcripts(spark: SparkSession, root: str, since: datetime | None = None, now: datetime | None = None) -> dict[str, DataFrame]:
    """A file written within the last minutes of now may still grow and is left for the next run."""
    before = now - timedelta(minutes=transcripts.LIVE_MINUTES) if now else None
    sessions, observations, faults = transcripts.entities(transcripts.read_lines(spark, root, before, since), since)
    return {"sessions": sessions, "observations": observations, "faults": faults}


def _chats(shape: str, read: Callable) -> Callable:
    def load(spark: SparkSession, root: str, since: datetime | None = None, now: datetime | None = None) -> dict[str, DataFrame]:
        sessions, observations, faults = read(files.sniff_exports(files.export_files(spark, root), shape))
        return {"sessions": sessions, "observations": observations, "faults": faults}

    return load


#: Endpoints of the search, by the names of their files.
ENDPOINTS = ("pr", "assigned", "author", "mentions")


def _hits(spark: SparkSession, root: str, since: datetime | None = None, now: datetime | None = None) -> dict[str, DataFrame]:
    there = [k for k in ENDPOINTS if _any(spark, f"{root.rstrip('/')}/{k}*.ndjson")]
    if not there:
        raise FileNotFoundError(f"no search hits in {root}")
    frames = {kind: spark.read.text(f"{root.rstrip('/')}/{kind}*.ndjson").select(F.col("value").alias("raw")) for kind in there}
    records, faults = hits.all_endpoints(frames)
    if since:
        records = records.where(F.coalesce("updated_at", "created_at", F.lit(since)) >= F.lit(since).cast("date"))
    return {"records": records, "faults": faults}


def _any(spark: SparkSession, glob: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _tasks(spark: SparkSession, root: str, since: datetime | None = None, now: datetime | None = None) -> dict[str, DataFrame]:
    """Backups (*.csv) and the poll (*.ndjson, see polls.read_poll): of a task in both the later observation stays."""
    from quillmark.operators.joins import newest_wins

    place = root.rstrip("/")
    if not _any(spark, f"{place}/*.csv") and not _any(spark, f"{place}/*.ndjson"):
        raise FileNotFoundError(f"no task backups in {root}")
    made, faults, more = [], [], {}
    if _any(spark, f"{place}/*.csv"):
        parsed = tasks.parse_backups(splits.file_lines(spark.read, f"{place}/*.csv"))
        rows = newest_wins(parsed, "taskid", F.col("modified"), F.col("path"))
        made.append(tasks.csv_records(rows).join(rows.select(F.concat(F.lit("ticktick:"), "taskid").alias("stable_id"), F.col("modified").alias("seen_at")), "stable_id"))
        faults.append(parsed.where("lost > 0").select("path", F.concat("lost", F.lit(" rows without an id")).alias("reason")).distinct())
    if _any(spark, f"{place}/*.ndjson"):
        raw = spark.read.text(f"{place}/*.ndjson").select("value", F.col("_metadata.file_modification_time").alias("modified"))
        poll = polls.read_poll(raw.select("value"))
        records, bad = tasks.api_records(poll.tasks)
        made.append(records.withColumn("seen_at", raw.agg(F.max("modified")).scalar()))
        # a payload is no name for a fault: it may hold anything
        faults.append(bad.select(F.concat(F.lit("polled task "), F.left(F.sha2("raw", 256), F.lit(16))).alias("path"), "reason"))
        more = {"covered": poll.covered, "complete": poll.complete}
    every, told = made[0], faults[0]
    for df, bad in zip(made[1:], faults[1:], strict=True):
        every, told = every.unionByName(df), told.unionByName(bad)
    return {"records": newest_wins(every, "stable_id", F.col("seen_at"), F.col("extra")), "faults": told} | more


def _ended(stored: DataFrame, records: DataFrame) -> DataFrame:
    """Records without those whose older observation says less about the task's end than what is stored.

    Between a stored guess (the end was inferred by a poll) and a record that was seen before it, merge_two_sources
    chooses: a measured end beats the guess, an open task seen earlier doesn't.
    """
    from quillmark.operators.joins import merge_two_sources

    guess = F.get_json_object("extra", "$.provenance") == "api-inferred-complete"
    shape = lambda df, at, origin, inferred: df.select("stable_id", at.alias("observed_at"), F.when(F.array_contains("tags", "completed"), F.col("updated_at")).alias("completed_at"), inferred.alias("inferred"), F.lit(origin).alias("origin"))
    guessed = shape(stored.where(guess), F.col("updated_at"), "stored", F.lit(True))
    seen = shape(records.join(guessed.select("stable_id"), "stable_id", "left_semi"), F.col("seen_at"), "read", F.lit(False))
    won = merge_two_sources(guessed.join(seen.select("stable_id"), "stable_id", "left_semi"), seen, "stable_id")
    lost = won.where("origin = 'stored' AND inferred").select("stable_id")
    return records.join(lost, "stable_id", "left_anti").select(*records.columns)


def _finished_tasks(stored: Callable[[str], DataFrame], frames: dict[str, DataFrame], now: datetime) -> dict[str, DataFrame]:
    """What a poll says by what it doesn't list (polls.poll_diff): records of tasks that are done, the tasks still open, lines to report.

    Tasks that were open at the last complete poll and are absent now are done where the poll covered their project: their
    records are added, marked as inferred. Tasks of other projects stay open and are reported once. A poll that isn't
    complete infers nothing and leaves the open tasks as they were.
    """
    records = _ended(stored("records").where("source = 'ticktick'"), frames["records"])
    plain = records.drop("seen_at")
    if "covered" not in frames:
        return {"records": plain}
    when, source = F.lit(now).cast("timestamp"), F.lit("ticktick")
    before = stored("open_tasks").where("source = 'ticktick'")
    api = records.where((F.get_json_object("extra", "$.provenance") == "api") & F.array_contains("tags", "open"))
    project = F.coalesce(F.nullif(F.get_json_object("extra", "$.project_id"), F.lit("")), F.get_json_object("extra", "$.project_name"))
    polled = api.select(F.substring_index("stable_id", ":", -1).alias("task_id"), project.alias("project_id"))
    complete = bool(frames["complete"].first()["complete"])
    fates = polls.poll_diff(before, polled, frames["covered"], F.lit(complete))
    if not complete:
        line = outbox.lines(frames["complete"], source, "poll", F.lit("ticktick: the poll is not complete, so no task is taken as done"), F.lit("incomplete"), when)
        return {"records": plain, "lines": line}
    done = fates.where("fate = 'completed'").select(F.concat(F.lit("ticktick:"), "task_id").alias("stable_id"))
    open_before = stored("records").where((F.col("source") == "ticktick") & F.array_contains("tags", "open"))
    inferred = open_before.join(done, "stable_id", "left_semi").select(
        "stable_id", "source", "subject", "body", F.transform("tags", lambda t: F.when(t == "open", "completed").otherwise(t)).alias("tags"), "created_at", when.alias("updated_at"),
        F.to_json(F.struct(F.lit("api-inferred-complete").alias("provenance"), F.lit("2").alias("status"), F.lit("true").alias("completed_time_approx"), F.get_json_object("extra", "$.project_id").alias("project_id"))).alias("extra"),
    ).join(plain.select("stable_id"), "stable_id", "left_anti")
    old = before.select("task_id", F.col("missed_at").alias("_missed"), F.col("told_at").alias("_told"), F.col("seen_at").alias("_seen"))
    left = fates.where("fate <> 'completed'").join(old, "task_id", "left")
    there = F.col("fate").isin("open", "new")
    after = left.select(source.alias("source"), "task_id", "project_id", F.when(there, when).otherwise(F.col("_seen")).alias("seen_at"), F.when(~there, F.coalesce("_missed", when)).alias("missed_at"), F.when(~there, F.col("_told")).alias("told_at"))
    missed = fates.where("fate = 'missed'").groupBy("project_id").agg(F.count("*").alias("n"))
    name = F.coalesce("project_id", F.lit("(none)"))
    line = F.concat(F.lit("ticktick: "), F.col("n").cast("string"), F.lit(" open task(s) of project "), name, F.lit(" are absent from a poll that did not cover it; they stay open"))
    lines = outbox.lines(missed, source, "uncovered", line, F.to_json(F.struct("project_id", when.alias("missed_at"))), when)
    count = fates.where("fate = 'completed'").agg(F.count("*").alias("n")).where("n > 0").where(~polled.select(F.lit(1)).exists())
    none = outbox.lines(count, source, "poll", F.concat(F.lit("ticktick: the poll lists no open task at all; "), F.col("n").cast("string"), F.lit(" are recorded as done")), F.lit("empty"), when)
    return {"records": _joined(plain, inferred), "open_tasks": after, "lines": lines.unionByName(none)}


def _joined(records: DataFrame, more: DataFrame) -> DataFrame:
    return records.unionByName(more, allowMissingColumns=True)


def _posts(spark: SparkSession, root: str, since: datetime | None = None, now: datetime | None = None) -> dict[str, DataFrame]:
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(root).select("path", F.col("modificationTime").alias("modified"), "content")
    return {"records": files.post_records(zips)}


def _tree(spark: SparkSession, root: str, since: datetime | None = None, now: datetime | None = None) -> dict[str, DataFrame]:
    records, faults = files.tree_records(files.scan_tree(spark, root, since))
    return {"records": records, "faults": faults}


def _reports(name: str) -> Callable:
    return lambda spark, root, since=None, now=None: {"records": files.report_records(spark, root, name, since)}


SOURCES = {
    s.name: s
    for s in (
        Source("sessions", "entities", _transcripts),
        Source("chatgpt", "entities", _chats("node_map", chats.node_map)),
        Source("claude-web", "entities", _chats("message_list", chats.message_list)),
        Source("github", "records", _hits),
        Source("ticktick", "records", _tasks, _finished_tasks),
        Source("substack", "records", _posts),
        Source("dropbox", "records", _tree),
        Source("research", "records", _reports("research")),
        Source("sota-watch", "records", _reports("sota-watch")),
    )
}


def read_all(spark: SparkSession, roots: dict[str, str]) -> tuple[dict[str, dict[str, DataFrame]], dict[str, str]]:
    """(frames by source, failures by source) of the sources whose roots are given."""
    made, failed = {}, {}
    for name, root in roots.items():
        try:
            made[name] = SOURCES[name].read(spark, root)
        except Exception as e:  # one source's trouble is no other's
            failed[name] = f"{type(e).__name__}: {e}"
    return made, failed
