"""Incremental ingest: each source reads what is new, bad rows are set aside, and rows, state and reports move in one commit.

A run goes through the sources whose turn it is. A source that waits after failures is passed over, its input is read
from its cursor less an overlap, and a failure is counted and reported without touching the others. A stop that is asked
for takes effect between sources.

Texts are redacted in the plan that reads them: what is staged for a merge, set aside or reported has been through the
layers, and staging is removed however a run ends. Rows are set aside in three ways. Invalid rows are told by rules. Rows
that make their parser fail are found by halves (streaming/isolate.py). Observations whose session isn't known yet are
orphans. The last two are kept as redacted JSON, are tried again when they are due, and hold the source's cursor back in
the run that first meets them.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillmark.functions.recognise import Recogniser
from quillmark.functions.redact import redact, redact_json
from quillmark.functions.scalar import backoff_seconds, fault_key, row_hash
from quillmark.model import KINDS, TABLES
from quillmark.operators import merge
from quillmark.sources.files import inputs_of, newest_input
from quillmark.sources.registry import SOURCES
from quillmark.store import Store, StoreError
from quillmark.streaming import outbox, state
from quillmark.streaming.isolate import Rows, written_apart
from quillmark.workspace import Staging, staging

KEYS = {"records": "stable_id", "sessions": "session_id", "observations": "obs_id"}
HASHED = {
    "records": ("stable_id", "subject", "body", "tags", "extra", "created_at", "updated_at"),
    "sessions": ("session_id", "root_session_id", "kind", "cwd", "git_branch", "first_ts", "last_ts"),
    "observations": ("obs_id", "session_id", "type", "ts", "body"),
}
#: Columns of free text, which every layer of redaction goes through before anything is written; extra is JSON, tags a list.
SCRUBBED = {"records": ("subject", "body", "tags", "extra"), "sessions": ("cwd", "git_branch"), "observations": ("body",)}
#: Times that say which of two rows of a key is the later one, the first that is known.
TIMES = {"records": ("updated_at", "created_at"), "sessions": ("last_ts", "first_ts"), "observations": ("ts",)}
#: Tries of a write, and the wait before the second, which doubles.
TRIES, WAIT_SECONDS = 3, 0.5
MERGED = ("records", "sessions", "observations")
#: How payloads of held rows spell times.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Lines of held rows that one run reports singly; the number of all of them is in the line of the source.
TOLD_SINGLY = 20


@dataclass
class Report:
    """What one source's run did."""

    source: str
    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    faults: int = 0
    orphans: int = 0
    quarantined: int = 0
    cursor: str | None = None
    waiting_until: str | None = None
    error: str | None = None


def _text(df: DataFrame, columns: tuple[str, ...]) -> list[Column]:
    return [F.to_json(F.struct(c)) if df.schema[c].dataType.simpleString().startswith("array") else F.col(c) for c in columns if c in df.columns]


def hashed(df: DataFrame, table: str) -> DataFrame:
    return df.withColumn("src_hash", row_hash(*_text(df, HASHED[table])))


def redacted(df: DataFrame, table: str, recogniser: Recogniser | None = None, layer: Callable[[Column], Column] = redact) -> DataFrame:
    """df with the table's free texts redacted by the layer and then by the recogniser."""
    put = {}
    for c in SCRUBBED[table]:
        if c in df.columns:
            put[c] = redact_json(F.col(c)) if c == "extra" and layer is redact else F.transform(c, layer) if c == "tags" else layer(F.col(c))
    df = df.withColumns(put)
    return recogniser.over(df, [c for c in SCRUBBED[table] if c not in ("tags", "extra")]) if recogniser else df


def coalesced(batch: DataFrame, table: str) -> DataFrame:
    """One row per key of a hashed batch: the latest by time, then by hash; records keep their first created_at and latest updated_at."""
    times = [F.col(c).cast("timestamp") for c in TIMES[table] if c in batch.columns] or [F.lit(None).cast("timestamp")]
    ordered = batch.withColumn("_order", F.struct(F.coalesce(*times).alias("at"), F.col("src_hash")))
    known = lambda c: (c,) if table == "records" and c in batch.columns else ()
    return merge.coalesce_batch(ordered, KEYS[table], "_order", first=known("created_at"), latest=known("updated_at")).drop("_order")


def fault_in(table: str, columns: list[str]) -> Column:
    """Why a row can't be stored, or null."""
    blank = lambda c: F.coalesce(F.btrim(F.col(c).cast("string")), F.lit("")) == ""
    checks = [(blank(KEYS[table]), f"no {KEYS[table]}")]
    if table == "records":
        checks.append((blank("source"), "no source"))
    if table == "sessions" and "kind" in columns:
        checks.append((~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind"))
    if table == "observations":
        checks.append((blank("session_id"), "no session_id"))
    out = F.lit(None).cast("string")
    for bad, why in reversed(checks):
        out = F.when(bad, why).otherwise(out)
    return out


def split_bad(batch: DataFrame, why: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a batch; bad ones have error_detail. A batch that is bad throughout is an error of the source."""
    marked = batch.withColumn("error_detail", why)
    counts = marked.agg(F.count_if(F.col("error_detail").isNull()).alias("good"), F.count("*").alias("n")).first()
    if counts["n"] and not counts["good"]:
        raise ValueError("every row of the batch is bad")
    return marked.where("error_detail IS NULL").drop("error_detail"), marked.where("error_detail IS NOT NULL")


def _shaped(batch: DataFrame, stored: DataFrame) -> DataFrame:
    have = set(batch.columns)
    return batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema.fields])


def _differing(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of new that old doesn't hold as they are."""
    mark = F.sha2(F.to_json(F.struct(*new.columns)), 256)
    return new.withColumn("_mark", mark).join(old.select(key, mark.alias("_mark")), [key, "_mark"], "left_anti").drop("_mark")


# --- staging ---------------------------------------------------------------------------------------------------------


@dataclass
class Batch:
    """What was read of one table: valid rows, redacted and hashed; rows set aside (record_key, error_type, error_detail, payload)."""

    rows: DataFrame
    aside: DataFrame | None
    #: record_key of held rows that were tried again.
    again: DataFrame | None = None
    #: The latest time of the rows that isn't after now.
    top: datetime | None = None


def observed(work: Staging, df: DataFrame, name: str, **what: Column) -> tuple[DataFrame, dict]:
    """df as a staged table, and aggregates of its rows that the job that writes it has seen pass: no job counts them again."""
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    return work.keep(df.observe(seen, *[c.alias(k) for k, c in what.items()]), name), seen.get


def _payload(df: DataFrame) -> Column:
    return redact_json(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "_k"]), _TIMES))


def staged(work: Staging, source: str, table: str, frame: DataFrame | Rows, held: DataFrame | None = None, recogniser: Recogniser | None = None, now: Column | None = None) -> Batch:
    """Read one table of a source and write it beside the store, redacted in the same plan.

    held has the source's quarantine. Raw rows that are held for failing and aren't due are left out; those that are due
    are tried again, from their payload where the input has them no more.
    """
    rows = frame if isinstance(frame, Rows) else Rows(frame, lambda df: df, (KEYS[table],) if KEYS[table] in frame.columns else ())
    keyed, again = rows.keyed(), None
    mark = f"{table}:poison:"
    if held is not None:
        poison = held.where(F.startswith("record_key", F.lit(mark))).withColumn("_k", F.substring("record_key", len(mark) + 1, 40).cast("long"))
        if not poison.isEmpty():
            due = state.retry_due(poison, now)
            keyed = keyed.join(poison.join(due.select("_k"), "_k", "left_anti").select("_k"), "_k", "left_anti")
            fields = [f for f in rows.raw.schema.fields]
            kept = due.where("payload IS NOT NULL").select("_k", F.from_json("payload", rows.raw.schema, _TIMES).alias("r")).select("_k", *[F.col(f"r.`{f.name}`").alias(f.name) for f in fields])
            keyed = keyed.select("_k", *[F.col(f"`{f.name}`") for f in fields]).unionByName(kept.join(keyed.select("_k"), "_k", "left_anti"))
            again = due.select("record_key")

    seen: list[dict] = []

    def write(df: DataFrame) -> DataFrame:
        marked = hashed(df, table).withColumn("error_detail", fault_in(table, df.columns))
        times = [F.col(c).cast("timestamp") for c in TIMES[table] if c in df.columns] or [F.lit(None).cast("timestamp")]
        at = F.coalesce(*times)
        good = F.col("error_detail").isNull()
        top = F.max(F.when(good & (at <= now) if now is not None else good, at))
        part, counts = observed(work, redacted(marked, table, recogniser), table, good=F.count_if(good), n=F.count(F.lit(1)), top=top)
        seen.append(counts)
        return part

    apart = written_apart(keyed, rows.parse, write)
    every = apart.parts[0]
    for part in apart.parts[1:]:
        every = every.unionByName(part)
    counts = {k: sum(c[k] for c in seen) for k in ("good", "n")}
    if counts["n"] and not counts["good"]:
        raise ValueError("every row of the batch is bad")
    plain = every.drop("error_detail")
    name = F.coalesce(F.nullif(F.btrim(F.col(KEYS[table]).cast("string")), F.lit("")), F.sha2(F.to_json(F.struct(*plain.columns)), 256))
    aside = None
    if counts["n"] > counts["good"]:
        bad = every.where("error_detail IS NOT NULL")
        aside = bad.select(F.concat(F.lit(f"{table}:"), redact(name)).alias("record_key"), F.lit("invalid").alias("error_type"), "error_detail", F.to_json(F.struct(*plain.columns), _TIMES).alias("payload"))
    if apart.bad:
        errors = work.spark.createDataFrame(apart.bad, "_k long, error_type string, error_detail string")
        lost = keyed.join(F.broadcast(errors.select("_k")), "_k", "left_semi")  # at most MOST_POISON keys
        # a frame that is no Rows can't show a row that it can't make
        texts = work.keep(lost.select("_k", _payload(lost).alias("payload")), "poison") if isinstance(frame, Rows) else errors.select("_k", F.lit(None).cast("string").alias("payload"))
        told = errors.join(texts.groupBy("_k").agg(F.min("payload").alias("payload")), "_k").select(F.concat(F.lit(mark), F.col("_k").cast("string")).alias("record_key"), F.lit("poison").alias("error_type"), redact(F.concat("error_type", F.lit(": "), "error_detail")).alias("error_detail"), "payload")
        aside = told if aside is None else aside.unionByName(told)
    tops = [c["top"] for c in seen if c["top"] is not None]
    return Batch(every.where("error_detail IS NULL").drop("error_detail"), aside, again, max(tops, default=None))


def staged_faults(work: Staging, found: DataFrame) -> tuple[DataFrame, int]:
    """scope, reason, detail, scope_stamp, line of a source's faults, redacted, and how many there are."""
    have = set(found.columns)
    scope = next((F.col(c).cast("string") for c in ("path", "row", "raw") if c in have), F.lit(None).cast("string"))
    number = F.col("lineno").cast("string") if "lineno" in have else F.lit(None).cast("string")
    stamp = F.col("stamp").cast("string") if "stamp" in have else F.lit(None).cast("string")
    line = F.col("lineno").cast("long") if "lineno" in have else F.lit(None).cast("long")
    told = found.select(redact(scope).alias("scope"), redact(F.col("reason")).alias("reason"), number.alias("detail"), stamp.alias("scope_stamp"), line.alias("line"))
    rows, counts = observed(work, told, "faults", n=F.count(F.lit(1)))
    return rows, counts["n"]


def _faults(store: Store, source: str, found: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The table of permanent faults after a run that found(scope, reason, ..) for this source, and those that are new.

    A fault that is seen again keeps its first time. One that wasn't seen stays while its input hasn't been read anew; with
    a stamp of the input it goes when the stamp has moved.
    """
    key = fault_key(F.col("scope"), F.col("reason"), F.col("detail"))
    seen = found.groupBy(key.alias("fault_key"), "scope", "reason", "detail", "scope_stamp", "line").agg(F.count("*").alias("record_count"))
    old = store.read("poison_faults")
    own = old.where(F.col("source") == source)
    moved = seen.select("scope", F.col("scope_stamp").alias("stamp")).where("stamp IS NOT NULL").distinct()
    stamps = own.join(moved, "scope").select("fault_key", "stamp")
    status = state.reconcile_faults(own, seen, stamps)
    gone = status.where("status = 'released'").select("fault_key")
    first = own.select("fault_key", F.col("first_seen_at").alias("_first"))
    fresh = seen.join(first, "fault_key", "left").select(F.lit(source).alias("source"), "fault_key", "scope", "scope_stamp", "reason", "detail", "record_count", "line", F.coalesce("_first", now).alias("first_seen_at"), now.alias("last_seen_at"))
    rest = own.join(gone, "fault_key", "left_anti").join(seen.select("fault_key"), "fault_key", "left_anti")
    table = old.where(F.col("source") != source).unionByName(rest.select(*old.columns)).unionByName(fresh.select(*old.columns))
    return table, fresh.where(F.col("first_seen_at") == now)


# --- the write -------------------------------------------------------------------------------------------------------


def _state_row(store: Store, source: str, ok: bool, cursor: str | None, rows: int, error: str | None, now: datetime, input_at: datetime | None = None) -> DataFrame:
    """The source's row of ingest_state after a run."""
    made = store.spark.createDataFrame([(source, ok, cursor, rows, error)], "source string, ok boolean, cursor_value string, rows_seen long, error string")
    was = store.read("ingest_state").where(F.col("source") == source)
    kind = state.POLICIES[source].kind if source in state.POLICIES else "none"
    old_input = was.select("input_at").first()
    after = state.after_run(was, made, F.lit(now).cast("timestamp")).withColumn("cursor_kind", F.lit(kind))
    return after.withColumn("input_at", F.lit(input_at or (old_input["input_at"] if old_input else None)).cast("timestamp"))


def _orphans_again(store: Store, due: DataFrame) -> DataFrame:
    """Observations that are held as orphans and due, as they were staged."""
    return due.select(F.from_json("payload", TABLES["observations"], _TIMES).alias("r")).select("r.*").where("obs_id IS NOT NULL")


def write(
    store: Store, source: str, frames: dict[str, DataFrame | Rows], cursor: str | None = None, now: datetime | None = None,
    recogniser: Recogniser | None = None, run: bool = False, input_at: datetime | None = None, finish: Callable | None = None,
    when_read: Callable[[], object] = lambda: None,
) -> Report:
    """Merge the frames of one source into the store and move its state, in one commit.

    Each frame is read once: its rows are redacted and written beside the store, and counts and merge read them there.
    Rows that can't be stored go to quarantine (see above), and leave it when they are written at last. Only rows that
    change are written. A frame read twice changes nothing. With run, the cursor follows from the rows where the source has
    one, and the source's state row is part of the commit. finish(read table, frames, now) may add to the staged frames.
    when_read is called once all frames are staged.
    """
    now = now or datetime.now(UTC)
    when = F.lit(now).cast("timestamp")
    n_faults = 0
    held = store.read("quarantine").where(F.col("source") == source)  # only this source's runs change it
    anything_held = not held.isEmpty()
    with staging(store.spark) as work:
        ready, aside, done, tops, own = {}, [], [], [], {k: v for k, v in frames.items() if k not in (*MERGED, "faults")}
        for table in MERGED:
            if table in frames:
                batch = staged(work, source, table, frames[table], held if anything_held else None, recogniser, when)
                ready[table] = batch.rows
                tops += [batch.top] if batch.top is not None else []
                aside += [batch.aside] if batch.aside is not None else []
                done += [batch.again] if batch.again is not None else []
        own = {k: work.keep(v, k) for k, v in own.items()}
        if "faults" in frames:
            own["faults"], n_faults = staged_faults(work, frames["faults"])
        if run and state.POLICIES.get(source, state.CursorPolicy("none")).kind != "none":  # a row dated ahead skips no input
            cursor = max(tops).astimezone(UTC).isoformat() if tops else None
        when_read()
        with _merging(store):
            return _merged(store, work, source, ready, aside, done, own, held, anything_held, cursor, now, run, input_at, finish, n_faults)


_LOCKS: dict[str, threading.Lock] = {}


def _merging(store: Store) -> threading.Lock:
    """Sources are read side by side in this process and merged one after the other; other processes are told by the version."""
    return _LOCKS.setdefault(store.root, threading.Lock())


def _merged(
    store: Store, work: Staging, source: str, ready: dict[str, DataFrame], aside: list[DataFrame], done: list[DataFrame], own: dict[str, DataFrame], held: DataFrame, anything_held: bool,
    cursor: str | None, now: datetime, run: bool, input_at: datetime | None, finish: Callable | None, n_faults: int,
) -> Report:
    """Merge what was staged into the current version, and commit."""
    when = F.lit(now).cast("timestamp")
    report, deltas, tables, told = Report(source, cursor=cursor, faults=n_faults), {}, {}, []
    base = store.manifest()["version"]
    if finish:
        ready |= finish(store.read, ready | own, now)
    lines = ready.pop("lines", None)
    baseline = ready.pop("open_tasks", None)
    ready = {k: v for k, v in ready.items() if k in MERGED}
    batches: dict[str, DataFrame] = {}
    for table, rows in ready.items():
        key, was = KEYS[table], store.read(table)
        if table == "observations":
            due = state.retry_due(held.where("error_type = 'orphan'"), when)
            if anything_held and not due.isEmpty():
                back = _orphans_again(store, due)
                rows = _shaped(rows, was).unionByName(back.join(rows.select("obs_id"), "obs_id", "left_anti").select(*was.columns))
        own_hash = row_hash(*_text(rows, HASHED[table]))
        batch = coalesced(rows.withColumn("src_hash", F.coalesce("src_hash", own_hash) if "src_hash" in rows.columns else own_hash), table)
        if table == "observations":
            known = store.read("sessions").select("session_id")
            if "sessions" in batches:
                known = known.union(batches["sessions"].select("session_id"))
            flagged = _shaped(batch, was).join(known.distinct().withColumn("_known", F.lit(True)), "session_id", "left")
            flagged, counts = observed(work, flagged.select(*was.columns, "_known"), "observations-all", orphans=F.count_if(F.col("_known").isNull()))
            report.orphans, lost, batch = counts["orphans"], flagged.where("_known IS NULL"), flagged.where("_known").drop("_known")
            if report.orphans:
                aside.append(lost.select(F.concat(F.lit("observations:"), redact(F.col("obs_id"))).alias("record_key"), F.lit("orphan").alias("error_type"), redact(F.concat(F.lit("no session "), "session_id")).alias("error_detail"), F.to_json(F.struct(*was.columns), _TIMES).alias("payload")))
        changed = merge.changes(was.select(key, "src_hash"), _shaped(batch, was), key)
        n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
        marked, report.counts[table] = observed(work, changed, f"{table}-batch", added=n("added"), updated=n("updated", "unchanged"), unchanged=n("unchanged"))
        batch = batches[table] = marked.drop("change")
        done.append(batch.select(F.concat(F.lit(f"{table}:"), redact(F.col(key).cast("string"))).alias("record_key")))
        touched = work.keep(was.join(marked.where("change <> 'added'").select(key), key, "left_semi").select(*was.columns), f"{table}-touched")
        new = merge.upsert_records(touched, batch, lambda c: c) if table == "records" else merge.upsert_entities(touched, batch, key, lambda c: c)
        deltas[table] = _differing(new, touched, key)
    failed = None
    for df in aside:
        failed = df if failed is None else failed.unionByName(df)
    if failed is not None:
        failed = work.keep(failed.withColumn("source", F.lit(source)).dropDuplicates(["source", "record_key"]), "aside")
        kinds = {r["error_type"]: r["n"] for r in failed.groupBy("error_type").agg(F.count("*").alias("n")).collect()}
        report.quarantined = sum(kinds.values())
        told.append(outbox.lines(failed.where("error_type <> 'invalid'").orderBy("record_key").limit(TOLD_SINGLY), F.lit(source), "held", F.concat(F.lit(f"{source}: set aside ("), "error_type", F.lit("): "), "record_key", F.lit(": "), "error_detail"), F.col("record_key"), when))
        fresh = failed.where("error_type <> 'invalid'").join(held.select("record_key"), "record_key", "left_anti")
        if set(kinds) - {"invalid"} and not fresh.isEmpty():
            report.cursor = None  # read again from where it was
    if failed is not None or anything_held:
        every = store.read("quarantine")
        after = state.quarantine(every, failed, when) if failed is not None else every
        if done:
            written = done[0]
            for df in done[1:]:
                written = written.union(df)
            written = written.withColumn("source", F.lit(source))
            after = state.release(after, written if failed is None else written.join(failed.select("record_key"), "record_key", "left_anti"))
        tables["quarantine"] = work.keep(after.select(*[f.name for f in TABLES["quarantine"].fields]), "quarantine")
    if "faults" in own:
        found = own["faults"]
        if report.faults or not store.read("poison_faults").where(F.col("source") == source).isEmpty():
            table, fresh = _faults(store, source, found, when)
            tables["poison_faults"] = work.keep(table, "faults-after")
            line = F.concat(F.lit(f"{source}: "), F.coalesce("scope", F.lit("?")), F.coalesce(F.concat(F.lit(":"), "detail"), F.lit("")), F.lit(": "), "reason")
            told.append(outbox.lines(fresh, F.lit(source), "fault", line, F.col("fault_key"), when))
    if baseline is not None:
        old = store.read("open_tasks")
        tables["open_tasks"] = work.keep(old.where(F.col("source") != source).unionByName(baseline.withColumn("source", F.lit(source)).select(*old.columns)), "open-tasks")
    if lines is not None:
        told.append(lines)
    for df in told:
        df = work.keep(df, "lines")
        if not df.isEmpty():
            deltas["outbox"] = df if "outbox" not in deltas else deltas["outbox"].unionByName(df)
    if run:
        rows_seen = sum(c["added"] + c["updated"] for c in report.counts.values())
        deltas["ingest_state"] = _state_row(store, source, True, report.cursor, rows_seen, None, now, input_at)
    store.commit(tables, {source: report.cursor} if report.cursor else None, base, deltas)
    return report


def write_with_retry(store: Store, source: str, frames: dict, cursor: str | None = None, now: datetime | None = None, tries: int = TRIES, wait: float = WAIT_SECONDS, **how) -> Report:
    """write, tried again after a jittered wait where another writer came first or storage failed; bad input isn't retried."""
    for n in range(tries):
        try:
            return write(store, source, frames, cursor, now, **how)
        except ValueError:
            raise
        except Exception as e:
            if n + 1 == tries or not (isinstance(e, StoreError) or "IOException" in str(e)):
                raise
            time.sleep(backoff_seconds(n, wait, 30.0))
    raise AssertionError("unreachable")


def _failed(store: Store, source: str, error: str, now: datetime) -> None:
    """Count a failure and put it in the outbox."""
    when = F.lit(now).cast("timestamp")
    said = store.spark.createDataFrame([(error,)], "error string").select(redact(F.col("error"))).first()[0]
    row = _state_row(store, source, False, None, 0, said, now)
    line = outbox.lines(store.spark.range(1), F.lit(source), "failure", F.lit(f"{source}: {said[:300]}"), F.lit(source), when, clean=True)
    store.commit(deltas={"ingest_state": row, "outbox": line}, base=store.manifest()["version"])


def _run_one(store: Store, source, root: str, row, now: datetime, recogniser: Recogniser | None, when_read: Callable[[], object]) -> Report:
    """Read one source from its cursor and write it; a failure is counted."""
    name = source.name
    policy = state.POLICIES.get(name, state.CursorPolicy("none"))
    since = None
    if policy.kind != "none" and row and row["cursor_value"]:
        since = datetime.fromisoformat(row["cursor_value"]) - timedelta(seconds=policy.overlap_seconds)
    try:
        frames = source.read(store.spark, root, since=since, now=now)
        newest = newest_input(inputs_of(store.spark, root)).first()["newest"]
        return write_with_retry(store, name, frames, None, now, recogniser=recogniser, run=True, input_at=newest, finish=source.finish, when_read=when_read)
    except Exception as e:  # one source's failure is counted and the others go on
        report = Report(name, error=f"{type(e).__name__}: {str(e)[:500]}")
        store.spark.sparkContext.setJobGroup(f"ingest-{name}-failed", "count a failure")  # a group that was cancelled may stay so
        with _merging(store):
            _failed(store, name, report.error, now)
        return report


def run(
    store: Store, roots: dict[str, str], now: datetime | None = None, stop: Callable[[], bool] | None = None, sources: dict | None = None, recogniser: Recogniser | None = None,
    workers: int = 1, most_seconds: float | None = None,
) -> list[Report]:
    """One run over the sources whose roots are given, each by its cursor policy; each commits its rows and its state together.

    So many workers read sources at once, each in a scheduler pool and a job group of its own; merges follow one another. A
    source that isn't read after most_seconds has its jobs cancelled, which counts as its failure; nothing of it is stored.
    """
    now = now or datetime.now(UTC)
    known = sources or SOURCES
    past = {r["source"]: r for r in store.read("ingest_state").collect()}
    sc, begun, over = store.spark.sparkContext, {}, threading.Event()

    def one(name: str, root: str) -> Report | None:
        if stop and stop():
            return None
        row = past.get(name)
        wait = row["next_attempt_at"] if row else None
        if wait is not None and wait.astimezone(UTC) > now:
            return Report(name, waiting_until=wait.astimezone(UTC).isoformat())
        sc.setLocalProperty("spark.scheduler.pool", f"ingest-{name}")
        sc.setJobGroup(f"ingest-{name}", f"ingest of {name}", interruptOnCancel=True)
        begun[name] = time.monotonic()
        try:
            return _run_one(store, known[name], root, row, now, recogniser, lambda: begun.pop(name, None))
        finally:
            begun.pop(name, None)
            sc.setLocalProperty("spark.scheduler.pool", None)
            sc.setLocalProperty("spark.jobGroup.id", None)

    def watch() -> None:
        while not over.wait(0.2):
            for name, at in list(begun.items()):
                if time.monotonic() - at > most_seconds:
                    sc.cancelJobGroup(f"ingest-{name}")

    if most_seconds is not None:
        threading.Thread(target=watch, daemon=True).start()
    try:
        if workers == 1:
            made = [one(name, root) for name, root in roots.items()]
        else:
            with ThreadPoolExecutor(workers) as pool:
                made = list(pool.map(lambda x: one(*x), roots.items()))
    finally:
        over.set()
    return [r for r in made if r is not None]


def stale(store: Store, now: datetime | None = None) -> list[dict]:
    """Sources whose newest input is older than their policy allows; each goes into the outbox once an episode.

    An episode ends when the input is newer or the limit another. A source without dated input goes by its last good run.
    What silences an episode is that its line was acknowledged (outbox.py); until then the line stays there.
    """
    when = F.lit(now or datetime.now(UTC)).cast("timestamp")
    limits = F.create_map(*[F.lit(x) for k, p in state.POLICIES.items() for x in (k, p.stale_seconds)])
    ok = store.read("ingest_state").where("last_ok_at IS NOT NULL")
    inputs = ok.select("source", F.coalesce("input_at", "last_ok_at").alias("input_at"), F.element_at(limits, F.col("source")).cast("long").alias("threshold_seconds")).where("threshold_seconds IS NOT NULL")
    subject = F.to_json(F.struct("input_at", "threshold_seconds"))
    with staging(store.spark) as work:
        open_lines = outbox.pending(store).where("kind = 'stale'").select("source", "subject")
        new = state.stale_episodes(inputs, store.read("stale_told"), when).withColumn("subject", subject).join(open_lines, ["source", "subject"], "left_anti")
        new = work.keep(new, "stale")
        rows = [r.asDict() for r in new.drop("subject").collect()]  # a row a source at most
        if rows:
            line = F.concat("source", F.lit(": no input newer than "), F.date_format("input_at", "yyyy-MM-dd HH:mm"), F.lit(", allowed are "), (F.col("threshold_seconds") / 3600).cast("long").cast("string"), F.lit(" hours"))
            store.commit(deltas={"outbox": outbox.lines(new, F.col("source"), "stale", line, F.col("subject"), when)})
    return rows


def stream_records(store: Store, stream: DataFrame, source: str, cursor: str, checkpoint: str) -> None:
    """Read a stream of records to its present end. A batch that is replayed merges into what it already wrote."""

    def one(batch: DataFrame, batch_id: int) -> None:
        top = batch.agg(F.max(cursor).cast("string")).first()[0]
        if top is not None:
            write_with_retry(store, source, {"records": batch}, top)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
