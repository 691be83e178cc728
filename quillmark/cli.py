"""python -m quillmark.cli STORE COMMAND ..

ingest SOURCE=DIR ..                  read what is new in each source
query TEXT                            one page of answers; a query without any is logged as a miss
status | stale | migrate              counts, cursors, faults and quarantine; sources whose input is old; old stores
deliver SPOOL                         send what runs have to tell as a batch of files in SPOOL, and acknowledge what was sent
rescrub [--write] [--all]             rows that today's secret patterns (or all layers) would change
provenance                            author classes of turns that lack one
tag MODULE:FUNCTION [N]               tags by a model (texts to JSON lists of words) for the next N rows that need them
rebuild SOURCE=DIR [--force]          replace all rows of one source; refuses a great loss
rebuild-all SOURCE=DIR .. [--force]   the same for several, in one version
freeze GOLDEN FILE                    rankings of the golden queries, kept in FILE
regress GOLDEN FILE                   how rankings have moved since
"""

from __future__ import annotations

import importlib
import json
import signal
import sys
import threading
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.engine import Engine
from quillmark.evals import harness
from quillmark.functions.recognise import Recogniser
from quillmark.functions.redact import redact, redact_secrets
from quillmark.operators import aggregates, backfill, merge, tagging
from quillmark.sources.registry import SOURCES
from quillmark.model import KEYS
from quillmark.store import Store
from quillmark.streaming import ingest, outbox
from quillmark.workspace import Staging, staging, stored

DONE, FAILED, MISUSED, EMPTY = 0, 1, 2, 3
#: Sources that an ingest reads at once.
WORKERS = 4
SCRUBBED = {"records": ("subject", "body"), "observations": ("body",)}


def _roots(args: list[str]) -> dict[str, str] | None:
    """SOURCE=DIR pairs; None if one isn't a pair of a known source and a place, or a source comes twice."""
    pairs = [x.split("=", 1) for x in args if "=" in x]
    names = [p[0] for p in pairs]
    if not pairs or len(pairs) != len(args) or len(set(names)) != len(names) or not all(n in SOURCES and d for n, d in pairs):
        return None
    return dict(pairs)


def _rebuilt(store: Store, name: str, root: str, force: bool, work: Staging, recogniser: Recogniser | None, read: Callable[[str], DataFrame]) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Tables with all rows of one source replaced, and its rows per table."""
    made, out, tables = SOURCES[name].read(store.spark, root), {}, {}
    for table in ("records", "sessions", "observations"):
        if table not in made:
            continue
        was = read(table)
        batch = ingest.staged(work, name, table, made[table], None, recogniser)
        rows = work.keep(ingest._shaped(ingest.coalesced(batch.rows, table), was), f"{table}-rows")
        if table == "observations":
            own = tables["sessions"].where(F.col("origin") == _origin(name)).select("session_id") if "sessions" in tables else read("sessions").select("session_id")
            before = was.join(read("sessions").where(F.col("origin") == _origin(name)).select("session_id"), "session_id", "left_semi").select(*was.columns)
            merge.guard_shrink(before.count(), rows.count(), force)
            tables[table] = was.join(before.select("obs_id"), "obs_id", "left_anti").select(*was.columns).unionByName(rows.join(own, "session_id", "left_semi").select(*was.columns))
        else:
            scope, value = ("source", name) if table == "records" else ("origin", _origin(name))
            tables[table] = merge.rebuild(was, rows, scope, value, force)
        out[table] = rows.count()
    return {t: work.keep(df, f"{t}-rebuilt") for t, df in tables.items()}, out


def rebuild(store: Store, name: str, root: str, force: bool = False, recogniser: Recogniser | None = None) -> dict[str, int]:
    """Replace all rows of one source by what its input holds now; rows per table."""
    base = store.manifest()["version"]
    with staging(store.spark) as work:
        tables, out = _rebuilt(store, name, root, force, work, recogniser, store.read)
        store.commit(tables, base=base)
    return out


def rebuild_all(store: Store, roots: dict[str, str], force: bool = False, recogniser: Recogniser | None = None) -> tuple[dict[str, dict[str, int]], dict[str, str]]:
    """The same for several sources, in one version: (rows, errors) by source. A source that fails keeps its rows, the others go on."""
    base, out, failed = store.manifest()["version"], {}, {}
    with staging(store.spark) as work:
        now: dict[str, DataFrame] = {}
        read = lambda t: now[t] if t in now else store.read(t)
        for name, root in roots.items():
            try:
                tables, out[name] = _rebuilt(store, name, root, force, work, recogniser, read)
                now |= tables
            except Exception as e:
                failed[name] = f"{type(e).__name__}: {str(e)[:500]}"
        if now:
            store.commit(now, base=base)
    return out, failed


def _origin(name: str) -> str:
    return "claude-code" if name == "sessions" else name


def rescrub(store: Store, layer, write: bool, recogniser: Recogniser | None = None) -> dict[str, int]:
    """Rows by table that the layer, and then the recogniser, change; written only where the text is still the one that was read."""
    base, out, deltas = store.manifest()["version"], {}, {}
    with staging(store.spark) as work:
        for table, columns in SCRUBBED.items():
            rows = store.read(table)
            changed = work.keep(merge.rescrub_rows(rows, columns, layer), f"rescrub-{table}")
            if recogniser:
                key = KEYS[table][0]
                rest = rows.join(changed.select(key), key, "left_anti").select(*rows.columns).unionByName(changed)
                found = work.keep(recogniser.over(rest, columns), f"rescrub-{table}-found")
                changed = work.keep(ingest._differing(found, rows, key), f"rescrub-{table}-both")
            if n := changed.count():
                out[table], deltas[table] = n, changed
        if write and deltas:
            store.commit(deltas=deltas, base=base)
    return out


def status(store: Store) -> dict:
    ledger = lambda t: [{k: str(v) if isinstance(v, datetime) else v for k, v in r.asDict().items()} for r in store.read(t).collect()]
    held = store.read("quarantine")
    return {
        "version": store.manifest()["version"], "rows": {r["name"]: r["n"] for r in aggregates.count_by_source(store.read("records"), store.read("sessions")).collect()},
        "sources": ledger("ingest_state"),
        "faults": {r["source"]: r["count"] for r in store.read("poison_faults").groupBy("source").count().collect()},
        "quarantine": [r.asDict() for r in ingest.state.quarantine_summary(held).collect()],
        "unread_lines": outbox.pending(store).count(),
        "uncovered": [r.asDict() for r in store.read("open_tasks").where("missed_at IS NOT NULL").groupBy("source", "project_id").agg(F.count("*").alias("tasks"), F.min("missed_at").cast("string").alias("since")).collect()],
        "tags": [r.asDict() for r in aggregates.tag_progress(store.read("records")).collect()],
        "unclassified": aggregates.unclassified(store.read("observations")).first()["n"],
    }


def _asked_to_stop() -> list[int]:
    """A list that a SIGTERM fills; work that has begun (a source, a chunk) is finished."""
    asked: list[int] = []
    if threading.current_thread() is threading.main_thread():
        signal.signal(signal.SIGTERM, lambda *_: asked.append(1))
    return asked


def main(args: list[str], spark: SparkSession | None = None) -> int:
    """0: done; 1: something failed; 2: used wrongly; 3: nothing ingested yet."""
    if len(args) < 2:
        print(__doc__)
        return MISUSED
    spark = spark or SparkSession.builder.appName("quillmark").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()
    store, command, rest = Store(spark, args[0]), args[1], [a for a in args[2:] if not a.startswith("--")]
    flags = {a for a in args[2:] if a.startswith("--")}
    if command in ("ingest", "rebuild", "rebuild-all"):
        roots = _roots(rest)
        if roots is None or (command == "rebuild" and len(roots) != 1) or flags - ({"--force"} if command != "ingest" else set()):
            print(__doc__)
            return MISUSED
        if command == "ingest":
            asked = _asked_to_stop()
            reports = ingest.run(store, roots, stop=lambda: bool(asked), workers=WORKERS)
            for r in reports:
                print(json.dumps(vars(r)))
            return FAILED if any(r.error for r in reports) else DONE
        done, failed = rebuild_all(store, roots, "--force" in flags)
        for name in roots:
            print(json.dumps({"source": name, "error": failed[name]} if name in failed else {"source": name, "rows": done[name]}))
        return FAILED if failed else DONE
    if why := store.ready():
        print(why)
        return EMPTY
    if command == "query":
        misses: list[str] = []
        answer = Engine.of_store(store, on_miss=misses.append).query(" ".join(rest))
        print(json.dumps(answer, default=str, ensure_ascii=False))
        if misses:
            store.commit(deltas={"misses": spark.createDataFrame([(q, datetime.now(UTC)) for q in misses], "query string, at timestamp")})
        return MISUSED if "error" in answer else DONE
    if command == "status":
        print(json.dumps(status(store), default=str))
        return DONE
    if command == "stale":
        told = ingest.stale(store)
        for row in told:
            print(json.dumps(row, default=str))
        return FAILED if told else DONE
    if command == "deliver" and len(rest) == 1:
        print(outbox.deliver(store, rest[0]))
        return DONE
    if command == "migrate":
        print("migrated" if store.migrate() else "up to date")
        return DONE
    if command == "rescrub":
        print(json.dumps(rescrub(store, redact if "--all" in flags else redact_secrets, "--write" in flags)))
        return DONE
    if command == "provenance":
        asked = _asked_to_stop()
        print(backfill.backfill(store, stop=lambda: bool(asked)))
        return DONE
    if command == "tag" and 1 <= len(rest) <= 2 and ":" in rest[0]:
        module, name = rest[0].split(":", 1)
        model = getattr(importlib.import_module(module), name)
        records = store.read("records")
        wanted = stored(tagging.pending(records).limit(int(rest[1]) if len(rest) == 2 else 1000), "tag-wanted")
        tagged = stored(tagging.tag(wanted, model), "tag-done")
        rows = records.join(tagged.select("stable_id"), "stable_id", "left_semi").select(*records.columns)
        store.commit(deltas={"records": stored(tagging.write_tags(rows, tagged), "tag-rows")})
        print(tagged.count())
        return DONE
    if command in ("freeze", "regress") and len(rest) == 2:
        with open(rest[0], encoding="utf-8") as f:
            golden = harness.load_golden(f.read())
        engine = Engine.of_store(store)
        search = lambda q, k: [i["id"] for i in engine.query(q, page_size=k).get("items", [])]
        results = harness.run_queries(spark, golden, search)
        if command == "freeze":
            with open(rest[1], "w", encoding="utf-8") as f:
                f.write(json.dumps([r.asDict() for r in harness.freeze(results).collect()], ensure_ascii=False))
            return DONE
        with open(rest[1], encoding="utf-8") as f:
            frozen = spark.createDataFrame([(r["query"], r["id"], r["rank"]) for r in json.load(f)], "query string, id string, rank int")
        print(harness.report(harness.compare(results, frozen)))
        return DONE
    print(__doc__)
    return MISUSED


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
