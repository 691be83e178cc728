"""Sources side by side, indexes made anew beside the live ones, backfills that go on where they stopped, lines of large files."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quillmark.engine import Engine
from quillmark.operators import backfill
from quillmark.sources.registry import Source
from quillmark.sources.splits import numbered_lines
from quillmark.store import Store
from quillmark.streaming import ingest
from tests.test_ingest import at, line, records, write_lines


def test_sources_overlap_and_one_that_hangs_is_cancelled(spark, tmp_path):
    store, spans = Store(spark, str(tmp_path / "store")), {}

    def slow(name, seconds):
        def read(spark, root, since=None, now=None):
            began = time.monotonic()

            def wait(rows):
                time.sleep(seconds)
                yield from rows

            frame = records(spark, (f"{name}:1", "s", "b", 2)).withColumn("source", F.lit(name))
            spark.range(0, 1, 1, 1).mapInPandas(wait, "id long").count()
            spans[name] = (began, time.monotonic())
            return {"records": frame}

        return Source(name, "records", read)

    sources = {"research": slow("research", 2), "sota-watch": slow("sota-watch", 2), "dropbox": slow("dropbox", 300)}
    began = time.monotonic()
    reports = ingest.run(store, dict.fromkeys(sources, "x"), now=at(3), sources=sources, workers=3, most_seconds=30)
    assert time.monotonic() - began < 120
    by = {r.source: r for r in reports}
    assert list(by) == list(sources) and not by["research"].error and not by["sota-watch"].error and by["dropbox"].error
    (a, b), (c, d) = spans["research"], spans["sota-watch"]
    assert max(a, c) < min(b, d)
    assert {r["stable_id"] for r in store.read("records").collect()} == {"research:1", "sota-watch:1"}
    assert {r["source"]: r["consecutive_failures"] for r in store.read("ingest_state").collect()} == {"research": 0, "sota-watch": 0, "dropbox": 1}


def test_an_index_is_made_anew_beside_the_live_one(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    ingest.write(store, "research", {"records": records(spark, ("r:1", "s", "first word", 2), ("r:2", "s", "second word", 2))})
    ingest.write(store, "research", {"records": records(spark, ("r:2", "s", "changed word", 3))})
    before, seen, write_index = store.manifest(), [], Store._write_index

    def slow(self, table, rows, kind):
        if kind == "rebuilt" and not seen:
            seen.append(Engine.of_store(store).query("source:research word")["total_matched"])  # the old index answers
            ingest.write(store, "research", {"records": records(spark, ("r:3", "s", "third word", 3))})  # and goes on
        return write_index(self, table, rows, kind)

    monkeypatch.setattr(Store, "_write_index", slow)
    store.reindex()
    after = store.manifest()
    paths = lambda m: [m["tables"]["records"]["base"], *m["tables"]["records"]["deltas"]]
    assert seen == [2] and paths(after)[: len(paths(before))] == paths(before) and after["version"] == before["version"] + 2
    assert all("rebuilt" in p for p in after["tables"]["records"]["index"]) and len(after["tables"]["records"]["index"]) == 3
    assert Engine.of_store(store).query("source:research word")["total_matched"] == 3 and Engine.of_store(store).query("source:research second")["total_matched"] == 0


def test_an_old_tokenizer_is_migrated_without_writing_bodies(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingest.write(store, "research", {"records": records(spark, ("r:1", "s", "word", 2))})
    now = store.manifest()
    store._publish(now | {"version": 2, "tokenizer": 1})
    assert store.migrate() and not store.migrate() and store.manifest()["tables"]["records"]["deltas"] == now["tables"]["records"]["deltas"]
    store._publish(store.manifest() | {"version": 4, "schema": 9})
    assert store.migrate() and store.manifest()["version"] == 5 and Engine.of_store(store).query("source:research word")["total_matched"] == 1


def test_a_backfill_goes_on_where_it_stopped(spark, tmp_path):
    store, root = Store(spark, str(tmp_path / "store")), tmp_path / "t"
    names = [f"s{i}" for i in range(12)]
    for n in names:
        write_lines(root / f"{n}.jsonl", [line(f"{n}:u", n, "hello", 1) | ({"isMeta": True} if n in names[:6] else {})], at(1))
    ingest.run(store, {"sessions": str(root)}, now=at(3))
    gone = store.read("observations").withColumn("provenance", F.lit(None).cast("string"))
    store.commit({"observations": gone})
    (root / "s0.jsonl").unlink()  # its archive is gone: the text decides
    asked = []
    first = backfill.backfill(store, chunk_rows=4, stop=lambda: len(asked) >= 1 or asked.append(1))
    left = store.read("observations").where("provenance IS NULL").count()
    assert 0 < first < 12 and left == 12 - first
    assert backfill.backfill(store, chunk_rows=4) == left and backfill.backfill(store) == 0
    assert {r["session_id"]: r["provenance"] for r in store.read("observations").collect()} == {n: "system" if n in names[1:6] else "human" for n in names}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines_of_a_file_that_many_tasks_read(spark, tmp_path, end):
    words = [json.dumps({"n": i, "t": "é" * (i * 37 % 400)}) if i % 11 else "" for i in range(20_000)]
    for name, rows in (("a", words), ("b", words[:7]), ("c", [])):
        (tmp_path / f"{name}.jsonl").write_bytes(end.join(rows).encode() + (end.encode() if name == "a" else b""))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        lines = numbered_lines(spark.read, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20  # so are the splits
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    got = {(r["path"][-7:-6], r["lineno"]): r["raw"] for r in rows}
    assert len(got) == len(rows) and all(got[("a", i + 1)] == w for i, w in enumerate(words)) and all(got[("b", i + 1)] == w for i, w in enumerate(words[:6]))


NASTY = ['a,b"c', "\\", '\\"', "[{", "}]", ",", "", "é\n\t,", '"', "\\\\,\"", "x" * 5000, "]}," * 50]


def test_elements_of_an_array_that_many_tasks_read(spark, tmp_path):
    from quillmark.sources.splits import json_elements

    want = [{"i": i, "t": [NASTY[i % len(NASTY)], {"k": NASTY[(i * 5) % len(NASTY)]}], "e": [], "o": {}} for i in range(1500)]
    (tmp_path / "a.json").write_text(json.dumps(want, indent=1, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(want[:3], separators=(",", ":")))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text('﻿ [1 , "x,y", null , [] ] \n')
    (tmp_path / "e.json").write_text('{"no": "array"}')
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        rows = json_elements(spark.read, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    got = {}
    for r in rows:
        got.setdefault(r["path"][-6:-5], {})[r["first"]] = r["value"]
    assert [json.loads(got["a"][i])[0] for i in range(1500)] == want and len(got["a"]) == 1500
    assert [json.loads(got["b"][i])[0] for i in range(3)] == want[:3] and "c" not in got and [json.loads(got["d"][i])[0] for i in range(4)] == [1, "x,y", None, []]


def test_a_conversation_that_is_cut_off_is_a_fault_and_the_others_are_read(spark, tmp_path):
    from quillmark.sources.registry import SOURCES

    chat = lambda i: {"uuid": f"c{i}", "name": "n", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z", "chat_messages": [{"uuid": f"m{i}", "sender": "human", "text": "hi", "created_at": "2024-01-01T00:00:00Z", "content": []}]}
    (tmp_path / "x.json").write_text(json.dumps([chat(i) for i in range(5)])[:-40])
    frames = SOURCES["claude-web"].read(spark, str(tmp_path))
    assert {r["session_id"] for r in frames["sessions"].collect()} == {f"claude-web:c{i}" for i in range(4)} and frames["faults"].count() == 1
