import datetime as dt

import pytest

from quillmark.engine import Engine, ceiling
from quillmark.operators import tagging
from quillmark.sources import testbed
from quillmark.sources.registry import Source
from quillmark.store import Store, StoreError
from quillmark.streaming import ingest, state
from tests.conftest import SF


def at(day, minute=0):
    return dt.datetime(2024, 1, day, 12, minute, tzinfo=dt.UTC)


@pytest.fixture(scope="module")
def engine(spark):
    records = spark.createDataFrame(
        [("r:1", "dropbox", "Terraform", "the state lock of terraform", ["Infra"], None, at(1), at(5)), ("r:2", "github", "Other", "running a lock", ["x"], ["infra"], at(2), None), ("r:3", "github", "Third", "nothing", [], None, None, at(9))],
        "stable_id string, source string, subject string, body string, tags array<string>, llm_tags array<string>, created_at timestamp, updated_at timestamp",
    )
    sessions = spark.createDataFrame(
        [("s1", "s1", "session", None, "/w", "main", at(3), at(4), "claude-code"), ("s1:a", "s1", "subagent", "a", None, None, at(3), at(3, 30), "claude-code"), ("c1", "c1", "session", None, None, None, at(6), at(7), "chatgpt")],
        "session_id string, root_session_id string, kind string, agent_id string, cwd string, git_branch string, first_ts timestamp, last_ts timestamp, origin string",
    ).selectExpr("*", "cast(null as string) agent_type")
    observations = spark.createDataFrame(
        [("o1", "s1", "s1", "user", at(3), "how does the ERR_TLS_CERT arise", "human"), ("o2", "s1", "s1", "assistant", at(3, 5), "configurations differ", "agent"), ("o3", "s1:a", "s1", "user", at(3, 9), "find the lock", "agent"), ("o4", "c1", "c1", "user", at(6), "crème brûlée", "human")],
        "obs_id string, session_id string, root_session_id string, type string, ts timestamp, body string, provenance string",
    )
    return Engine(records, sessions, observations)


def ids(answer):
    return [i["id"] for i in answer["items"]]


def test_union_is_newest_first_and_pages_lose_nothing(engine):
    whole = engine.query("")
    assert ids(whole) == ["r:3", "c1", "r:1", "s1", "s1:a", "r:2"] and whole["total_matched"] == 6
    seen, token = [], None
    while True:
        page = engine.query("", page_size=2, page_token=token)
        seen += ids(page)
        token = page["next_page_token"]
        if not token:
            break
    assert seen == ids(whole)
    assert "error" in engine.query("other", page_token=engine.query("", page_size=2)["next_page_token"])


def test_words_match_by_stem_and_relax_in_tiers(engine):
    assert ids(engine.query("source:github run")) == ["r:2"]
    relaxed = engine.query("source:dropbox lock unheard")
    assert ids(relaxed) == ["r:1"] and relaxed["lexical_relaxation"] == {"records": "or"} and relaxed["confidence"] == "relaxed"
    prefix = engine.query("source:dropbox terraf")
    assert ids(prefix) == ["r:1"] and prefix["lexical_relaxation"] == {"records": "prefix"}
    gone = engine.query("source:dropbox brunhilde")
    assert ids(gone) == [] and gone["confidence"] == "none_in_corpus"
    filtered = engine.query("source:dropbox nothing")
    assert ids(filtered) == [] and filtered["confidence"] == "none_by_filter"
    assert ids(engine.query("source:dropbox !!!")) == []


def test_sessions(engine):
    assert ids(engine.query("source:sessions ERR_TLS_CERT")) == ["s1"]
    assert ids(engine.query("source:sessions lock")) == ["s1", "s1:a"]
    assert ids(engine.query("type:user by:human")) == ["c1", "s1"]
    assert ids(engine.query("scope:session configuration arise")) == ["s1"]
    assert ids(engine.query("scope:session configuration brulee")) == []
    assert ids(engine.query("source:chatgpt creme")) == ["c1"]
    assert ids(engine.query("session:s1")) == ["s1", "s1:a"] and ids(engine.query("top:s1")) == ["s1"] and ids(engine.query("agent:a")) == ["s1:a"]
    card = engine.query("source:sessions top:s1 lock")["items"][0]
    assert card["matches"] == 1 and card["prompt"].startswith("how does") and card["previews"] == ["find the lock"]


def test_observations_and_wrapping(engine):
    rows = engine.query("source:observations lock")["items"]
    assert [r["id"] for r in rows] == ["o3"] and "[[lock]]" in rows[0]["content"]
    full = engine.query("source:github run", fields="full")["items"][0]
    assert full["content"].startswith('<ExternalContent source="r:2">')


def test_tags_dates_and_mismatches(engine):
    assert ids(engine.query("source:records tag:INFRA")) == ["r:1", "r:2"]
    assert ids(engine.query("source:records from:2024-01-05")) == ["r:3", "r:1"]
    assert engine.query("source:github by:human")["notices"][0]["code"] == "mismatch_sessions_on_records"
    assert "error" in engine.query("by:nobody")
    assert [n["code"] for n in engine.query("source:unheard")["notices"]] == ["unknown_source"]


def test_misses_and_capabilities(engine):
    seen = []
    engine.on_miss = seen.append
    engine.query("source:github zzz")
    engine.on_miss = None
    assert seen == ["source:github zzz"]
    can = engine.capabilities()
    assert can["sources"]["sessions"] == 3 and can["sources"]["github"] == 2


def test_ceiling_cuts_the_long_ones():
    items, cut = ceiling([{"content": "a" * 900}, {"content": "b" * 20}], 600)
    assert cut == 1 and items[1]["content"] == "b" * 20 and items[0]["truncated"] and len(items[0]["content"]) < 600


def test_ingest_is_idempotent_and_redacts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.ready() and store.read("records").count() == 0
    batch = spark.createDataFrame([("a:1", "dropbox", "s", "mail x@y.zz", ["t"], at(1), at(2)), ("a:2", "dropbox", "s", "plain", ["t"], at(1), None)], "stable_id string, source string, subject string, body string, tags array<string>, created_at timestamp, updated_at timestamp")
    first = ingest.write(store, "dropbox", {"records": batch}, "c1")
    again = ingest.write(store, "dropbox", {"records": batch}, "c2")
    assert first.counts["records"] == {"added": 2, "updated": 0, "unchanged": 0} and again.counts["records"] == {"added": 0, "updated": 2, "unchanged": 2}
    rows = {r["stable_id"]: r.asDict() for r in store.read("records").collect()}
    assert rows["a:1"]["body"] == "mail [REDACTED:email]" and rows["a:1"]["llm_tags"] is None and store.manifest()["cursors"] == {"dropbox": "c2"}
    later = batch.selectExpr("stable_id", "source", "subject", "concat(body, '!') body", "tags", "cast(null as timestamp) created_at", "cast(null as timestamp) updated_at")
    ingest.write(store, "dropbox", {"records": later})
    rows = {r["stable_id"]: r.asDict() for r in store.read("records").collect()}
    assert rows["a:2"]["body"] == "plain!" and rows["a:2"]["created_at"] is not None and rows["a:1"]["updated_at"] is not None
    with pytest.raises(StoreError):
        store.commit({}, base=1)
    late = Store(spark, str(tmp_path / "store"))
    late.manifest = lambda: {"version": 1, "schema": 9, "tables": {}, "cursors": {}}
    with pytest.raises(StoreError):  # another writer has made that number
        late.commit({})


def test_the_later_version_of_a_batch_is_stored(spark, tmp_path):
    fields = "stable_id string, source string, subject string, body string, tags array<string>, created_at timestamp, updated_at timestamp"
    versions = [(f"r:{i}", "dropbox", "s", f"{what} {i}", None, created, updated) for i in range(8) for what, created, updated in (("new", None, at(7)), ("old", at(1), at(5)))]
    store = Store(spark, str(tmp_path / "store"))
    assert store.ready()
    ingest.write(store, "dropbox", {"records": spark.createDataFrame(versions, fields)})
    rows = store.read("records").collect()
    assert sorted(r["body"] for r in rows) == [f"new {i}" for i in range(8)]
    assert {(r["created_at"].day, r["updated_at"].day) for r in rows} == {(1, 7)}


def test_orphans_are_left_out(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    sessions = testbed.sessions(spark, SF)
    report = ingest.write(store, "sessions", {"sessions": sessions.where("conv_id < 3"), "observations": testbed.observations(spark, SF)})
    assert report.orphans > 0 and store.read("sessions").count() == 3
    assert store.read("observations").select("session_id").distinct().count() == 3
    made = {"bad": {"records": spark.range(1)}, "good": {"sessions": sessions}}
    sources = {n: Source(n, "x", lambda spark, root, since=None, now=None: made[root]) for n in made}
    done = ingest.run(store, {n: n for n in made}, sources=sources)
    assert done[0].error and not done[1].error and store.read("sessions").count() == sessions.count()


def test_stream_resumes(spark, tmp_path):
    store, inbox = Store(spark, str(tmp_path / "store")), tmp_path / "in"
    make = lambda i: spark.createDataFrame([(f"e:{i}", "events", "s", f"body {i}", at(1), at(i))], "stable_id string, source string, subject string, body string, created_at timestamp, updated_at timestamp")
    read = lambda: spark.readStream.schema(make(1).schema).parquet(str(inbox))
    for i in (1, 2):
        make(i).write.mode("append").parquet(str(inbox))
        ingest.stream_records(store, read(), "events", "updated_at", str(tmp_path / "cp"))
    assert store.read("records").count() == 2 and store.manifest()["cursors"]["events"].startswith("2024-01-02")


def test_state_tables(spark):
    from pyspark.sql import functions as F

    now = F.lit("2024-01-10").cast("timestamp")
    old = spark.createDataFrame([("a", "5", 4, 10), ("b", "7", 9, 1)], "source string, cursor_value string, consecutive_failures long, rows_seen long").selectExpr("*", *[f"cast(null as timestamp) {c}" for c in ("last_run_at", "last_ok_at", "next_attempt_at")], "cast(null as string) last_error")
    runs = spark.createDataFrame([("a", False, None, 0, "boom"), ("b", True, None, 3, None), ("c", True, "1", 2, None)], "source string, ok boolean, cursor_value string, rows_seen long, error string")
    rows = {r["source"]: r.asDict() for r in state.after_run(old, runs, now).collect()}
    assert rows["a"]["consecutive_failures"] == 5 and rows["a"]["cursor_value"] == "5" and rows["a"]["next_attempt_at"] is not None
    assert rows["b"]["consecutive_failures"] == 0 and rows["b"]["cursor_value"] == "7" and rows["b"]["next_attempt_at"] is None and rows["c"]["rows_seen"] == 2
    held = spark.createDataFrame([], "source string, record_key string, error_type string, error_detail string, attempts long, first_seen_at timestamp, last_seen_at timestamp, next_retry_at timestamp")
    failed = spark.createDataFrame([("a", "k", "E", "d")], "source string, record_key string, error_type string, error_detail string")
    for n in (1, 2, 3):
        held = state.quarantine(held, failed, now)
        assert held.first()["attempts"] == n
    assert state.retry_due(held, now).count() == 0 and state.release(held, failed.select("source", "record_key")).count() == 0
    stale = spark.createDataFrame([("a", at(1), 3600)], "source string, input_at timestamp, threshold_seconds int")
    assert state.stale_episodes(stale, stale.limit(0), now).count() == 1 and state.stale_episodes(stale, stale, now).count() == 0


def test_tagging(spark):
    records = testbed.records(spark, SF).limit(40)
    done = tagging.tag(records, lambda bodies: ['["good-tag", "Bad Tag", "good-tag"]' if i % 2 else "no json" for i, _ in enumerate(bodies)])
    rows = done.collect()
    assert rows and all(r["llm_tags"] == ["good-tag"] for r in rows)
    written = tagging.write_tags(records, done)
    assert tagging.pending(written).count() < tagging.pending(records).count() + 1
    filled = tagging.classify_missing(testbed.observations(spark, SF, classified=False).drop("kind"), testbed.sessions(spark, SF))
    assert filled.where("provenance IS NULL").count() == 0
