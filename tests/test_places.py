"""All pages of an answer at once, and what a query costs."""

import datetime as dt

import pytest

from quillmark.engine import Engine
from quillmark.functions import text as T


def at(hour):
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(hours=hour)


@pytest.fixture
def engine(spark):
    records = spark.createDataFrame(
        [(f"r:{i}", "src", "", f"the word {i}", ["en"], None, at(99 - i), None if i % 3 == 0 else at(i)) for i in range(20)],
        "stable_id string, source string, subject string, body string, tags array<string>, llm_tags array<string>, created_at timestamp, updated_at timestamp",
    )
    sessions = spark.createDataFrame(
        [(f"s{i}", f"s{i}", "session", None, "/w", None, at(i), at(i), "claude-code", None) for i in range(5)],
        "session_id string, root_session_id string, kind string, agent_id string, cwd string, git_branch string, first_ts timestamp, last_ts timestamp, origin string, agent_type string",
    )
    turns = spark.createDataFrame(
        [(f"o{i}", f"s{i % 5}", f"s{i % 5}", "user", None if i == 7 else at(i % 4), f"the turn {i}", "human") for i in range(13)],
        "obs_id string, session_id string, root_session_id string, type string, ts timestamp, body string, provenance string",
    )
    return Engine(records, sessions, turns, stem=False)


def walked(engine, text, size):
    out, token = [], None
    while True:
        page = engine.query(text, page_size=size, page_token=token)
        assert len(page["items"]) <= size
        out += [(len(out) + k, i["id"], page["total_matched"]) for k, i in enumerate(page["items"])]
        token = page["next_page_token"]
        if not token:
            return out


@pytest.mark.parametrize("text", ["tag:en the", "source:records the", "source:observations type:user the", "the", "source:sessions the", "source:records zzz"])
def test_places_are_those_of_the_pages(engine, text):
    placed = sorted(tuple(r) for r in engine.places(text).select("place", "id", "total").collect())
    assert placed == walked(engine, text, 6) == walked(engine, text, 100)


def test_records_without_a_date_of_change_come_last(engine):
    ids = [i for _, i, _ in walked(engine, "tag:en the", 6)]
    assert ids == [f"r:{i}" for i in range(19, 0, -1) if i % 3] + sorted(f"r:{i}" for i in range(0, 20, 3))


def test_items_keep_their_bodies(engine):
    turn = engine.query("source:observations 11")["items"]
    assert [(i["id"], i["content"]) for i in turn] == [("o11", "the turn [[11]]")]
    assert "the word 7" in engine.query("source:records word 7", fields="full")["items"][0]["content"]


def test_a_query_searches_its_texts_once_however_many_pages_there_are(engine, spark, monkeypatch):
    """Each text is made into words by one pass; the pages of a long answer are dealt by places, not by as many queries."""
    import quillmark.servicequeries as Q

    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        import pandas as pd
        from pyspark.sql import functions as F

        def words(texts: pd.Series) -> pd.Series:
            seen.add(len(texts))
            return texts.map(lambda t: f" {t.strip()} ")

        return F.pandas_udf(words, "string")(T.token_text(text))

    monkeypatch.setattr("quillmark.engine.token_text", counted)
    engine = Engine(engine.records.drop("terms"), engine.sessions, engine.observations.drop("terms"), stem=False)
    assert engine.query("source:records the")["total_matched"] == 20 and seen.value == 20
    monkeypatch.setattr(Engine, "query", None)
    assert Q._all_pages(engine, "source:records the").count() == 20 and seen.value == 40
