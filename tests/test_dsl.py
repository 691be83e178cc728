from datetime import UTC, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillmark.plans import dsl


def test_keys_and_text():
    ast = dsl.parse("source:github tag:a,,b from:2024-01-02 power-on state:open x:y:z Words")
    assert (ast.source, ast.tags, ast.text) == ("github", ["a", "b"], "power-on Words")
    assert ast.from_date == datetime(2024, 1, 2, tzinfo=UTC)
    assert ast.extra == {"state": "open", "x": "y:z"}


def test_active_covers_the_whole_last_day():
    ast = dsl.parse("active:..2024-01-03")
    assert ast.active_from is None and ast.active_to == datetime(2024, 1, 3, 23, 59, 59, 999999, tzinfo=UTC)
    assert dsl.parse("to:2024-01-03").to_date == datetime(2024, 1, 3, tzinfo=UTC)
    assert dsl.parse("active:..").active_to is None


@pytest.mark.parametrize("bad", ["from:yesterday", "by:robot", "scope:sessions", "active:2024-01-01"])
def test_bad_values(bad):
    with pytest.raises(dsl.DSLError):
        dsl.parse(bad)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("power-on", [["power"], ["on"]]),
        ('"low usage cap" now', [["low", "usage", "cap"], ["now"]]),
        ('"unbalanced quote', [["unbalanced"], ["quote"]]),
        ("ERR_TLS_CERT", [["err", "tls", "cert"]]),
        ("!!! ___", []),
        ("Überfall 日本", [["überfall"], ["日本"]]),
    ],
)
def test_conjuncts(text, want):
    assert dsl.conjuncts(text) == want


@pytest.mark.parametrize(
    ("query", "mode"),
    [
        ("", "union"), ("word", "union"), ("by:human", "sessions"), ("scope:observation", "sessions"), ("source:chatgpt", "sessions"), ("source:dropbox", "records"),
        ("state:open", "records"), ("source:dropbox type:user", "mismatch_sessions_on_records"), ("source:sessions check:ok", "mismatch_records_on_sessions"), ("source:nothing", "union"),
    ],
)
def test_route(query, mode):
    assert dsl.route(dsl.parse(query)) == mode


def test_page_tokens_belong_to_their_query():
    one, other = dsl.parse("tag:a word"), dsl.parse("tag:b word")
    token = dsl.page_token(one, 40)
    assert dsl.page_offset(one, token) == 40 and dsl.page_offset(one, None) == 0
    for bad in ("40", "x~y", token + "0"):
        with pytest.raises(dsl.PageTokenError):
            dsl.page_offset(one, bad)
    with pytest.raises(dsl.PageTokenError):
        dsl.page_offset(other, token)


@given(st.text(max_size=60))
def test_any_text_splits_into_word_characters_only(text):
    for phrase in dsl.conjuncts(text):
        assert phrase and all(t and all(c.isalnum() for c in t) for t in phrase)
