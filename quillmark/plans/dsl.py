"""The flat query language: key:value tokens and free text, parsed to a QueryAST; routing and page tokens.

A token is split at its first colon. Known keys have fields of their own; other keys are kept in extra, where they only
take part in routing. Tokens without a colon are the text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime, timedelta

from quillmark.model import MACHINE, PROVENANCE, RECORD_ONLY_KEYS, RECORD_SOURCES, SCOPES, SESSION_SOURCES


class DSLError(ValueError):
    """The query can't be read: a bad date, range, author class or scope."""


class PageTokenError(ValueError):
    """The page token is malformed or belongs to another query."""


@dataclass
class QueryAST:
    source: str | None = None
    tags: list[str] = field(default_factory=list)
    from_date: datetime | None = None
    to_date: datetime | None = None
    session_id: str | None = None
    top_session_id: str | None = None
    agent_id: str | None = None
    obs_type: str | None = None
    provenance: str | None = None
    scope: str | None = None
    active_from: datetime | None = None
    active_to: datetime | None = None
    text: str | None = None
    extra: dict[str, str] = field(default_factory=dict)


def _date(value: str, key: str) -> datetime:
    try:
        found = datetime.fromisoformat(value)
    except ValueError:
        raise DSLError(f"{key}: takes YYYY-MM-DD or an ISO 8601 time, not {value!r}") from None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def _one_of(value: str, key: str, allowed: tuple[str, ...]) -> str:
    low = value.strip().lower()
    if low not in allowed:
        raise DSLError(f"{key}: takes one of {', '.join(allowed)}, not {value!r}")
    return low


def _active(value: str) -> tuple[datetime | None, datetime | None]:
    low, dots, high = value.partition("..")
    if not dots:
        raise DSLError(f"active: takes LO..HI, LO.. or ..HI, not {value!r}")
    end = _date(high, "active") if high else None
    if end and re.fullmatch(r"\d{4}-\d{2}-\d{2}", high):  # all of that day
        end += timedelta(days=1, microseconds=-1)
    return (_date(low, "active") if low else None), end


def parse(query: str | None) -> QueryAST:
    ast, text = QueryAST(), []
    plain = {"source": "source", "session": "session_id", "top": "top_session_id", "agent": "agent_id", "type": "obs_type"}
    for token in (query or "").split():
        key, colon, value = token.partition(":")
        key = key.lower()
        if not colon:
            text.append(token)
        elif key in plain:
            setattr(ast, plain[key], value)
        elif key == "tag":
            ast.tags += [t for t in value.split(",") if t]
        elif key == "from":
            ast.from_date = _date(value, key)
        elif key == "to":
            ast.to_date = _date(value, key)
        elif key == "by":
            ast.provenance = _one_of(value, key, (*PROVENANCE, "machine"))
        elif key == "scope":
            ast.scope = _one_of(value, key, SCOPES)
        elif key == "active":
            ast.active_from, ast.active_to = _active(value)
        else:
            ast.extra[key] = value
    ast.text = " ".join(text) or None
    return ast


def has_session_keys(ast: QueryAST) -> bool:
    return any((ast.session_id, ast.top_session_id, ast.agent_id, ast.obs_type, ast.provenance, ast.scope, ast.active_from, ast.active_to))


def route(ast: QueryAST) -> str:
    """records, sessions, union, or one of two mismatches between the source named and the keys used."""
    of_sessions, of_records = has_session_keys(ast), any(k in ast.extra for k in RECORD_ONLY_KEYS)
    if ast.source in SESSION_SOURCES:
        return "mismatch_records_on_sessions" if of_records else "sessions"
    if ast.source in RECORD_SOURCES:
        return "mismatch_sessions_on_records" if of_sessions else "records"
    return "sessions" if of_sessions else "records" if of_records else "union"


def machine_values(value: str) -> tuple[str, ...]:
    return MACHINE if value == "machine" else (value,)


def conjuncts(text: str | None) -> list[list[str]]:
    """What must all match: each word, or each balanced quoted run as one phrase, as index tokens.

    The index splits at underscores too, so a word that has them is a phrase. Unbalanced quotes group nothing.
    """
    parts = (text or "").split('"')
    if len(parts) % 2 == 0:
        parts = [" ".join(parts)]
    out = []
    for i, part in enumerate(parts):
        words = re.findall(r"\w+", part)
        out += [[" ".join(words)]] if i % 2 and words else [[w] for w in words]
    split = [[t for t in re.split(r"[\W_]+", phrase[0].lower()) if t] for phrase in out]
    return [tokens for tokens in split if tokens]


def query_terms(text: str | None, most: int = 32) -> list[str]:
    """Distinct lower-case words of the text, in order."""
    return list(dict.fromkeys(w.lower() for w in re.findall(r"\w+", text or "")))[:most]


def canonical(ast: QueryAST) -> str:
    return json.dumps(asdict(ast), sort_keys=True, default=lambda d: d.isoformat())


def fingerprint(ast: QueryAST) -> str:
    """9 bytes that tell one query from another, as URL-safe text."""
    return base64.urlsafe_b64encode(hashlib.blake2b(canonical(ast).encode(), digest_size=9).digest()).decode()


def page_token(ast: QueryAST, offset: int) -> str:
    return f"{offset}~{fingerprint(ast)}"


def page_offset(ast: QueryAST, token: str | None) -> int:
    """The offset in a token of this very query; a bare number is refused, as it says nothing of the query."""
    if not token:
        return 0
    number, tilde, print_ = token.partition("~")
    if not tilde or not number.isdigit():
        raise PageTokenError(f"not a page token: {token!r}")
    if print_ != fingerprint(ast):
        raise PageTokenError("the page token belongs to another query")
    return int(number)
