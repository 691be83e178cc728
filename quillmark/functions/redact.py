"""Redaction as one Catalyst expression: secrets, then card numbers that pass Luhn, then patterns of personal data.

Nothing is caught or skipped: an error in the expression fails the write.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import let

# Labels and patterns, in the order in which they are applied.
PII_PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "phone": r"\+?\d{1,3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{4}",
}

#: Public shapes of access tokens.
SECRET_PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})\b",
    "api_key": r"\bsk-[A-Za-z0-9_-]{20,}",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
CARD = PII_PATTERNS["credit_card"]

#: What a text must hold for a pattern to match anywhere; looked for before the pattern is tried. None of the marks put in
#: holds any of these, so a text that lacks them at first lacks them throughout.
_NEEDS = {
    "ssn": ("-",), "email": ("@",), "iban": None, "ipv6": (":",), "ipv4": (".",), "credit_card": None, "phone": None,
    "private_key": ("PRIVATE KEY",), "aws_key": ("AKIA", "ASIA"), "github_token": ("gh",), "api_key": ("sk-",), "slack_token": ("xox",), "jwt": ("eyJ",),
}
_TWO_DIGITS = {"ssn", "iban", "credit_card", "phone"}
_ANY = r"[0-9]{2}|[@:]|[0-9]\.|PRIVATE KEY|AKIA|ASIA|gh[pousri]|sk-|xox[abprs]-|eyJ"


def mark(label: str) -> str:
    return f"[REDACTED:{label}]"


def _may(text: Column, label: str) -> Column:
    """Could the pattern of this label match? Never false where it does."""
    needs = _NEEDS[label]
    said = reduce(or_, [F.contains(text, F.lit(x)) for x in needs]) if needs else F.lit(True)
    return said & F.rlike(text, F.lit("[0-9]{2}")) if label in _TWO_DIGITS else said


def _valid_cards(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({CARD})"), F.lit(1))
    return F.filter(found, lambda x: F.call_function("luhn_check", F.regexp_replace(x, r"\D", "")))


def redact_cards(text: Column) -> Column:
    def put(x: Column) -> Column:
        done = F.aggregate(F.array_distinct(_valid_cards(x)), x, lambda acc, card: F.replace(acc, card, F.lit(mark("credit_card"))))
        return F.when(_may(x, "credit_card"), done).otherwise(x)

    return let(text, put)


def redact_patterns(text: Column, patterns: dict[str, str]) -> Column:
    def layer(label: str, pattern: str) -> Callable[[Column], Column]:
        return lambda x: F.when(_may(x, label), F.regexp_replace(x, pattern, mark(label))).otherwise(x)

    for label, pattern in patterns.items():
        text = let(text, layer(label, pattern))
    return text


def redact_secrets(text: Column) -> Column:
    return redact_patterns(text, SECRET_PATTERNS)


def redact(text: Column) -> Column:
    """All layers; a text that holds nothing any of them could match is looked at once."""
    layers = lambda x: redact_patterns(redact_cards(redact_secrets(x)), PII_PATTERNS)
    return let(text, lambda x: F.when(F.rlike(x, F.lit(_ANY)), layers(x)).otherwise(x))


def redact_json(text: Column) -> Column:
    """JSON text with its values redacted. It stays JSON: a number that is taken for a secret makes all values strings."""

    def put(x: Column) -> Column:
        strings = F.to_json(F.transform_values(F.from_json(x, "map<string,string>"), lambda _, v: redact(v)))
        return let(redact(x), lambda done: F.when(done.eqNullSafe(x) | F.try_parse_json(done).isNotNull() | F.try_parse_json(x).isNull(), done).otherwise(strings))

    return let(text, put)


def redaction_counts(text: Column) -> Column:
    """A map of label to how often the stages of redact() replace it."""
    counts, stage = [], text
    for label, pattern in SECRET_PATTERNS.items():
        counts += [F.lit(label), F.regexp_count(stage, F.lit(pattern))]
        stage = F.regexp_replace(stage, pattern, mark(label))
    cards, stage = F.size(_valid_cards(stage)), redact_cards(stage)
    for label, pattern in PII_PATTERNS.items():
        n = F.regexp_count(stage, F.lit(pattern))
        counts += [F.lit(label), n + cards if label == "credit_card" else n]
        stage = F.regexp_replace(stage, pattern, mark(label))
    found = F.map_filter(F.create_map(*counts), lambda _, n: n > 0)
    return F.when(F.rlike(text, F.lit(_ANY)), found).otherwise(F.create_map().cast("map<string,int>"))


def redact_entities(df: DataFrame, columns: Sequence[str], recognise: Callable[[list[str]], list[list[tuple[int, int, str]]]]) -> DataFrame:
    """df with what a recogniser (names, places; a scanner of secrets) finds replaced by marks.

    recognise gets a batch of texts and gives (from, to, label) of each finding. It fails closed: an error, or an answer
    for fewer texts than it got, fails the task, so no text passes unread. Overlapping findings become one.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for column in columns:
                known = frame[column].notna()
                texts = frame.loc[known, column].tolist()
                found = recognise(texts) if texts else []
                if len(found) != len(texts):
                    raise RuntimeError(f"the recogniser answered for {len(found)} of {len(texts)} texts")
                frame.loc[known, column] = [_marked(t, spans) for t, spans in zip(texts, found, strict=True)]
            yield frame

    return df.mapInPandas(scan, df.schema)


def _marked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    merged: list[list] = []
    for a, b, label in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, label])
    for a, b, label in merged:
        out += [text[at:a], mark(label)]
        at = b
    return "".join([*out, text[at:]])
