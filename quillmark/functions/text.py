"""Text expressions: index tokens, snippets, headings, the wrapper for untrusted content."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.porter import stem

SNIPPET_CHARS = 200
SNAP = 24
ELLIPSIS = "…"


def token_text(text: Column) -> Column:
    """Lower-case letter-and-digit runs with a space before, between and after: a token is found as ' token '.

    A string that is searched natively costs less than an array of tokens and keeps adjacency.
    """
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def stem_tokens(text: str | None) -> str:
    """As token_text, with diacritics folded and Porter stems: what the index holds."""
    return " " + " ".join(stem(t) for t in re.findall(r"[^\W_]+", fold(text or "").lower())) + " "


@functools.lru_cache(1 << 16)
def stemmed_word(token: str) -> str:
    """A token with folded diacritics, stemmed; words come again, so a worker remembers the last ones."""
    return stem(fold(token))


def _stem_all(texts: pd.Series) -> pd.Series:
    return texts.map(stem_tokens)


def stemmed_text(text: Column) -> Column:
    """token_text with folded diacritics and stems, for frames that have no stored index."""
    return F.pandas_udf(_stem_all, "string")(text)


def has_phrase(tokens: Column, phrase: Sequence[str], prefix: bool = False) -> Column:
    """Do the tokens hold the phrase side by side? With prefix, the last one need only begin so."""
    return F.contains(tokens, F.lit(" " + " ".join(phrase) + ("" if prefix else " ")))


def _literal(term: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", term)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def snippet(body: Column, terms: Sequence[str], width: int = SNIPPET_CHARS) -> Column:
    """A window of the body, white space collapsed, around the first term, whole words at cut ends, terms in [[ ]].

    Without a term in the body it is the body's head. Empty for a body with nothing in it.
    """
    pattern = r"(?iuU)\b(?:" + "|".join(map(_literal, terms)) + r")\b" if terms else None

    def start_of(text: Column) -> Column:
        if not pattern:
            return F.lit(0)
        hit = F.regexp_extract(text, f"({pattern})", 1)
        at = F.length(F.regexp_extract(text, r"(?s)^(.*?)" + pattern, 1))
        start = F.when(hit != "", at - F.floor(F.greatest(F.lit(0), F.lit(width) - F.length(hit)) / 2)).otherwise(F.lit(0))
        return F.greatest(F.lit(0), F.least(start, F.greatest(F.lit(0), F.length(text) - width))).cast("int")

    def without_part_word(cut: Column) -> Column:
        """cut has window, head and tail."""

        def headless(c: Column) -> Column:
            space = F.instr(c["window"], " ")
            rest = F.substr(c["window"], space + 1)
            return F.when(c["head"] & (space >= 1) & (space <= SNAP + 1) & (F.btrim(rest) != ""), rest).otherwise(c["window"])

        def tailless(window: Column) -> Column:
            last = F.length(window) - F.instr(F.reverse(window), " ")
            before = F.substr(window, F.lit(1), last)
            return F.when(cut["tail"] & (F.instr(window, " ") > 0) & (last >= F.length(window) - SNAP) & (F.btrim(before) != ""), before).otherwise(window)

        return let(headless(cut), tailless)

    def marked(window: Column) -> Column:
        return F.regexp_replace(window, f"({pattern})", r"[[$1]]") if pattern else window

    def whole(text: Column) -> Column:
        def cut_at(start: Column) -> Column:
            tail = start + width < F.length(text)
            return F.struct(F.substr(text, start + 1, F.lit(width)).alias("window"), (start > 0).alias("head"), tail.alias("tail"))

        def shown(cut: Column) -> Column:
            return F.concat(F.when(cut["head"], ELLIPSIS).otherwise(""), marked(without_part_word(cut)), F.when(cut["tail"], ELLIPSIS).otherwise(""))

        return F.when(text == "", "").otherwise(let(let(start_of(text), cut_at), shown))

    return let(F.btrim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " ")), whole)


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def wrapped(stable_id: Column, body: Column) -> Column:
    """The body as untrusted data: its id escaped, no closing tag left inside."""
    safe = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?i)(</ExternalContent)>", r"$1\\>")
    return F.concat(F.lit('<ExternalContent source="'), escape_html(stable_id), F.lit('">\n'), safe, F.lit("\n</ExternalContent>"))


def heading(text: Column, lines: int = 50) -> Column:
    """The first '# ' line among the first lines, without its mark; null if none."""
    marked = F.filter(F.slice(F.split(text, r"\r?\n"), 1, lines), lambda x: F.startswith(x, F.lit("# ")))
    return F.btrim(F.substring(F.get(marked, F.lit(0)), 3, 1 << 30))


def capped(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def slug_title(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))
