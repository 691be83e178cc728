"""The query service: a query string in, one page of items out, with what there is to know about the answer."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.scalar import fair_share
from quillmark.functions.text import stemmed_text, token_text
from quillmark.functions.text import fold
from quillmark.functions.porter import stem
from quillmark.model import RECORD_SOURCES, SESSION_SOURCES
from quillmark.operators import aggregates as A
from quillmark.operators import cards as C
from quillmark.operators import page as P
from quillmark.operators import search as S
from quillmark.operators.postings import PROBED, TextIndex
from quillmark.operators.predicates import among, observation_rows, record_filter, session_filter
from quillmark.plans import dsl
from quillmark.plans.dsl import QueryAST
from quillmark.store import Store
from quillmark.workspace import Staging

SUMMARY_PAGE, FULL_PAGE = 200, 40
CEILING_CHARS = 50_000
#: Session scopes that an engine remembers.
MOST_SCOPES = 8
_MISMATCH = {
    "mismatch_sessions_on_records": "the source holds records, but the query uses keys of sessions",
    "mismatch_records_on_sessions": "the source holds sessions, but the query uses keys of records",
}


@dataclass
class Found:
    """Rows that answer, before paging; hits are the observations behind session rows, tier is the relaxation used."""

    rows: DataFrame
    hits: DataFrame | None = None
    tier: str | None = None
    matched: int | None = None
    total: int | None = None

    def count(self) -> int:
        if self.total is None:
            self.total = self.rows.count()
        return self.total


class Engine:
    """Answers queries over three frames. With stem, words match by Porter stems and without diacritics, as the index does.

    With stored indexes (by table) a query reads the postings of its words; without, it scans the texts.
    """

    def __init__(
        self, records: DataFrame, sessions: DataFrame, observations: DataFrame, stem: bool = True, on_miss: Callable[[str], None] | None = None,
        indexes: dict[str, TextIndex | None] | None = None,
    ):
        terms = stemmed_text if stem else token_text
        self.stemmed, self.on_miss = stem, on_miss
        self.indexes = {k: v for k, v in (indexes or {}).items() if v is not None and stem}
        self.sessions, self._scopes = sessions, {}  # scopes: rows and where they are kept, the last asked for last
        self._held: list[DataFrame] = []  # what a query reads more than once
        self.records = records if "records" in self.indexes else records.withColumn("terms", terms(F.concat_ws(" ", "subject", "body")))
        self.observations = observations if "observations" in self.indexes else observations.withColumn("terms", terms(F.coalesce("body", F.lit(""))))

    @classmethod
    def of_store(cls, store: Store, on_miss: Callable[[str], None] | None = None) -> Engine:
        return cls(store.read("records"), store.read("sessions"), store.read("observations"), on_miss=on_miss, indexes={t: store.index(t) for t in ("records", "observations")})

    def phrases(self, text: str | None) -> list[list[str]]:
        found = dsl.conjuncts(text)
        return [[stem(fold(t)) for t in p] for p in found] if self.stemmed else found

    def _with_tier(self, table: str, df: DataFrame, phrases: list[list[str]]) -> DataFrame:
        """Rows that meet some tier, with it."""
        index = self.indexes.get(table)
        if index is None:  # the texts are searched once, for all that comes after: rows are kept without them
            seen = df.withColumn("_tier", S.tier_of(phrases)).drop("terms", "body").persist()
            self._held.append(seen)
            return seen.where("_tier > 0")
        met = index.tiers(phrases).select(index.key, "src_hash", F.col("tier").alias("_tier"))
        return df.join(met, [index.key, "src_hash"])

    def _tier(self, table: str, df: DataFrame, phrases: list[list[str]]) -> tuple[DataFrame, str | None, int]:
        """Rows of the strictest tier with any; its name and how many rows it has, before further filters.

        With an index that keeps its terms, rows that have all words are looked for first, from the rarest word.
        """
        index = self.indexes.get(table)
        if index is not None and index.segments:
            found = index.match_all(phrases).select(index.key, "src_hash")
            some = [r[0] for r in found.select(index.key).limit(PROBED + 1).collect()]
            near = df.where(F.col(index.key).isin(some)) if len(some) <= PROBED else df  # few keys lead to their row groups
            rows = near.join(found, [index.key, "src_hash"], "left_semi").select(*df.columns)
            if some and (n := rows.count()):
                return rows, S.TIER_NAMES.get(S.STRICT), n
        met = self._with_tier(table, df, phrases)
        counts = {r["tier"]: r["n"] for r in met.groupBy(F.col("_tier").alias("tier")).agg(F.count("*").alias("n")).collect()}
        best = max(counts, default=0)
        return met.where(F.col("_tier") >= best).drop("_tier"), S.TIER_NAMES.get(best), counts.get(best, 0)

    def _session_scope(self, df: DataFrame, phrases: list[list[str]]) -> DataFrame:
        index = self.indexes.get("observations")
        if index is None:
            return S.session_scope_rows(df, phrases)
        name = json.dumps(phrases)
        if df is self.observations and name in self._scopes:  # the engine's frames are one version, so a scope holds
            self._scopes[name] = self._scopes.pop(name)
            return self._scopes[name][0]
        rows = df.join(index.match_any(phrases).select(index.key, "src_hash"), [index.key, "src_hash"], "left_semi")
        flags = index._flags(phrases)
        alive = df.select(F.col(index.key).alias("key"), "src_hash").join(flags.drop("session_id"), ["key", "src_hash"])
        roots = alive.groupBy("root_session_id").agg(*[F.bool_or(f"c{k}").alias(f"c{k}") for k in range(len(phrases))]).where(index._all(phrases)).select("root_session_id")
        found = rows.join(roots, "root_session_id", "left_semi").select(*df.columns)
        if df is not self.observations:
            return found
        while len(self._scopes) >= MOST_SCOPES:
            self._scopes.pop(next(iter(self._scopes)))[1].clear()  # the one that was asked for longest ago
        work = Staging(df.sparkSession)
        self._scopes[name] = (work.keep(found, "scope"), work)
        return self._scopes[name][0]

    def close(self) -> None:
        """Remove the tables of the scopes that are remembered."""
        while self._scopes:
            self._scopes.popitem()[1][1].clear()

    def find_records(self, ast: QueryAST) -> Found:
        """The ladder runs over all records and filters come after it: a filter never relaxes the words."""
        if ast.text is None:
            return Found(self.records.where(record_filter(ast)))
        phrases = self.phrases(ast.text)
        if not phrases:
            return Found(self.records.where(F.lit(False)), matched=0)
        rows, tier, matched = self._tier("records", self.records, phrases)
        return Found(rows.where(record_filter(ast)), tier=tier, matched=matched)

    def _items(self, kind: str, page: DataFrame, made: Callable[[DataFrame], DataFrame]) -> list:
        """Items of a page's rows in its order; bodies that a search has left behind are read for the page's keys."""
        every = {"records": self.records, "observations": self.observations}.get(kind)
        if every is None or "body" in page.columns:
            return made(page).collect()
        key = P.ORDERS[kind][2]
        ids = [r[0] for r in page.select(key).collect()]  # a page and one row at most
        of = {r["id"]: r for r in made(among(every, key, ids)).collect()}
        return [of[i] for i in ids]

    def find_observations(self, ast: QueryAST) -> Found:
        if ast.text is None:
            return Found(observation_rows(self.observations, self.sessions, ast))
        phrases = self.phrases(ast.text)
        if not phrases:
            return Found(self.observations.where(F.lit(False)), matched=0)
        if ast.scope == "session":
            rows = self._session_scope(self.observations, phrases)
            return Found(observation_rows(rows, self.sessions, ast), matched=rows.count())
        rows, tier, matched = self._tier("observations", self.observations, phrases)
        return Found(observation_rows(rows, self.sessions, ast), tier=tier, matched=matched)

    def _with_placeholder(self, passing: DataFrame, top: str) -> DataFrame:
        """passing, or a placeholder for a root whose own transcript is missing while streams below it are there."""
        root = A.orphan_roots(self.sessions.where(F.col("root_session_id") == top)).withColumn("session_id", F.col("root_session_id")).withColumn("kind", F.lit("session"))
        row = root.where(~passing.select(F.lit(1)).exists())
        return passing.unionByName(row.select(*[F.col(c) if c in row.columns else F.lit(None).cast(passing.schema[c].dataType).alias(c) for c in passing.columns]))

    def find_sessions(self, ast: QueryAST) -> Found:
        """Cards. type: and by: are inside each tier; the other filters act on the cards."""
        inside = QueryAST(obs_type=ast.obs_type, provenance=ast.provenance)
        rows = observation_rows(self.observations, self.sessions, inside)
        passing = self.sessions.where(session_filter(ast))
        if ast.text is None:
            if not (ast.obs_type or ast.provenance):
                return Found(passing if not ast.top_session_id or ast.tags else self._with_placeholder(passing, ast.top_session_id))
            return Found(S.hit_sessions(passing, rows), hits=rows)
        phrases = self.phrases(ast.text)
        if not phrases:
            return Found(passing.where(F.lit(False)), matched=0)
        if ast.scope == "session":
            hits, tier = self._session_scope(rows, phrases), None
            matched = hits.count()
        else:
            hits, tier, matched = self._tier("observations", rows, phrases)
        return Found(S.hit_sessions(passing, hits), hits=hits, tier=tier, matched=matched)

    def _release(self) -> None:
        while self._held:
            self._held.pop().unpersist()

    def _find(self, ast: QueryAST, mode: str, full: bool = False) -> dict[str, Found]:
        """What answers, by kind: records, sessions, observations."""
        found = {}
        if mode in ("records", "union"):
            found["records"] = self.find_records(ast)
        if mode in ("sessions", "union"):
            kind = "observations" if mode == "sessions" and (ast.source == "observations" or full) else "sessions"
            found[kind] = self.find_observations(ast) if kind == "observations" else self.find_sessions(ast)
        return found

    def places(self, text: str) -> DataFrame:
        """place (from 0), id, total of every row that answers, in the order of the pages: page n of a size has the places from n * size on.

        One search and one distributed sort, however many pages there are.
        """
        ast = dsl.parse(text)
        mode = dsl.route(ast)
        if mode in _MISMATCH:
            raise dsl.DSLError(_MISMATCH[mode])
        try:
            found = self._find(ast, "records" if _records_only(ast, mode) else mode)
            if len(found) > 1:
                return P.union_placed(found["records"].rows, found["sessions"].rows)
            kind, f = next(iter(found.items()))
            return P.placed(f.rows, kind)
        finally:
            self._release()

    def query(self, text: str, fields: str = "summary", page_size: int | None = None, page_token: str | None = None, max_chars: int = CEILING_CHARS) -> dict:
        """One page. Errors of the caller come back as {'error': ...}; mismatched keys as an empty page with a notice."""
        try:
            ast = dsl.parse(text)
            offset = dsl.page_offset(ast, page_token)
        except (dsl.DSLError, dsl.PageTokenError) as e:
            return {"error": str(e), "items": []}
        if fields not in ("summary", "full") or (page_size is not None and page_size < 1):
            return {"error": "fields is summary or full, page_size a positive number", "items": []}
        full = fields == "full"
        size = page_size or (FULL_PAGE if full else SUMMARY_PAGE)
        mode = dsl.route(ast)
        if mode in _MISMATCH:
            return {"items": [], "total_matched": 0, "notices": [{"code": mode, "text": _MISMATCH[mode]}], "next_page_token": None}
        try:
            return self._answer(text, ast, mode, full, offset, size, max_chars)
        finally:
            self._release()

    def _answer(self, text: str, ast: QueryAST, mode: str, full: bool, offset: int, size: int, max_chars: int) -> dict:
        terms, found = dsl.query_terms(ast.text), self._find(ast, mode, full)
        total = sum(f.count() for f in found.values())
        if total <= offset:
            items = []
        elif mode == "union" and not _records_only(ast, mode):
            items = P.union_by_time(found["records"].rows, found["sessions"].rows, offset, size).collect()
        else:
            kind, f = next(iter(found.items()))
            made = {"records": lambda d: P.record_items(d, full), "sessions": P.session_items, "observations": lambda d: P.observation_items(d, terms, full)}[kind]
            items = self._items(kind, P.page(f.rows, kind, offset, size), made)  # in the pages' own order: a record's time may be when it was made
        items = [r.asDict() for r in items]
        more = len(items) > size
        items = self._enrich(items[:size], found.get("sessions"))
        items, cut = ceiling(items, max_chars)
        tiers = {k: f.tier for k, f in found.items() if f.tier}
        out = {
            "items": items, "total_matched": total, "mode": mode, "lexical_relaxation": tiers or None, "confidence": confidence(found, total, ast),
            "next_page_token": dsl.page_token(ast, offset + size) if more else None, "notices": notices(ast, mode, found, total, cut),
        }
        if not total and ast.text and self.on_miss:
            self.on_miss(text)
        return out

    def _enrich(self, items: list[dict], sessions: Found | None) -> list[dict]:
        """First prompt, number of hits and previews for the session cards of the page, by one grouped join each."""
        ids = [i["id"] for i in items if i["arm"] == 1]
        if not ids or sessions is None:
            return items
        on_page = among(self.sessions, "session_id", ids).select("session_id", "root_session_id")
        of_page = on_page.select("root_session_id").distinct()
        observations = self.observations.join(of_page, "root_session_id", "left_semi")
        hits = observations if sessions.hits is None else sessions.hits.join(of_page, "root_session_id", "left_semi")
        if "body" not in hits.columns:
            hits = hits.join(observations.select("obs_id", "body"), "obs_id")
        known = {r["session_id"]: r for r in C.cards(on_page, observations, hits).collect()}
        shown: dict[str, list[str]] = {}
        if sessions.hits is not None:
            for r in C.previews(hits).orderBy("root_session_id", "rank").collect():
                shown.setdefault(r["root_session_id"], []).append(r["preview"])
        for item in items:
            if item["arm"] == 1 and (card := known.get(item["id"])):
                item |= {"prompt": card["prompt"], "matches": card["matches"], "previews": shown.get(card["root_session_id"], [])}
        return items

    def capabilities(self) -> dict:
        span = A.span(self.records, self.sessions).first()
        return {
            "sources": {r["name"]: r["n"] for r in A.count_by_source(self.records, self.sessions).collect()},
            "top_tags": {s: [t for _, t in sorted(v)] for s, v in _grouped(A.top_tags(self.records).collect()).items()},
            "from": span["lo"], "to": span["hi"], "agent_types": [r[0] for r in A.distinct_agent_types(self.sessions).collect()],
            "known_sources": [*SESSION_SOURCES, *RECORD_SOURCES], "keys": ["source", "tag", "from", "to", "session", "top", "agent", "type", "active", "by", "scope"],
        }


def _records_only(ast: QueryAST, mode: str) -> bool:
    """tag: leaves sessions out, so a union's answer is in the order of records."""
    return mode == "union" and bool(ast.tags)


def _grouped(rows: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["source"], []).append((r["rank"], r["tag"]))
    return out


def ceiling(items: list[dict], most: int, passes: int = 3) -> tuple[list[dict], int]:
    """Items whose JSON fits: contents get a fair share of what the rest leaves, each cut one says so."""
    size = lambda xs: len(json.dumps(xs, default=str, ensure_ascii=False))
    cut: set[int] = set()
    for _ in range(passes):
        over = size(items) - most
        if over <= 0:
            break
        lengths = [len(i["content"] or "") for i in items]
        for k, keep in enumerate(fair_share(lengths, max(0, sum(lengths) - over - 60 * len(items)))):
            if keep < lengths[k]:
                items[k] = items[k] | {"content": items[k]["content"][:keep], "truncated": True}
                cut.add(k)
    return items, len(cut)


def confidence(found: dict[str, Found], total: int, ast: QueryAST) -> str:
    """exact, relaxed, or why there is nothing: the filters took it, or the corpus lacks it."""
    if total:
        return "relaxed" if any(f.tier for f in found.values()) else "exact"
    if ast.text is None:
        return "none_by_filter"
    return "none_by_filter" if any(f.matched for f in found.values()) else "none_in_corpus"


def notices(ast: QueryAST, mode: str, found: dict[str, Found], total: int, cut: int) -> list[dict]:
    out = []
    if not total:
        out.append({"code": "empty_page", "text": "no row passes the filters" if any(f.matched for f in found.values()) else "no row has the words"})
    for kind, f in found.items():
        if f.tier and total:
            out.append({"code": f"relaxed_{f.tier}", "text": f"no {kind} have all the words; these have some"})
    if ast.tags and mode != "records":
        out.append({"code": "tags_of_records_only", "text": "sessions have no tags; tag: leaves them out"})
    if ast.extra:
        out.append({"code": "ignored_keys", "text": f"these keys route but don't filter: {', '.join(sorted(ast.extra))}"})
    if ast.source and ast.source not in (*SESSION_SOURCES, *RECORD_SOURCES):
        out.append({"code": "unknown_source", "text": f"{ast.source!r} is no known source"})
    if cut:
        out.append({"code": "truncated", "text": f"{cut} items were cut to fit"})
    return out
