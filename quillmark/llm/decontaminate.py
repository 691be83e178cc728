"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

The automaton of all items is built once per worker. A document's words are streamed through it; the length of the
longest match that ends at each word is tracked, and where it reaches the window length the words of the window are
hit. Items shorter than a window are hit as a whole. Items are held in blocks of bounded size, one pass over the
documents for each, so that neither the driver nor a worker ever holds an unbounded automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import REMEMBERED, bound_batches, documents, spread, table, tidied, written

WINDOW = 10
#: Bytes of item text in one automaton.
BLOCK_BYTES = 1 << 20

#: A-Z to a-z; x00-2F, x3A-60 and x7B-7F (after that) to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


#: The same words for Spark's expressions, once A-Z is folded or not: case makes no difference to their number.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Of several word sequences. State 0 is the root; sequences start anew at the root."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: list[set[str]] = [set()]
        seen: list[set[str]] = [set()]
        self.least = window
        for name, words in items:
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            last = 0
            for w in ids:
                last = self._extend(last, w)
            if len(ids) < window:
                self.least = min(self.least, len(ids))
            while len(seen) < len(self.next):
                seen.append(set())
                self.whole.append(set())
            if len(ids) < window:
                self.whole[last].add(name)
        while len(seen) < len(self.next):
            seen.append(set())
            self.whole.append(set())
        # which items of at least a window hold the strings of a state of window length
        for name, words in items:
            if len(words) >= window:
                v = 0
                for w in words:
                    v = self.next[v][self.vocab[w]]
                    u = v
                    while self.length[u] >= window:
                        if name in seen[u]:
                            break
                        seen[u].add(name)
                        u = self.link[u]
        self.items = seen
        # the nearest suffix that is a whole short item, and the one that is of window length
        self.short, self.cut = [-1] * len(self.next), [*range(len(self.next))]
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[v]
            self.short[v] = up if up > 0 and self.whole[up] else self.short[up]
            if self.length[up] >= window:
                self.cut[v] = self.cut[up]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, w)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def stream(self, ids: list[int], at: int, spans: list[list[int]], found: set[str]) -> None:
        """Track the longest match over consecutive known words, the first of which is word number at."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = held = 0
        for i, w in enumerate(ids, at + 1):
            while state and w not in nxt[state]:
                state = link[state]
                held = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                held += 1
            else:
                held = 0
            reach = 0
            if held >= window:
                found |= self.items[self.cut[state]]
                reach = window
            u = state if held == length[state] and self.whole[state] else self.short[state]
            while u > 0:
                found |= self.whole[u]
                reach = max(reach, length[u])
                u = self.short[u]
            if reach:
                if spans and spans[-1][1] >= i - reach:
                    while spans and spans[-1][0] >= i - reach:
                        spans.pop()
                    if spans and spans[-1][1] >= i - reach:
                        spans[-1][1] = i
                    else:
                        spans.append([i - reach, i])
                else:
                    spans.append([i - reach, i])


_BUILT: dict[str, SuffixAutomaton] = {}
REMEMBERED[__name__] = _BUILT.clear


def _automaton(items: list[tuple[str, list[bytes]]], window: int, key: str) -> SuffixAutomaton:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = SuffixAutomaton(items, window)
    return _BUILT[key]


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _counted_blocks(benchmark: DataFrame, block_bytes: int) -> list[Callable[[], list[tuple[str, list[bytes]]]]]:
    """One function for each block of at most about block_bytes of item text; it fetches the block's items with words."""
    items = spread(benchmark, "item_id", "text").where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * size // block_bytes) if size > block_bytes else 1

    def block(k: int) -> list[tuple[str, list[bytes]]]:
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        fetched = [(r[0] if r[0] is not None else "", words_of(r[1].encode())) for r in part.collect()]
        return [(name, words) for name, words in fetched if words]

    return [partial(block, k) for k in range(n)]


def _pass(docs: DataFrame, at: int, items: list[tuple[str, list[bytes]]], window: int, hit_only: bool) -> DataFrame:
    """docs with n_words, spans and items by one block of items; if hit_only, just the rows that are hit."""
    key = hashlib.sha256(repr((items, window)).encode()).hexdigest()
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(items)
    schema = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<int>>").alias("spans"), F.array().cast("array<string>").alias("items")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(held.value, window, key)
        get, least = auto.vocab.get, auto.least
        for batch in batches:
            n_words: list[int] = []
            spans: list[list] = [[]] * batch.num_rows
            names: list[list] = [[]] * batch.num_rows
            for row, text in enumerate(batch.column(at).cast(pa.large_binary())):
                words = words_of(text.as_py())
                n_words.append(len(words))
                if len(words) < least:
                    continue
                ids = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).view(np.int8)))
                own: list[list[int]] = []
                found: set[str] = set()
                for a, b in edge.reshape(-1, 2)[np.diff(edge)[::2] >= least].tolist() if len(edge) else ():
                    auto.stream(ids[a:b].tolist(), a, own, found)
                if own:
                    spans[row] = _merged(own)
                    names[row] = sorted(found)
            columns = [*batch.columns, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(names, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(columns, names=schema.names)
            yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if hit_only else out

    return docs.mapInArrow(tidied(scan), schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words long, spans array<array<int>> (hit words, from and to) and items array<string> added.

    Null text has no words. Items without words hit nothing; items of the same id count as one; a null item_id has the
    empty name. Rows that repeat are scored each. Columns of docs with those three names are replaced. Items of more than
    block_bytes are dealt into blocks: each block has a pass of its own over the documents that writes hit rows only, and
    what the passes found meets by row. An empty table gives no rows. A text is worked on as a whole.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "spans", "items")])
    names = docs.columns
    first, *others = _counted_blocks(benchmark, block_bytes)
    if not others:
        return _pass(docs, names.index("text"), first(), window, False)
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = written(docs.select(row, F.col("text"), F.monotonically_increasing_id().alias("key")), "decontaminate-rows")
    texts = rows.select("key", "text")
    hits = [written(_pass(texts, 1, block(), window, True).select("key", "spans", "items"), "decontaminate-hits") for block in (first, *others)]
    every = reduce(DataFrame.union, hits).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans of several blocks in order of their starts: those that touch become one
    join = "aggregate(array_sort(spans), cast(array() as array<array<int>>), (a, s) -> if(size(a) > 0 AND s[0] <= element_at(a, -1)[1], concat(slice(a, 1, size(a) - 1), array(array(element_at(a, -1)[0], greatest(element_at(a, -1)[1], s[1])))), concat(a, array(s))))"
    merged = every.select("key", F.expr(join).alias("spans"), "items")
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).cast("long").alias("n_words")
    out = rows.join(merged, "key", "left").select(*[F.col(f"row.`{c}`") for c in names], n_words, F.coalesce("spans", F.array().cast("array<array<int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out


N_HIT = "aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])"


def _renamed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with all columns but text under names that nothing clashes with, and those names in order."""
    names = ["text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]), names


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_hit: int = 0, max_coverage: float = 0.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that have more than max_hit hit words and more than max_coverage of their words hit.

    Rows that stay are as they were, whatever their columns are called; rows that repeat stay or go together, and a null
    text stays. An empty docs gives no rows, an empty benchmark all of them.
    """
    plain, names = _renamed(docs)
    scored = find_hits(plain, benchmark, window, block_bytes)
    bad = (F.expr(N_HIT) > max_hit) & (F.expr(N_HIT) > max_coverage * F.col("n_words"))
    return scored.where(~bad).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = WINDOW) -> DataFrame:
    """docs with hit spans of at least min_span words taken out of their texts; what is left keeps its bytes.

    A null text stays null and a text that is hit throughout becomes what lies around its words. Rows that repeat are cut
    alike; other columns stay as they are, whatever they are called. An empty docs gives no rows.
    """
    plain, fields = _renamed(docs)
    scored = find_hits(plain, benchmark, window).select(*fields, "spans")
    at = fields.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for row, spans in enumerate(batch.column(len(fields)).to_pylist()):
                if spans := [s for s in spans if s[1] - s[0] >= min_span]:
                    raw = texts[row].encode()
                    flat = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], flat, [False]]).view(np.int8))).reshape(-1, 2)
                    keep = np.ones(len(raw), dtype=bool)
                    for a, b in spans:
                        keep[edge[a, 0] : edge[b - 1, 1]] = False
                    texts[row] = np.frombuffer(raw, np.uint8)[keep].tobytes().decode()
            columns = [*batch.columns[: len(fields)]]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    done = scored.mapInArrow(tidied(cut), plain.schema)
    return done.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, fields, strict=True)])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_hits over the whole texts of documents, 10 words; nulls, ties and odd rows as stated there."""
    hits = find_hits(spread(documents(spark, sf_dir), "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.expr(N_HIT)
    return hits.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, ws, least(10, len(ws)) AS size FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
grams AS (SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM items)),
docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS gram
            FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM items) WHERE len(ws) >= size)),
hits AS (SELECT doc_id, size, i, item FROM windows JOIN grams USING (size, gram)),
places AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""
