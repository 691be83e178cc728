"""Strings of a given length that start in more than one place, found without comparing documents in pairs.

A text is a sequence of units (bytes, or words). Every window of `length` units names one of its seeds, strings of some
units, by its content alone: the one of the smallest hash. Consecutive windows of a document that name the same place
form a piece, so each window of the corpus lies in one piece, and equal windows lie in pieces of equal seeds. Then:

1. Seeds that occur once are done: none of their windows repeats.
2. The other pieces are cut out, and equal ones are combined with their number: partial groups in each task, then groups
   by the whole content, so that pieces count as equal only where all their bytes are.
3. The different pieces of a seed meet in a block, where a matcher compares their units. A seed with more different
   pieces than a block takes has its windows dealt anew by longer seeds; the longest is the window itself.
4. Marks go back to every occurrence by joins on a 128-bit digest of the piece's content. Were two contents to share a
   digest, which the groups by content show, all digests are taken anew with another salt.

Hashes thus only say what to bring together; what is marked has been compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import kernel as K
from quillmark.llm.common import discard, tidied, written

#: Different pieces of a seed that meet in one block, and bytes after which a block ends with its seed.
GROUP = 512
BLOCK_BYTES = 1 << 18

_U = np.uint64


@dataclass
class Units:
    """A stretch's units: a hash and a place in data for each, and each document's first unit. raw is the place in the text."""

    values: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    raw: np.ndarray


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    place = np.arange(len(data))
    return Units(K.BYTES[data], place, place + 1, offsets, data, place)


def word_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Words, joined by single spaces in data, so that equal sequences of words have equal bytes."""
    start, end = K.word_spans(data, offsets)
    inside = ~K.SPACE[data]
    keep = inside.copy()
    keep[end[end < len(data)]] = True
    place = np.cumsum(keep) - 1
    plain = np.where(inside, data, np.uint8(32))[keep]
    return Units(K.span_keys(data, start, end), place[start], place[end - 1] + 1, np.searchsorted(start, offsets), plain, start)


def byte_cut(data: np.ndarray, at: int) -> int:
    return min(at, len(data))


def word_cut(data: np.ndarray, at: int) -> int:
    """The first separator from there."""
    while at < len(data):
        free = np.flatnonzero(K.SPACE[data[at : at + (1 << 16)]])
        if len(free):
            return at + int(free[0])
        at += 1 << 16
    return len(data)


def digest(body: bytes, salt: int) -> int:
    return xxhash.xxh3_128_intdigest(body, seed=salt)


@dataclass
class Block:
    """Different pieces, those of one seed side by side: seed, how often each occurs, place of the seed in it, bytes."""

    seed: np.ndarray
    copies: np.ndarray
    off: np.ndarray
    bodies: list[bytes]


@dataclass(frozen=True)
class Search:
    units: Callable[[np.ndarray, np.ndarray], Units]
    #: Where a stretch of a long text may end.
    cut: Callable[[np.ndarray, int], int]
    length: int
    #: Units of the seeds, ever longer; the last are whole windows.
    seeds: tuple[int, ...]
    #: The number of windows of each piece of a block, and for each window of each, in order: does it start elsewhere?
    matcher: Callable[[Block, int], tuple[np.ndarray, np.ndarray]]
    digest: Callable[[bytes, int], int] = digest
    group: int | None = None


def stretches(column: pa.Array, how: Search, limit: int = K.SLICE) -> Iterator[tuple[int, int, Units, int]]:
    """(first row, row after the last, units, number of the first unit) for runs of rows, or for parts of one long text.

    Parts overlap by a window less one unit, so each window is whole in exactly one of them.
    """
    for a, b, data, offsets in K.slices(column, limit):
        if len(data) <= limit:
            yield a, b, how.units(data, offsets), 0
            continue
        at, base, size = 0, 0, limit
        while True:
            end = how.cut(data, at + size)
            units = how.units(data[at:end], np.array([0, end - at]))
            n = len(units.values)
            if end < len(data) and n < how.length:
                size *= 2
                continue
            yield a, b, units, base
            if end == len(data):
                break
            step = n - how.length + 1
            at, base, size = at + int(units.raw[step]), base + step, limit


def pieces(units: Units, length: int, k: int) -> tuple[np.ndarray, ...]:
    """seed hash, document (in the stretch), first unit in the document, windows, place of the seed in the piece."""
    n = len(units.values)
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    if n < length:
        return empty
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(units.values * K.powers(K._BASE, n), out=prefix[1:])
    at = np.arange(n - k + 1)
    grams = K.span_hash(prefix, at, at + k)
    own = K.sliding_argmin(grams, length - k + 1)
    sizes = np.diff(units.first)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(own)]
    inside = np.arange(len(own)) + length <= units.first[1:][doc]
    new = inside.copy()
    new[1:] &= (own[1:] != own[:-1]) | ~inside[:-1] | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        return empty
    so_far = np.concatenate([[0], np.cumsum(inside)])
    windows = np.diff(np.append(so_far[start], so_far[-1]))
    anchor = own[start]
    return grams[anchor], doc[start], start - units.first[doc[start]], windows, anchor - start


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def occurrences(docs: DataFrame, how: Search) -> DataFrame:
    """seed, key, loc of every piece; loc = first unit << 20 | windows << 10 | place of the seed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for a, _, units, base in stretches(batch.column(1), how):
                seed, doc, first, windows, off = pieces(units, how.length, how.seeds[0])
                if len(seed):
                    yield pa.RecordBatch.from_arrays([_signed(seed), pa.array(keys[a + doc]), pa.array((first + base) << 20 | windows << 10 | off)], ["seed", "key", "loc"])

    return docs.mapInArrow(tidied(scan), "seed long, key long, loc long")


def _combined(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int, how: Search) -> tuple[np.ndarray, np.ndarray, list]:
    """id1 and id2 of each span, how often it occurs (at its first occurrence, else 0), its bytes (there, else None)."""
    raw = data.tobytes()
    seen: dict[bytes, int] = {}
    same = np.empty(len(start), np.int64)
    bodies: list[bytes | None] = [None] * len(start)
    for i, (s, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        body = raw[s:e]
        j = same[i] = seen.setdefault(body, i)
        if j == i:
            bodies[i] = body
    ids = np.zeros((len(start), 2), np.uint64)
    for body, i in seen.items():
        ids[i] = divmod(how.digest(body, salt), 1 << 64)
    return ids[same], np.bincount(same, minlength=len(start)), bodies


_BODIES = "seed long, key long, loc long, id1 long, id2 long, n long, body binary"


def fetch(docs: DataFrame, wanted: DataFrame, how: Search, salt: int) -> DataFrame:
    """seed, key, loc, id1, id2, n, body of the pieces wanted(key, need array of seed, loc).

    Equal pieces of a stretch are combined: the first has their number and the bytes, the others 0 and null.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, need = batch.column(0).to_numpy(), batch.column(2)
            for a, b, units, base in stretches(batch.column(1), how):
                part = need.slice(a, b - a)
                flat = part.flatten()
                seed, loc = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                row = np.repeat(np.arange(b - a), pc.list_value_length(part).to_numpy())
                first = (loc >> 20) - base
                last = first + ((loc >> 10) & 1023) + how.length - 2
                here = np.flatnonzero((first >= 0) & (last < np.diff(units.first)[row]))
                if len(here):
                    seed, loc, row = seed[here], loc[here], row[here]
                    ids, n, bodies = _combined(units.data, units.start[units.first[row] + first[here]], units.end[units.first[row] + last[here]], salt, how)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seed), pa.array(keys[a + row]), pa.array(loc), _signed(ids[:, 0].copy()), _signed(ids[:, 1].copy()), pa.array(n), pa.array(bodies, pa.binary())],
                        ["seed", "key", "loc", "id1", "id2", "n", "body"],
                    )

    return docs.join(wanted, "key").select("key", "text", "need").mapInArrow(tidied(scan), _BODIES)


def _true_runs(hit: np.ndarray, windows: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each piece the runs (first window, how many) of windows that were hit."""
    out: list[list[tuple[int, int]]] = [[] for _ in windows]
    ends = np.cumsum(windows)
    edge = np.zeros(len(hit) + 1, bool)
    edge[ends] = edge[0] = True
    start = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
    stop = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
    of = np.searchsorted(ends, start, side="right")
    for i, a, b in zip(of.tolist(), start.tolist(), stop.tolist(), strict=True):
        out[i].append((a - int(ends[i] - windows[i]), b - a))
    return out


_MARKS = "id1 long, id2 long, marks array<struct<at:int,n:int>>"
_MARK_TYPE = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))


def compare(distinct: DataFrame, how: Search) -> DataFrame:
    """Marks of the pieces distinct(seed, id1, id2, off, body, n), from blocks of whole seed groups."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            seed, id1, id2, off, n, bodies = zip(*rows, strict=True)
            windows, hit = how.matcher(Block(np.array(seed, np.int64), np.array(n, np.int64), np.array(off, np.int64), list(bodies)), how.length)
            kept = [(a, b, [{"at": x, "n": y} for x, y in m]) for a, b, m in zip(id1, id2, _true_runs(hit, windows), strict=True) if m]
            if kept:
                a, b, m = zip(*kept, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, _MARK_TYPE)], ["id1", "id2", "marks"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK_BYTES and row[0] != rows[-1][0]:
                    yield from done()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield from done()

    ordered = distinct.select("seed", "id1", "id2", "off", "n", "body").repartition("seed").sortWithinPartitions("seed")
    return ordered.mapInArrow(tidied(scan), _MARKS)


def _deal_anew(crowded: DataFrame, how: Search, level: int, salt: int) -> DataFrame:
    """Pieces by longer seeds of the windows of crowded(id1, id2, n, body): their ids are a and b, loc is in them."""
    k = how.seeds[level]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, copies = (batch.column(i).to_numpy() for i in range(3))
            for r, _, data, offsets in K.slices(batch.column(3)):
                units = how.units(data, offsets)
                seed, doc, first, windows, off = pieces(units, how.length, k)
                if len(seed):
                    u = units.first[doc] + first
                    ids, _, _ = _combined(units.data, units.start[u], units.end[u + windows + how.length - 2], salt, how)
                    bodies = [units.data[s:e].tobytes() for s, e in zip(units.start[u].tolist(), units.end[u + windows + how.length - 2].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[r + doc]), pa.array(b[r + doc]), pa.array(first << 20 | windows << 10 | off), _signed(seed), _signed(ids[:, 0].copy()), _signed(ids[:, 1].copy()), pa.array(copies[r + doc]), pa.array(bodies, pa.binary())],
                        ["a", "b", "loc", "seed", "id1", "id2", "n", "body"],
                    )

    return crowded.select("id1", "id2", "n", "body").mapInArrow(tidied(scan), "a long, b long, loc long, seed long, id1 long, id2 long, n long, body binary")


def _by_content(bodies: DataFrame) -> DataFrame:
    """seed, id1, id2, off, body, n: one row for each content."""
    return bodies.where("n > 0").groupBy("seed", "id1", "id2", F.expr("cast(loc & 1023 as int)").alias("off"), "body").agg(F.sum("n").alias("n"))


def _clash(distinct: DataFrame) -> bool:
    return not distinct.groupBy("id1", "id2").agg(F.count("*").alias("kinds")).where("kinds > 1").isEmpty()


def _settled(make: Callable[[int], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Bodies, and the different ones, with digests that tell all contents apart."""
    for salt in range(64):
        bodies = written(make(salt), "repeat-bodies")
        distinct = written(_by_content(bodies), "repeat-pieces")
        if not _clash(distinct):
            return bodies, distinct
        discard(bodies)
        discard(distinct)
    raise RuntimeError("digests of different contents are equal under every salt")


def _marks(distinct: DataFrame, how: Search, level: int = 0) -> DataFrame:
    """id1, id2, marks of pieces that have any, written."""
    crowd = distinct.groupBy("seed").agg(F.count("*").alias("kinds")).where(F.col("kinds") > (how.group or GROUP)).select("seed")
    if level + 1 < len(how.seeds):
        crowd = written(crowd, "repeat-crowds")
        if not crowd.isEmpty():
            crowded = distinct.join(crowd, "seed", "left_semi")
            bodies, below = _settled(lambda salt: _deal_anew(crowded, how, level + 1, salt))
            marks = _marks(below, how, level + 1)
            up = bodies.select("a", "b", "loc", "id1", "id2").join(marks, ["id1", "id2"]).select("a", "b", F.explode("marks").alias("m"), F.expr("cast(loc >> 20 as int)").alias("base"))
            mark = F.struct((F.col("base") + F.col("m.at")).alias("at"), F.col("m.n").alias("n"))
            up = up.groupBy(F.col("a").alias("id1"), F.col("b").alias("id2")).agg(F.collect_list(mark).alias("marks"))
            return written(compare(distinct.join(crowd, "seed", "left_anti"), how).union(up), "repeat-marks")
    return written(compare(distinct, how), "repeat-marks")


def repeated_windows(docs: DataFrame, how: Search) -> DataFrame:
    """key, marks (first unit of a window and how many consecutive ones) of the documents(key, text) that have any."""
    found = written(occurrences(docs, how), "repeat-all")
    seeds = written(found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "repeat-seeds")
    wanted = written(found.join(seeds, "seed").groupBy("key").agg(F.collect_list(F.struct("seed", "loc")).alias("need")), "repeat-places")
    discard(found)
    discard(seeds)
    bodies, distinct = _settled(lambda salt: fetch(docs, wanted, how, salt))
    discard(wanted)
    marks = _marks(distinct, how)
    discard(distinct)
    spread = bodies.select("key", "loc", "id1", "id2").join(marks, ["id1", "id2"]).select("key", F.explode("marks").alias("m"), F.shiftright("loc", 20).alias("base"))
    return spread.groupBy("key").agg(F.collect_list(F.struct((F.col("base") + F.col("m.at")).alias("at"), F.col("m.n").cast("long").alias("n"))).alias("marks"))


def covered(marks: pa.Array, length: int) -> Iterator[list[list[int]]]:
    """For each row the maximal runs [from, to] of units under its marked windows."""
    flat = marks.flatten()
    at, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    sizes = pc.fill_null(pc.list_value_length(marks), 0).to_numpy()
    stop = 0
    for size in sizes.tolist():
        start, stop = stop, stop + size
        if not size:
            yield []
            continue
        order = np.argsort(at[start:stop], kind="stable")
        first = at[start:stop][order]
        to = np.maximum.accumulate(first + n[start:stop][order] - 1 + length)
        new = np.concatenate([[True], first[1:] > to[:-1]])
        yield np.stack([first[new], to[np.append(np.flatnonzero(new)[1:] - 1, len(to) - 1)]], axis=1).tolist()
