"""Substring deduplication by a run-length compressed Burrows-Wheeler transform.

Pieces of text that can hold repeats (see repeats.py) are indexed a block at a time. The index of a block is its
transform as runs (symbol, length) with the places of the first and last suffix of each run, and the common prefix of the
two suffixes that meet at each run end; neither the suffix array nor the plain transform is kept. Copies of a piece lie
next to each other in suffix order, so they are stored once and lengthen the runs of that piece. The block's texts are
then streamed over the index: the matching statistic of a place (the longest string from there that starts elsewhere
too) is a sample's common prefix at a run end, and from one sample to the next it falls by one with each byte. Windows
whose matching statistic reaches the length are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm.common import documents, keyed, spread, tidied
from quillmark.llm.repeats import Block, Search, byte_cut, byte_units, covered, repeated_windows

LENGTH = 200
#: Bytes of the seeds; the longer ones part crowded seeds.
SEEDS = (48, 96, 150, 200)
#: After each piece come 0xFF and its number in bytes of three bits from 0xF8 on; UTF-8 has none of these.
_END, _DIGIT, _DIGITS = 0xFF, 0xF8, 7
_U = np.uint64


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array: sorts of (rank, rank of what follows, place) packed in one number, twice as far each time."""
    n = len(text)
    bits = n.bit_length()
    if bits > 21:
        raise ValueError("a block is too long for packed sorts")
    place, low = np.arange(n, dtype=np.uint64), _U((1 << bits) - 1)
    padded = np.concatenate([text, np.zeros(5, np.uint8)]).astype(np.uint64)
    packed = np.zeros(n, np.uint64)
    for k in range(5):
        packed = packed << _U(8) | padded[k : k + n]
    packed = packed << _U(bits) | place
    have = 5
    while True:
        packed.sort()
        order = (packed & low).astype(np.int64)
        top = packed >> _U(bits)
        new = np.concatenate([[False], top[1:] != top[:-1]])
        if have >= n or new[1:].all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new)
        packed = rank << _U(bits + 1)
        packed[: max(0, n - have)] |= rank[have:] + _U(1)
        packed = packed << _U(bits) | place
        have *= 2


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that the texts from a and from b have in common, up to limit; words[i] holds the 8 bytes from i, first byte highest."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    last = len(words) - 1
    for at in range(0, limit, 8):
        differ = words[np.minimum(a[live] + at, last)] ^ words[np.minimum(b[live] + at, last)]
        end = differ != 0
        if end.any():
            x = differ[end]
            same = np.zeros(len(x), np.int64)
            for k in range(1, 8):
                same += (x >> _U(64 - 8 * k)) == 0
            out[live[end]] = at + same
            live = live[~end]
        if not len(live):
            return out
    out[live] = limit
    return out


class RunIndex:
    """The run-compressed transform of some pieces, each of which occurs copies times.

    A piece's first suffix is a run of its own, so that its length says how often the piece is there. symbol and length are
    the runs, head and tail the places of a run's first and last suffix, and meet[r] the common
    prefix, exact up to limit, of the suffixes at the end of run r and the start of run r + 1.
    """

    def __init__(self, pieces: list[bytes], copies: np.ndarray, limit: int = 512):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.sizes + 1 + _DIGITS) - (self.sizes + 1 + _DIGITS)
        self.limit = limit
        marks = ((np.arange(len(pieces))[:, None] >> (3 * np.arange(_DIGITS))) & 7) + _DIGIT
        ends = [bytes([_END]) + m.tobytes() for m in marks.astype(np.uint8)]
        text = np.frombuffer(b"".join(x for p, e in zip(pieces, ends, strict=True) for x in (p, e)), np.uint8)
        order = suffix_order(text)
        before = text[order - 1].astype(np.int16)
        before[order == 0] = -1  # nothing comes before the first place
        begins = np.zeros(len(text), bool)
        begins[self.start] = True
        begins = begins[order]
        cut = np.flatnonzero((before[1:] != before[:-1]) | begins[1:] | begins[:-1])
        first, last = np.concatenate([[0], cut + 1]), np.append(cut, len(text) - 1)
        weight = np.repeat(copies, self.sizes + 1 + _DIGITS)
        self.symbol, self.length = before[first], np.add.reduceat(weight[order], first)
        self.head, self.tail = order[first], order[last]
        self.often = np.ones(len(pieces), np.int64)
        own = begins[first]
        self.often[np.searchsorted(self.start, self.head[own])] = self.length[own]
        padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
        words = np.zeros(len(text), np.uint64)
        for k in range(8):
            words |= padded[k : k + len(text)] << _U(56 - 8 * k)
        self.meet = common_prefix(words, self.tail[:-1], self.head[1:], limit)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, weights=weight, minlength=256).astype(np.int64))])
        # samples by place: a run's first suffix with the one before it, and a run's last with the one after it
        self.samples = []
        for at, meet in ((self.head, np.concatenate([[0], self.meet])), (self.tail, np.append(self.meet, 0))):
            by_place = np.argsort(at)
            self.samples.append((at[by_place], meet[by_place]))

    def count(self, pattern: bytes) -> int:
        """How often the pattern starts in the pieces, copies included, by backward search over the runs."""
        before = np.concatenate([[0], np.cumsum(self.length)])
        lo, hi = 0, int(before[-1])
        for c in reversed(pattern):
            own = np.where(self.symbol == c, self.length, 0)
            so_far = np.concatenate([[0], np.cumsum(own)])

            def rank(row: int, c=c, so_far=so_far) -> int:
                r = int(np.searchsorted(before, row, side="right")) - 1
                return int(so_far[r] + (row - before[r] if r < len(self.symbol) and self.symbol[r] == c else 0))

            lo, hi = int(self.smaller[c]) + rank(lo), int(self.smaller[c]) + rank(hi)
            if lo >= hi:
                return 0
        return hi - lo

    def matching_statistics(self, piece: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For places in pieces, as these are streamed: bytes from there on that start elsewhere too, exact up to limit."""
        at = self.start[piece] + place
        found = np.zeros(len(at), np.int64)
        for sampled, meet in self.samples:
            near = np.searchsorted(sampled, at, side="right") - 1
            found = np.maximum(found, meet[near] - (at - sampled[near]))
        whole = np.where(self.often[piece] > 1, self.sizes[piece] - place, 0)  # a copy's suffix is in the same run
        return np.maximum(np.minimum(found, self.sizes[piece] - place), whole)  # what follows a piece is no text of it


def match_block(block: Block, length: int) -> tuple[np.ndarray, np.ndarray]:
    index = RunIndex(block.bodies, block.copies)
    windows = index.sizes - length + 1
    piece = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    return windows, index.matching_statistics(piece, place) >= length


#: Byte windows part into more pieces than word windows when they are dealt anew, so more of them meet before that.
SEARCH = Search(byte_units, byte_cut, LENGTH, SEEDS, match_block, group=1024)


def remove_repeats(docs: DataFrame, texts: bool = False, how: Search = SEARCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, if texts) for each row of docs.

    Null text is empty: nothing of it is removed. Of rows that repeat every byte under a window is removed, as each is
    elsewhere for the other; rows are told apart where ids repeat, are null or aren't numbers. Very long texts are
    searched in overlapping parts. An empty table gives no rows; further columns are ignored.
    """
    base = keyed(docs)
    marks = repeated_windows(base.select("key", "text"), how)
    joined = base.join(marks, "key", "left").select("doc_id", "text", "marks")
    length = how.length

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).cast(pa.large_binary()), covered(batch.column(2), length), strict=True):
                data = text.as_py()
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest if texts else None))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = base.schema["doc_id"].dataType.simpleString()
    out = joined.mapInArrow(tidied(scan), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if texts else out.drop("kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats over the whole texts of documents, 200 bytes; nulls, ties and odd rows as stated there."""
    return remove_repeats(spread(documents(spark, sf_dir), "doc_id", "text"))


SQL = """
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d)),
hits AS (SELECT doc_id, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
edges AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, -1) AS fresh FROM hits),
numbered AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edges),
spans AS (SELECT doc_id, k, min(i) AS s, max(i) + 200 AS e FROM numbered GROUP BY doc_id, k),
gaps AS (SELECT doc_id, k, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS a, s AS b FROM spans
         UNION ALL SELECT doc_id, max(k) + 1, max(e), NULL FROM spans GROUP BY doc_id),
rests AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY k) AS rest FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(e - s)::BIGINT AS gone, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN rests USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
