"""Substring deduplication by seed and extend.

Documents are joined on winnowed anchors of a few words (see repeats.py). The places of an anchor start as one class;
word after word to the right of the anchor, and word after word to the left, a class parts where the next words differ,
and a place left alone is given up. Places still in one class after so many words to the left and so many to the right
share all words between: where that is the length threshold, the repeat is kept. Runs of such windows, and in a document
the unions of runs, are its maximal repeats over the threshold. Comparing class by class and not pair by pair finds the
repeats of all pairs of places at a cost that grows with their number and not with its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm.common import documents, keyed, spread, tidied
from quillmark.llm.repeats import Block, Search, covered, repeated_windows, word_cut, word_units

LENGTH = 35
#: Words of the anchors; the longer ones part crowded anchors.
SEEDS = (10, 18, 27, 35)


def _parted(group: np.ndarray, word: np.ndarray, there: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The classes after one more word; -1 for a place that has no such word or is alone in its class."""
    out = np.full(len(group), -1, np.int64)
    live = np.flatnonzero(there & (group >= 0))
    if len(live):
        _, new = np.unique(group[live] * (int(word.max()) + 1) + word[live], return_inverse=True)
        alone = np.bincount(new, weights=copies[live]) < 2
        out[live] = np.where(alone[new], -1, new)
    return out


def extend_block(block: Block, length: int) -> tuple[np.ndarray, np.ndarray]:
    number: dict[bytes, int] = {}
    words, sizes = [], []
    for body in block.bodies:
        said = body.split(b" ")
        sizes.append(len(said))
        words += [number.setdefault(w, len(number)) for w in said]
    ids = np.array(words, np.int64)
    ends = np.cumsum(sizes)
    first = ends - np.array(sizes)
    windows = ends - first - length + 1
    anchor = first + block.off
    _, group = np.unique(block.seed, return_inverse=True)
    right, left = [group], [group]
    for r in range(length):
        at = anchor + r
        right.append(_parted(right[-1], ids[np.minimum(at, ends - 1)], at < ends, block.copies))
    for x in range(1, int(block.off.max()) + 1):
        at = anchor - x
        left.append(_parted(left[-1], ids[np.maximum(at, first)], at >= first, block.copies))
    base = np.cumsum(windows) - windows
    hit = np.zeros(int(windows.sum()), bool)
    for x, of_left in enumerate(left):
        w, of_right = block.off - x, right[length - x]
        live = np.flatnonzero((w >= 0) & (w < windows) & (of_left >= 0) & (of_right >= 0))
        if len(live):
            _, both = np.unique(of_left[live] * len(first) + of_right[live], return_inverse=True)
            hit[(base + w)[live]] = (np.bincount(both, weights=block.copies[live]) > 1)[both]
    return windows, hit


SEARCH = Search(word_units, word_cut, LENGTH, SEEDS, extend_block)


def remove_repeats(docs: DataFrame, texts: bool = False, how: Search = SEARCH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the words left, if texts) for each row of docs.

    Null and empty texts have no words. Of rows that repeat every word under a window is removed, as each is elsewhere
    for the other; rows are told apart where ids repeat, are null or aren't numbers. Very long texts are searched in
    overlapping parts. An empty table gives no rows; further columns are ignored.
    """
    base = keyed(docs)
    marks = repeated_windows(base.select("key", "text"), how)
    joined = base.join(marks, "key", "left").select("doc_id", "text", "marks")
    length = how.length

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).cast(pa.large_binary()), covered(batch.column(2), length), strict=True):
                words = text.as_py().split()
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rest = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace") if texts else None))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = base.schema["doc_id"].dataType.simpleString()
    out = joined.mapInArrow(tidied(scan), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if texts else out.drop("kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats over the whole texts of documents, 35 words; nulls, ties and odd rows as stated there."""
    return remove_repeats(spread(documents(spark, sf_dir), "doc_id", "text"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
hits AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM hits),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS rest, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
