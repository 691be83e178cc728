"""Vectorised text kernels over Arrow string columns: words, hashes, sliding minima.

Everything here works on the concatenated UTF-8 bytes of a slice of documents, a few MB at a time; a longer
document forms a slice of its own. span_keys mixes each eight bytes in turn and is what sets and words are told apart
by; the polynomial prefix hashes are cheaper for strings that overlap, but linear, so they only say which strings to
bring together, never that two strings are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

#: One random 64-bit number for each byte value.
BYTES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: The same with A-Z read as a-z.
BYTES_LOWER = BYTES.copy()
BYTES_LOWER[65:91] = BYTES[97:123]

#: x20 and x09 to x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), mod 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        m = max(n, SLICE + 4096)
        have = np.full(m, _U(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if m <= 4 * SLICE:
            _POWERS[base] = have
    return have[:n]


def forget() -> None:
    """Drop the remembered powers."""
    _POWERS.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of rows of about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """P with P[i] = sum of table[byte j] * base**j for j < i."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes that doesn't depend on where the span lies."""
    inverse = powers(_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start])


#: Spans of more bytes are hashed one by one.
_LONG = 1024
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
#: Case-folding of A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each span: its bytes are taken eight at a time, and all is mixed after each step.

    Two lanes (0 and 1) are independent, and together a 128-bit hash.
    """
    n = ends - starts
    out = mix(n.astype(np.uint64) * _ODD[1 - lane] + _ODD[lane])
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    live = np.flatnonzero((n > 0) & (n <= _LONG))
    at, left = starts[live], n[live]
    while len(live):
        chunk = eight[at]
        short = left < 8
        chunk[short] &= (_U(1) << (left[short] * 8).astype(np.uint64)) - _U(1)
        out[live] = mix((out[live] ^ chunk) * _ODD[lane] + _U(lane + 1))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=int(_ODD[lane]))
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-separators; none crosses a document's end."""
    inside = ~space[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(starts), np.flatnonzero(last) + 1


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each window of w consecutive hashes, the place of the smallest; equal windows choose alike.

    Hashes are compared by their upper 32 bits and then by place, so the choice depends on the window's content only.
    """
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = _U(0xFFFFFFFF)
    cur = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        cur = np.minimum(cur[: len(cur) - span], cur[span:])
        span *= 2
    if span < w:
        cur = np.minimum(cur[:n], cur[w - span : w - span + n])
    return (cur[:n] & low).astype(np.int64)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, .. lengths[0] numbers, then those of the next pair, and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    steps = np.ones(total, np.int64)
    ends = np.cumsum(lengths)
    steps[0] = starts[0]
    steps[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(steps)
