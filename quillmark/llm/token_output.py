"""Token ids as binary files: one flat id array per segment, document bounds beside it in Elias-Fano form.

A segment holds documents in ascending doc_id order. Its bytes, all little-endian:

    magic 8 bytes | n_docs, n_null, n_tokens, base as int64 | EF(doc_id - base) | EF(document ends) | ids as uint32

The first n_null documents have a null id. EF(values) is: count, low bits, bytes of lows, bytes of highs, samples as
int64; the packed low bits of all values; a bit vector with bit (high + i) set for the i-th value; and the place of
every 64th set bit as uint32. select(i) starts from a sample and counts bits over a few words, so an offset is found
without a table of 64-bit offsets. Segments are rows of a Parquet table, so that any store and any lost task is fine.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import REMEMBERED, documents, spread, text_of, tidied, written

MAGIC = b"QMTOKEN1"
END_ID = 2
SEGMENT_BYTES = 4 << 20
SAMPLE = 64
#: Bytes of words, and of pieces, with their ids that a worker remembers; beyond that it starts anew.
WORD_BYTES, PIECE_BYTES = 16 << 20, 64 << 20
#: What an entry takes besides the bytes of its word and ids: two objects and their place in the table.
_ENTRY = 180

#: What a file says whose ids follow from words (fixed values).
_WORD_NORM = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORD_PRE = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_LETTERS = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
#: Texts that neither normal forms nor unusual spaces nor unusual letters concern: only lower case is to be made of them.
_PLAIN = re.compile(r"[\x09-\x0D\x20-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*").fullmatch
#: What the pre-tokenizer cuts such a text into, once it is in lower case.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xFF]+|[0-9]|[^\x09-\x0D\x20a-z0-9\x80-\xFF]+").findall


def ef_encode(values: np.ndarray) -> bytes:
    """Elias-Fano form of a non-decreasing sequence of non-negative integers."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    top = int(v[-1]) if n else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n and top >= n else 0
    lows = np.zeros(0, np.uint8)
    if low_bits:
        cut = v & np.uint64((1 << low_bits) - 1)
        bits = (cut[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
    places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    flags = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    flags[places] = 1
    highs = np.packbits(flags, bitorder="little")
    samples = places[::SAMPLE].astype("<u4")
    return struct.pack("<5q", n, low_bits, len(lows), len(highs), len(samples)) + lows.tobytes() + highs.tobytes() + samples.tobytes()


class EliasFano:
    """A sequence read from its bytes; at says where it starts, end where it stops."""

    def __init__(self, data: memoryview, at: int = 0):
        self.n, self.low_bits, n_low, n_high, n_samples = struct.unpack_from("<5q", data, at)
        at += 40
        self.lows = np.frombuffer(data, np.uint8, n_low, at)
        self.highs = np.frombuffer(data, np.uint8, n_high, at + n_low)
        self.samples = np.frombuffer(data, "<u4", n_samples, at + n_low + n_high)
        self.end = at + n_low + n_high + 4 * n_samples

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        word = int.from_bytes(self.lows[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (word >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, place // 8
        first = int(self.highs[byte]) >> (place % 8) << (place % 8)
        while (here := first.bit_count()) <= left:
            left -= here
            byte += 1
            first = int(self.highs[byte])
        for _ in range(left):
            first &= first - 1
        return ((byte * 8 + (first & -first).bit_length() - 1 - i) << self.low_bits) | self._low(i)

    def batch(self, k: int) -> np.ndarray:
        """The values of select for the k-th SAMPLE indexes, by the sample where they begin and the one where they end."""
        a, b = k * SAMPLE, min(self.n, (k + 1) * SAMPLE)
        first = int(self.samples[k])
        last = int(self.samples[k + 1]) if b < self.n else 8 * len(self.highs)
        places = np.flatnonzero(np.unpackbits(self.highs[first // 8 : last // 8 + 1], bitorder="little")) + first // 8 * 8
        places = places[places >= first][: b - a]
        out = (places - np.arange(a, b)).astype(np.int64) << self.low_bits
        if self.low_bits:
            low = a * self.low_bits
            bits = np.unpackbits(self.lows[low // 8 : (b * self.low_bits + 7) // 8], bitorder="little")[low % 8 :][: (b - a) * self.low_bits]
            out |= bits.reshape(b - a, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out

    def batches(self) -> Iterator[np.ndarray]:
        """All values in turn, SAMPLE at a time: there is never a table of them."""
        return map(self.batch, range(len(self.samples)))

    def all(self) -> np.ndarray:
        """All values as one array; for short sequences."""
        return np.concatenate([np.zeros(0, np.int64), *self.batches()])


def pack_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    known = [x for x in doc_ids if x is not None]
    base = known[0] if known else 0
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
    head = MAGIC + struct.pack("<4q", len(ids), len(ids) - len(known), int(ends[-1]), base)
    return head + ef_encode(np.array([x - base for x in known], dtype=np.int64)) + ef_encode(ends) + b"".join(ids)


class Segment:
    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token segment")
        self.n_docs, self.n_null, self.n_tokens, self.base = struct.unpack_from("<4q", view, 8)
        self._docs = EliasFano(view, 40)
        self._ends = EliasFano(view, self._docs.end)
        self.ids = view[self._ends.end : self._ends.end + 4 * self.n_tokens]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + (self._docs.all() + self.base).tolist()

    def documents(self) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """doc_ids, starts and ends of the documents, a batch of selected bounds at a time."""
        known = (x for own in self._docs.batches() for x in own.tolist())
        before, nulls = 0, self.n_null
        for ends in self._ends.batches():
            ids = [None] * min(nulls, len(ends))
            nulls -= len(ids)
            ids += [next(known) + self.base for _ in range(len(ends) - len(ids))]
            yield ids, np.concatenate([[before], ends[:-1]]).astype(np.int64), ends
            before = int(ends[-1])

    def tokens(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by select."""
        start = self._ends.select(i - 1) if i else 0
        return np.frombuffer(self.ids[4 * start : 4 * self._ends.select(i)], "<u4")


class _Remembered(dict):
    """Ids by word or piece: what is missing is made and kept, until all takes too many bytes."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.size = make, limit, 0

    def __missing__(self, key):
        ids = self.make(key)
        if self.size >= self.limit:
            self.clear()
            self.size = 0
        self[key] = ids
        self.size += _ENTRY + len(key) + len(ids)
        return ids


class Encoder:
    """Whole-text encoding by a tokenizers file.

    Where the file's pre-tokenizer throws white space away and nothing reaches over it, the ids of a text are those of
    its pieces one after the other, and each distinct piece goes through the model once; ids are remembered, in memory of
    bounded size. Texts of printable ASCII and Latin-1 letters are cut into pieces by the pre-tokenizer's own pattern once
    they are in lower case; other texts go word by word through the file's normaliser and pre-tokenizer. Words that hold
    an added token, and files of other kinds, are encoded by the library as a whole.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer, self.pre = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.end = struct.pack("<I", end_id)
        self.known = _Remembered(self._word, WORD_BYTES)
        self.pieces = _Remembered(self._piece, PIECE_BYTES)
        self.coded = _Remembered(self._ids, WORD_BYTES)
        with open(path, encoding="utf-8") as f:
            says = json.load(f)
        self.added = [x["content"].encode() for x in says["added_tokens"]]
        self.held = re.compile(b"|".join(map(re.escape, self.added)) or b"(?!)").search
        self.sign = bytes(sorted(set.intersection(*map(set, self.added)))[:1]) if self.added else b""
        self.bytes = {ord(c): self.pre.pre_tokenize_str(c)[0][0] for c in _LETTERS} if self.pre else {}
        self.by_word = says.get("pre_tokenizer") == _WORD_PRE and says.get("normalizer") == _WORD_NORM and not any(x.split() != [x] for x in self.added)

    def _ids(self, coded: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(coded)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        return self._ids(piece if piece.isascii() else piece.translate(self.bytes))

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.sign in word and self.held(word):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self.coded[x] for x, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(text))])

    def _text(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if _PLAIN(text) and not (self.sign in raw and self.held(raw)):
            return b"".join(map(self.pieces.__getitem__, _PARTS(text.lower())))
        return b"".join(map(self.known.__getitem__, raw.split()))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text with the end id, as little-endian uint32."""
        if not self.by_word:
            done = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [np.array(x.ids, dtype="<u4").tobytes() + self.end for x in done]
        return [self._text(raw) + self.end for raw in texts]


_ENCODERS: dict[tuple, Encoder] = {}
REMEMBERED[__name__] = _ENCODERS.clear


def _encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of docs (doc_id, text), written in the shared folder and read again: part, seg, n_docs, n_tokens, blob.

    Parts follow each other in ascending doc_id order (null first), and so do segments in a part. Null text is empty: it
    has the end id only. Rows that repeat stay, side by side. An empty table gives no segments. Further columns are left.
    """
    ordered = spread(docs, "doc_id", "text").select("doc_id", text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seg = _encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        doc_ids, ids, size = [], [], 0
        names = ["part", "seg", "n_docs", "n_tokens", "blob"]

        def flush() -> pa.RecordBatch:
            row = [[part], [seg], [len(ids)], [size // 4], [pack_segment(doc_ids, ids)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for at in range(0, len(texts), 32):
                for doc_id, coded in zip(batch.column(0)[at : at + 32].to_pylist(), encoder.encode(texts[at : at + 32].to_pylist()), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(coded)
                    size += len(coded)
                    if size >= segment_bytes:
                        yield flush()
                        doc_ids, ids, size, seg = [], [], 0, seg + 1
        if ids:
            yield flush()

    return written(ordered.mapInArrow(tidied(segments), "part int, seg int, n_docs long, n_tokens long, blob binary"), "tokens")


def read_index(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the bytes of the segments."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seg, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                s = Segment(blob.as_buffer())
                for ids, starts, ends in s.documents():
                    sums = [zlib.crc32(s.ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    n = len(ends)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, seg.as_py(), np.int32)), pa.array(ids, pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(sums, pa.int64())],
                        ["part", "seg", "doc_id", "at", "n_tokens", "ids_crc32"],
                    )

    rows = segments.select("part", "seg", "blob").mapInArrow(tidied(read), "part int, seg int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = segments.select("part", "seg", F.col("n_tokens").alias("size"))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("size")).select("part", before(Window.orderBy("part")).alias("part_start"))
    inside = sizes.select("part", "seg", before(Window.partitionBy("part").orderBy("seg")).alias("seg_start"))
    starts = inside.join(parts, "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("first"))
    return rows.join(starts, ["part", "seg"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """write_tokens over the whole texts of documents, and what its segments say; nulls, ties and odd rows as stated there."""
    return read_index(write_tokens(documents(spark, sf_dir), default_tokenizer()))
