"""Near-duplicate groups by one-permutation MinHash with optimal densification, bands and stars.

A document's set is that of its distinct shingles of k words: 2 in op3, as many as the caller says elsewhere. One hash
of each shingle gives its bin (high bits) and its value; a bin keeps its smallest value, and an empty bin takes that of
the first full bin in a probe order that is the same for all documents. Bands of bins are bucket keys. Documents of
equal sets are one node from the start. Within a bucket only pairs of the centre and another node are candidates (a
star), so their number stays below that of the band rows; each candidate is confirmed on full sets of 128-bit hashes.

A star may miss a link between two of its rays, so buckets whose nodes are not yet in one component are gone through
once more, in blocks of bounded size: nodes outside the bucket's largest component meet all its nodes, each pair in the
first band that it shares only. A block compares signatures and gives the pairs that agree well enough for a check on
full sets; where those would be many more than the nodes, the nodes' sets come to the block instead, and it gives one
link for two components at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import kernel as K
from quillmark.llm.common import discard, documents, ids_are_keys, keyed, spread, tidied, written

SHINGLE = 2
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
PROBES = 64
SIMILARITY = 80
#: Nodes in a part of a large bucket, bytes of their sets, and pairs a node in a block beyond which sets come to it.
PART, PART_BYTES, DENSE = 1024, 16 << 20, 4
#: Sets of fewer shingles fill few bins: their pairs go to the check on full sets whatever their signatures say.
FEW = 32
SALTS = 32

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)
#: Where bin j looks, in turn, when it is empty.
_PROBE = np.random.default_rng(3).integers(0, BINS, (BINS, PROBES))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each document, two lanes of 64 bits of each, sorted by the first lane.

    All words are one shingle where they are fewer than k. A lane of a shingle mixes its words' hashes one by one.
    """
    starts, ends = K.word_spans(data, offsets)
    low = K.LOWER[data]
    words = [K.span_keys(low, starts, ends, lane) for lane in (0, 1)]
    first = np.searchsorted(starts, offsets)
    n = len(starts)

    def joined(lane: int, count: int, at: np.ndarray) -> np.ndarray:
        h = np.full(len(at), _U(count + 7 * lane))
        for i in range(count):
            h = K.mix((h ^ words[lane][at + i]) * _U(0x9E3779B97F4A7C15) + _U(i + 1))
        return h

    every = [joined(lane, k, np.arange(max(0, n - k + 1))) for lane in (0, 1)]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            one, where = np.unique(every[0][a : b - k + 1], return_index=True)
            out.append(np.stack([one, every[1][a : b - k + 1][where]]))
        elif b > a:
            out.append(np.stack([joined(lane, b - a, np.array([a])) for lane in (0, 1)]))
        else:
            out.append(np.zeros((2, 0), np.uint64))
    return out


def packed(one: np.ndarray) -> bytes:
    return one.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64).reshape(2, -1)


def numbered(every: np.ndarray) -> np.ndarray:
    """The same number for shingles that are equal in both lanes, and others for others."""
    order = np.argsort(every[0], kind="stable")
    a, b = every[0][order], every[1][order]
    new = a[1:] != a[:-1]
    if (~new & (b[1:] != b[:-1])).any():  # the first lane alone doesn't tell them apart
        order = np.lexsort((every[1], every[0]))
        a, b = every[0][order], every[1][order]
        new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(new)])[: len(order)]
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values for each non-empty set (of first lanes); rows of empty sets mean nothing."""
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), BINS), _NONE)
    if sizes.sum():
        h = K.mix(np.concatenate(sets) + _U(0x5851F42D4C957F2D))
        row = np.repeat(np.arange(len(sets)), sizes)
        shift = _U(64 - (BINS - 1).bit_length())
        np.minimum.at(out.reshape(-1), row * BINS + (h >> shift).astype(np.int64), h)
        empty = out == _NONE
        filled = out.copy()
        r, c = np.nonzero(empty & (sizes > 0)[:, None])
        for t in range(PROBES):
            if not len(r):
                break
            source = _PROBE[c, t]
            good = ~empty[r, source]
            filled[r[good], c[good]] = out[r[good], source[good]]
            r, c = r[~good], c[~good]
        if len(r):  # all probes empty: the first full bin after, in circular order
            step = np.argmax(~empty[r[:, None], (c[:, None] + np.arange(BINS)) % BINS], axis=1)
            filled[r, c] = out[r, (c + step) % BINS]
        out = filled
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(K.mix(np.arange(BANDS, dtype=np.uint64) + _U(77)), (len(signature), BANDS)).copy()
    for i in range(ROWS):
        h = K.mix(h ^ signature[:, i::ROWS] * _U(0x9FB21C651E98DF25))
    return h.view(np.int64)


def sign(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """key, n (set size), s1, s2 (digest of the set), sig (a byte for each bin), bands of docs(key, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1)):
                sets = shingle_sets(data, offsets, k)
                full = np.array([x.shape[1] > 0 for x in sets])
                s = signatures([x[0] for x in sets])
                digests = np.array([divmod(xxhash.xxh3_128_intdigest(packed(x)), 1 << 64) for x in sets], dtype=np.uint64).view(np.int64)
                bands = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32), band_keys(s)[full].ravel())
                sig = [x.tobytes() for x in (K.mix(s) >> _U(56)).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([x.shape[1] for x in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(sig, pa.binary()), bands],
                    ["key", "n", "s1", "s2", "sig", "bands"],
                )

    return docs.select("key", "text").mapInArrow(tidied(scan), "key long, n long, s1 long, s2 long, sig binary, bands array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, k: int = SHINGLE) -> DataFrame:
    """node, set (16 bytes a shingle) of the documents whose keys are in ids(node)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([packed(x) for x in shingle_sets(data, offsets, k)], pa.binary())], ["node", "set"])

    return docs.select(F.col("key").alias("node"), "text").join(ids, "node", "left_semi").mapInArrow(tidied(scan), "node long, set binary")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in half the bins at least, or with few shingles. At similarity 0.8 half is eight deviations off."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
            near = ((a == b).sum(axis=1) >= BINS // 2) | (batch.column(4).to_numpy() < FEW)
            yield batch.select([0, 1]).filter(pa.array(near))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets have 100 * intersection >= SIMILARITY * union."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            both = np.concatenate([unpacked(x.as_buffer()), unpacked(y.as_buffer())], axis=1)
            union = int(numbered(both).max()) + 1
            keep.append(100 * (both.shape[1] - union) >= SIMILARITY * union)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, signed: DataFrame, docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) that are links, written."""
    of = lambda x: signed.select(F.col("key").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(f"100 * least(n_a, n_b) >= {SIMILARITY} * greatest(n_a, n_b)")
    rows = both.select("a", "b", "sig_a", "sig_b", F.least("n_a", "n_b").alias("least"))
    alike = written(rows.mapInArrow(tidied(_alike), "a long, b long").distinct(), "near-alike")
    ids = written(alike.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-ids")
    sets = sets_of(docs, ids, k)
    whole = alike.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    links = written(whole.select("a", "b", "set_a", "set_b").mapInArrow(tidied(_linked), "a long, b long").distinct(), "near-links", batch=100)
    discard(alike)
    discard(ids)
    return links


@dataclass
class Block:
    """Nodes of a bucket: those with x, which lie outside its largest component, are to meet those with y."""

    node: np.ndarray
    comp: np.ndarray
    n: np.ndarray
    x: np.ndarray
    y: np.ndarray
    sig: np.ndarray
    bands: np.ndarray
    key: int

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(p, all q) of different components whose sizes and signatures allow a link and that share no earlier band."""
        band = int(np.argmax(self.bands[0] == self.key))
        place = np.arange(len(self.node))
        for p in np.flatnonzero(self.x).tolist():
            fits = self.y & (self.comp != self.comp[p]) & (100 * np.minimum(self.n, self.n[p]) >= SIMILARITY * np.maximum(self.n, self.n[p]))
            fits &= ~(self.x & self.y[p]) | (place > p)  # a pair that meets both ways counts once
            q = np.flatnonzero(fits)
            q = q[~(self.bands[q, :band] == self.bands[p, :band]).any(axis=1)]
            q = q[((self.sig[q] == self.sig[p]).sum(axis=1) >= BINS // 2) | (np.minimum(self.n[q], self.n[p]) < FEW)]
            if len(q):
                yield p, q


_BLOCK = ("key", "i", "j", "x", "y", "comp", "node", "n", "sig", "bands")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Block, list]]:
    """Whole blocks from rows sorted by (key, i, j): their names, the block, and the values of a further column."""
    held: list[tuple] = []

    def made() -> tuple[tuple, Block, list]:
        x, y, comp, node, n, sig, bands = ([r[k] for r in held] for k in range(3, 10))
        sigs = np.frombuffer(b"".join(sig), np.uint8).reshape(len(held), BINS)
        name = held[0][:3]
        return name, Block(np.array(node), np.array(comp), np.array(n), np.array(x), np.array(y), sigs, np.array(bands, dtype=np.int64), name[0]), [r[10] for r in held if len(r) > 10]

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:3] != held[0][:3]:
                yield made()
                held = []
            held.append(row)
    if held:
        yield made()


def _promising(batches: Iterator[pa.RecordBatch], dense: int) -> Iterator[pa.RecordBatch]:
    """key, i, j, a, b: pairs for a check on full sets; without a and b, a block with too many of them."""
    for name, block, _ in _blocks(batches):
        a, b = [], []
        for p, q in block.pairs():
            a += [int(block.node[p])] * len(q)
            b += block.node[q].tolist()
            if len(a) > dense * len(block.node):
                a, b = [None], [None]
                break
        if a:
            yield pa.RecordBatch.from_arrays([*[pa.array([x] * len(a), t) for x, t in zip(name, (pa.int64(), pa.int32(), pa.int32()), strict=True)], pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "i", "j", "a", "b"])


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: a link for each two components of a block that have one. Sets are the last column."""
    for _, block, sets in _blocks(batches):
        each = [unpacked(x) for x in sets]
        ids = numbered(np.concatenate(each, axis=1))
        starts = np.concatenate([[0], np.cumsum([x.shape[1] for x in each])])
        seen, a, b = set(), [], []
        flags = np.zeros(int(ids.max()) + 1, bool)
        for p, q in block.pairs():
            own = ids[starts[p] : starts[p + 1]]
            flags[own] = True
            for k in q.tolist():
                names = tuple(sorted((int(block.comp[p]), int(block.comp[k]))))
                if names not in seen:
                    both = int(flags[ids[starts[k] : starts[k + 1]]].sum())
                    if 100 * both >= SIMILARITY * int(block.n[p] + block.n[k] - both):
                        seen.add(names)
                        a.append(int(block.node[p]))
                        b.append(int(block.node[k]))
            flags[own] = False
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def cross_links(mixed: DataFrame, signed: DataFrame, docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Links (a, b) between different components in mixed(key, node, comp, total, outside, units, top), written.

    Nodes outside the bucket's largest component are dealt into parts of PART nodes (and PART_BYTES of sets), and so are
    all nodes; each part of the first meets each of the second. A node of the largest component is copied once for
    each part of the others only.
    """
    parts = lambda n: F.greatest(F.ceil(F.col(n) / PART), F.ceil(F.col("units") * 16 * F.col(n) / F.col("total") / PART_BYTES), F.lit(1)).cast("int")
    rows = mixed.withColumn("px", parts("outside")).withColumn("py", parts("total"))
    rows = rows.withColumn("out", F.col("comp") != F.col("top")).withColumn("own_x", F.pmod(F.xxhash64("node"), "px").cast("int")).withColumn("own_y", F.pmod(F.xxhash64("node", F.lit(1)), "py").cast("int"))
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_y = F.transform(count("px"), lambda i: F.struct(i.alias("i"), F.col("own_y").alias("j"), (F.col("out") & (i == F.col("own_x"))).alias("x"), F.lit(True).alias("y")))
    as_x = F.transform(F.filter(count("py"), lambda j: F.col("out") & (j != F.col("own_y"))), lambda j: F.struct(F.col("own_x").alias("i"), j.alias("j"), F.lit(True).alias("x"), F.lit(False).alias("y")))
    rows = rows.select("key", "comp", "node", F.explode(F.concat(as_y, as_x)).alias("at")).select("key", "at.i", "at.j", "at.x", "at.y", "comp", "node")
    blocks = rows.join(signed.select(F.col("key").alias("node"), "n", "sig", "bands"), "node").select(*_BLOCK)
    whole = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    dense_from = DENSE
    found = written(whole(blocks).mapInArrow(tidied(lambda batches: _promising(batches, dense_from)), "key long, i int, j int, a long, b long"), "near-promising")
    sparse = found.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = confirm(sparse, signed, docs, k)
    dense = found.where("a IS NULL").select("key", "i", "j")
    if not dense.isEmpty():
        full = blocks.join(dense, ["key", "i", "j"], "left_semi")
        joined = full.join(sets_of(docs, full.select("node").distinct(), k), "node").select(*_BLOCK, "set")
        links = links.union(written(whole(joined).mapInArrow(tidied(_joining), "a long, b long"), "near-joining", batch=100))
    return links


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of the nodes of links(a, b), written. Labels spread and jump until none moves."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(both, "near-edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "near-labels")
    while True:
        heard = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("comp").alias("old"), F.least("comp", "heard").alias("up"))
        jump = labels.select(F.col("node").alias("up"), F.col("comp").alias("far"))
        after = written(near.join(jump, "up").select("node", "old", F.least("up", "far").alias("comp")), "near-labels")
        discard(labels)
        labels = after.select("node", "comp")
        if after.where("old <> comp").isEmpty():
            discard(edges)
            return labels


def row_components(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """key, n_shingles, comp (smallest key reachable) for each row of docs(key, text); keys tell rows apart."""
    signed = written(sign(docs, k), "near-signed")
    known = signed.where("n > 0")
    # the first of equal sets, by salts first, so that a set of very many documents meets in no one task
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt")
    salted = known.groupBy("s1", "s2", salt).agg(F.min("key").alias("top"))
    first = salted.groupBy("s1", "s2").agg(F.min("top").alias("node"))
    named = salted.drop("top").join(first, ["s1", "s2"])
    members = signed.select("key", "n", "s1", "s2", salt).join(named, ["s1", "s2", "salt"], "left").select("key", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    members = written(members, "near-members")
    nodes = members.where("key = node").select("key")
    rows = known.join(nodes, "key", "left_semi").select(F.explode("bands").alias("key"), F.col("key").alias("node"), "n")
    rows = written(rows, "near-bands")
    centres = rows.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").drop("last")
    buckets = written(rows.join(centres, "key"), "near-buckets")
    discard(rows)
    stars = buckets.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = confirm(stars, known, docs, k)
    labels = components(links)
    placed = buckets.select("key", "node", "n").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")).distinct()
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("units"))
    largest = F.max(F.struct("size", "comp")).alias("largest")
    counts = sizes.groupBy("key").agg(F.sum("size").alias("total"), F.sum("units").alias("units"), largest).where("total > largest.size")
    counts = counts.select("key", "total", "units", (F.col("total") - F.col("largest.size")).alias("outside"), F.col("largest.comp").alias("top"))
    mixed = written(placed.drop("n").join(counts, "key"), "near-mixed")
    discard(buckets)
    found = cross_links(mixed, known, docs, k)
    discard(mixed)
    if not found.isEmpty():
        labels = components(links.union(found))
    comp = F.when(F.col("n") > 0, F.coalesce("comp", "node")).otherwise(F.col("key"))
    return members.join(labels, "node", "left").select("key", F.col("n").alias("n_shingles"), comp.alias("comp"))


def near_components(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept for each row of docs(doc_id, text).

    Null and empty texts have no shingles and are linked with nothing. Rows are told apart even where ids repeat, are null
    or aren't numbers: of a component the first row of the smallest id is kept, null ids come last, and component_id is
    null where no row of it has an id. Rows that repeat are linked, if they have words. An empty table gives no rows;
    further columns are ignored. A text is worked on as a whole, at some 40 bytes of memory a byte.
    """
    by_id = ids_are_keys(docs)
    base = keyed(spread(docs, "doc_id", "text"), by_id=by_id)
    found = row_components(base, k)
    if by_id:
        out = found.select(F.col("key").cast(base.schema["doc_id"].dataType).alias("doc_id"), "n_shingles", F.col("comp").cast(base.schema["doc_id"].dataType).alias("component_id"))
        return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    found = written(found.join(base.select("key", "doc_id"), "key"), "near-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")
    firsts = found.groupBy("comp").agg(first).select("comp", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("stays"))
    return found.join(firsts, "comp").select("doc_id", "n_shingles", "component_id", (F.col("key") == F.col("stays")).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_components over the whole texts of documents, two words; nulls, ties and odd rows as stated there."""
    return near_components(documents(spark, sf_dir))


def near_deduplicated(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """docs with one row of each component, unchanged: the one of the smallest id, as near_components keeps it."""
    base = keyed(docs, whole=True)
    found = row_components(base, k)
    order = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")
    kept = found.join(base.select("key", "doc_id"), "key").groupBy("comp").agg(order).select(F.col("first.key").alias("key"))
    return base.join(kept, "key", "left_semi").select(*[F.col(f"row.`{c}`") for c in docs.columns])


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.size + y.size - shared)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b)
SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)
"""
