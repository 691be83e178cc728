"""Quality classifier: random-indexing vectors pooled per document, a two-layer numpy network, calibrated by temperature.

Every word, and every word's shape (letters as a or A, digits as 0, other signs as they are, runs once), has a sparse
random index vector that follows from its hash. A word's vector is its index vector plus what was gathered from its
neighbours in the sample; a document is the mean over its words and over its shapes, with four figures of its form.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import kernel as K
from quillmark.llm.common import bound_batches, discard, documents, give_back, spread, table, text_of, tidied, written

DIM = 32
NONZERO = 4
BUCKETS = 1 << 15
#: About so many labelled rows, chosen by a hash of the id, train the network; fewer if fewer have labels.
SAMPLE_ROWS = 8000
#: Bytes of a text that can be in a sample, and of the whole sample; beyond that fewer rows are taken.
SAMPLE_TEXT, SAMPLE_BYTES = 1 << 20, 64 << 20
HIDDEN = 24
DRIVER_SLICE = 1 << 18

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def index_vectors(n: int = BUCKETS, dim: int = DIM, seed: int = 11) -> np.ndarray:
    """A row for each bucket: NONZERO entries of +1 or -1, the rest 0."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, dim), np.float32)
    where = rng.integers(0, dim, (n, NONZERO))
    sign = rng.choice(np.array([-1, 1], np.float32), (n, NONZERO))
    np.add.at(out, (np.arange(n)[:, None], where), sign)
    return out


@dataclass
class Words:
    """Of a slice of documents: bucket of each word and of its shape, word hash, and each document's first word."""

    bucket: np.ndarray
    shape: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    length: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    starts, ends = K.word_spans(data, offsets)
    h = K.span_hash(K.prefix_hash(data), starts, ends)
    kind = _CLASS[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    s = K.span_hash(K.prefix_hash(kind[keep]), place[starts], place[ends])
    low = np.uint64(BUCKETS - 1)
    return Words((h & low).astype(np.int32), (s & low).astype(np.int32), h, np.searchsorted(starts, offsets), ends - starts)


def _means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of each document's rows, 0 for one without."""
    counts = np.diff(first)
    out = np.zeros((len(counts), *values.shape[1:]), np.float32)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0) / counts[full].reshape(-1, *[1] * (values.ndim - 1))
    return out


def features(words: Words, vectors: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    n = np.diff(words.first)
    again = np.zeros(len(words.hash), np.float32)
    again[1:] = words.hash[1:] == words.hash[:-1]
    again[words.first[:-1][n > 0]] = 0
    form = np.stack([np.log1p(n), np.log1p(_means(words.length.astype(np.float32), words.first)), 4 * _means(again, words.first), (n == 0) * 1.0], axis=1)
    return np.concatenate([4 * _means(vectors[words.bucket], words.first), 4 * _means(shapes[words.shape], words.first), form], axis=1, dtype=np.float32)


def context_vectors(columns: Iterable[Words], index: np.ndarray) -> np.ndarray:
    """Index vectors plus the unit sum of index vectors met one and two words away."""
    met = np.zeros_like(index)
    for w in columns:
        doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        for step in (1, 2):
            same = doc[step:] == doc[:-step]
            a, b = w.bucket[:-step][same], w.bucket[step:][same]
            np.add.at(met, a, index[b])
            np.add.at(met, b, index[a])
    size = np.linalg.norm(met, axis=1, keepdims=True)
    return (index + 2 * met / np.maximum(size, 1e-9)).astype(np.float32)


class Network:
    """One hidden layer of tanh units and a logistic output, trained by Adam; dividing its logit by the temperature calibrates it."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.center, self.scale, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.center) / self.scale) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rounded, as the last bits of a product depend on which rows are worked on together."""
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40))), 9)

    def backward(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Gradients for rows x (centred and scaled) whose loss has these slopes by the logit."""
        h = np.tanh(x @ self.w[0] + self.w[1])
        back = slope[:, None] * self.w[2] * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()])]

    def fit(self, x: np.ndarray, slope, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> None:
        """slope(rows, logits) gives the loss's slope by each logit."""
        self.center, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.center) / self.scale
        rng, m, v, t = np.random.default_rng(seed), [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            step = rate * (1 - epoch / epochs)
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                logits = np.tanh(x[rows] @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]
                t += 1
                for k, g in enumerate(self.backward(x[rows], slope(rows, logits))):
                    g = g + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least log loss on rows that weren't fitted; a few rows can't move it far from 1."""
        z = self.logits(x)
        loss = lambda t: np.logaddexp(0, -z / t * (2 * y - 1)).sum() + 4 * np.log(t) ** 2
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss)) if len(x) else 1.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class QualityModel:
    vectors: np.ndarray
    shapes: np.ndarray
    network: Network

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for a, b, data, offsets in K.slices(column):
            out[a:b] = self.network.score(features(read_words(data, offsets), self.vectors, self.shapes))
        return out


def _slices(texts: pa.Array) -> Iterator[Words]:
    """Words of small slices: training runs on the driver, whose memory is little."""
    return (read_words(data, offsets) for _, _, data, offsets in K.slices(texts, DRIVER_SLICE))


def train(texts: pa.Array, labels: np.ndarray, part: np.ndarray) -> QualityModel:
    """part says which rows (True) serve to set the temperature; the others fit vectors and network.

    Without rows, or with one label only, the model still scores: near that label, or 0.5.
    """
    index = index_vectors()
    shapes = index_vectors(seed=13)
    vectors = context_vectors(_slices(texts), index)
    x = np.concatenate([np.zeros((0, 2 * DIM + 4), np.float32), *(features(w, vectors, shapes) for w in _slices(texts))])
    net = Network(x.shape[1])
    fit = ~part if (~part).any() else part
    y = labels[fit].astype(float)
    if len(y):
        net.fit(x[fit], lambda rows, z: (_sigmoid(z) - y[rows]) / len(rows))
    net.calibrate(x[part], labels[part].astype(float))
    return QualityModel(vectors, shapes, net)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> pa.Table:
    """text, label, part of about `rows` labelled rows outside the held-out remainder 2, in order of id.

    Rows are chosen by a hash of the id, so reruns agree. Null labels are no labels. part is 0 to 7, by another hash.
    """
    known = spread(labels, "doc_id", label).where(F.col(label).isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    texts = spread(docs, "doc_id", "text").where(~held_out())
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(8)).cast("int").alias("part")
    sample = texts.join(known, "doc_id").select("doc_id", text_of().alias("text"), "label", part)
    return fetched(sample).sort_by([("doc_id", "ascending"), ("text", "ascending")])


def fetched(sample: DataFrame, most: int = SAMPLE_BYTES) -> pa.Table:
    """sample(doc_id, text, ..) on the driver, without texts over SAMPLE_TEXT, thinned by a hash of the id to about `most` bytes."""
    kept = written(sample.where(F.octet_length("text") <= SAMPLE_TEXT), "sample")
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    thin = kept if size <= most else kept.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("bytes")), F.lit(1 << 20)) < int((1 << 20) * most / size))
    out = thin.toArrow()
    discard(kept)
    return out


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, model, threshold: float) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted for each row.

    Null text scores as empty text does, and equal texts score alike; rows that repeat are scored each; a null id is not
    held out. A score that equals the threshold is predicted 1. An empty table gives no rows; further columns are
    ignored. A text is worked on as a whole, at some 40 bytes of memory a byte.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held.value.score(batch.column(2)))], ["doc_id", "held_out", "score"])

    scored = docs.select(F.col("doc_id"), held_out().alias("held_out"), text_of().alias("text")).mapInArrow(tidied(scan), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_model(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """A model from docs(doc_id, text) and labels(doc_id, quality).

    Null labels and ids are no labels; an id with two labels counts with both; null text is empty. Without rows a score
    still comes, near 0.5.
    """
    sample = labelled_sample(docs, labels, "quality", rows)
    model = train(sample.column("text"), sample.column("label").to_numpy(), sample.column("part").to_numpy() == 0)
    del sample
    give_back()
    return model


THRESHOLD = 0.7


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_documents over the whole texts of documents; nulls, ties and odd rows as stated there."""
    docs = documents(spark, sf_dir)
    return score_documents(spread(docs, "doc_id", "text"), quality_model(docs, table(spark, sf_dir, "labels")), THRESHOLD)


def good_documents(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs that the classifier doesn't reject, unchanged; it is trained on the texts of labelled (docs if not given).

    A row stays if its score reaches the threshold; null text scores as empty text, rows that repeat score alike. An empty
    table gives no rows.
    """
    model = quality_model(docs if labelled is None else labelled, labels)
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.score(batch.column(at)) >= threshold))

    return docs.mapInArrow(tidied(scan), docs.schema)
