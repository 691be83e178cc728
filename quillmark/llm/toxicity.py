"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives. The unlabelled texts are a sample of all documents without regard to their
labels; they hold positives at the rate of the class prior, which is estimated from the two samples, below a given bound. A half of the
sample gives a lexicon: words and word beginnings with the log of their document rate among positives over that among
unlabelled texts. A numpy network is trained on what each half's lexicon says of the other half's texts; this is done for
several ways to halve the sample, as a lexicon of few positives depends on which they are. The risk estimator is

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

whose second part, when a batch makes it negative, is stepped back instead of followed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import kernel as K
from quillmark.llm.common import documents, give_back, spread, table, text_of
from quillmark.llm.quality import DRIVER_SLICE, Network, _sigmoid, fetched, held_out, score_documents

#: About so many unlabelled rows and confirmed toxic ones, chosen by a hash of the id, train the model.
SAMPLE_ROWS = 10000
POSITIVE_ROWS = 2000
#: The share of toxic texts in the corpus is taken to be no more than this, whatever the estimate says.
PRIOR = 0.1
THRESHOLD = 0.3
#: Bytes of word beginnings that are features besides whole words.
BEGINNINGS = (4, 5)
LEAST_SUPPORT = 3
LEAST_EVIDENCE = 1.0
LEVELS = (1.5, 2.0, 3.0)
#: Ways to halve the sample.
WAYS = 4

#: All ASCII but letters separates words.
_NO_LETTER = np.zeros(256, dtype=bool)
_NO_LETTER[:128] = True
_NO_LETTER[65:91] = _NO_LETTER[97:123] = False


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (words x kinds of features) of case-folded words, and each document's first word."""
    starts, ends = K.word_spans(data, offsets, _NO_LETTER)
    prefix = K.prefix_hash(data, K.BYTES_LOWER)
    kinds = [K.span_hash(prefix, starts, ends)]
    for n in BEGINNINGS:
        kinds.append(K.span_hash(prefix, starts, np.minimum(starts + n, ends)) + np.uint64(n))
    return np.stack(kinds, axis=1), np.searchsorted(starts, offsets)


@dataclass
class Lexicon:
    """Evidence by feature hash; keys are sorted."""

    keys: np.ndarray
    evidence: np.ndarray


class Lexica:
    """Several lexica in one table: a row of evidence, one column a lexicon, for each key of any.

    A bit table says quickly of most hashes that they are not among the keys.
    """

    def __init__(self, each: list[Lexicon]):
        self.keys = np.unique(np.concatenate([x.keys for x in each])) if each else np.zeros(0, np.uint64)
        self.evidence = np.zeros((len(self.keys), len(each)), np.float32)
        for k, x in enumerate(each):
            self.evidence[np.searchsorted(self.keys, x.keys), k] = x.evidence
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of hashes (words x kinds) of which some lexicon knows a feature, and their strongest evidence in each."""
        word, kind = np.nonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        h = hashes[word, kind]
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        known = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        rows, own = np.unique(word[known], return_inverse=True)
        out = np.zeros((len(rows), self.evidence.shape[1]), np.float32)
        np.maximum.at(out, own, self.evidence[at[known]])
        return rows, out


def _doc_rates(texts: pa.Array, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and in how many of the used documents each is. Counts are merged as slices come."""
    keys, counts, each = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        fresh, n = np.unique(np.concatenate(each), return_counts=True) if each else (keys[:0], counts[:0])
        every, where = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
        return every, np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(every)).astype(np.int64)

    for row, _, data, offsets in K.slices(texts, DRIVER_SLICE):
        hashes, first = word_features(data, offsets)
        each += [np.unique(hashes[a:b]) for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)) if use[row + i]]
        if sum(map(len, each)) > 1 << 21:
            keys, counts = merged()
            each = []
    return merged()


def build_lexicon(texts: pa.Array, positive: np.ndarray, unlabelled: np.ndarray, use: np.ndarray) -> Lexicon:
    keys, n = _doc_rates(texts, use & positive)
    keys, n = keys[n >= LEAST_SUPPORT], n[n >= LEAST_SUPPORT]
    every, m = _doc_rates(texts, use & unlabelled)
    among = np.zeros(len(keys), np.int64)
    if len(every):
        at = np.minimum(np.searchsorted(every, keys), len(every) - 1)
        among = np.where(every[at] == keys, m[at], 0)
    rate = lambda k, total: (k + 0.5) / (total + 1)
    evidence = np.log(rate(n, (use & positive).sum()) / rate(among, (use & unlabelled).sum())).astype(np.float32)
    keep = evidence >= LEAST_EVIDENCE
    return Lexicon(keys[keep], evidence[keep])


def evidence_features(hashes: np.ndarray, first: np.ndarray, lexica: Lexica) -> np.ndarray:
    """By lexicon and document: the strongest evidence, how many words reach each level, and their share of the words."""
    rows, e = lexica.look_up(hashes)
    n = np.diff(first)
    doc = np.searchsorted(first, rows, side="right") - 1
    out = np.zeros((e.shape[1], len(n), 1 + 2 * len(LEVELS)), np.float32)
    for j in range(e.shape[1]):
        np.maximum.at(out[j, :, 0], doc, e[:, j])
        for k, level in enumerate(LEVELS):
            hits = np.bincount(doc[e[:, j] >= level], minlength=len(n))
            out[j, :, 1 + k] = np.log1p(hits)
            out[j, :, 1 + len(LEVELS) + k] = np.log1p(100 * hits / np.maximum(n, 1))
    return out


@dataclass
class ToxicityModel:
    """networks[k] goes with the lexica 2 k and 2 k + 1."""

    lexica: Lexica
    networks: list[Network]
    prior: float

    def score(self, column: pa.Array) -> np.ndarray:
        """The mean of what each network says by either of its lexica, each as strange to the text as in training."""
        out = np.empty(len(column))
        for a, b, data, offsets in K.slices(column):
            x = evidence_features(*word_features(data, offsets), self.lexica)
            out[a:b] = np.round(np.mean([self.networks[j // 2].score(x[j]) for j in range(len(x))], axis=0), 9)
        return out


def class_prior(score: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, most: float) -> float:
    """The share of positives among unlabelled rows, by the best bin: the least ratio of the shares of both above a score.

    The bin is the one of the least upper bound, at 90 % confidence, so thin bins don't win by chance. The estimate is too
    high where no score is reached by positives only, so the given bound is taken where it is less.
    """
    p, u = np.sort(score[positive]), np.sort(score[unlabelled])
    if not len(p) or not len(u):
        return most
    bins = np.unique(p)
    q_p = 1 - np.searchsorted(p, bins) / len(p)
    q_u = 1 - np.searchsorted(u, bins) / len(u)
    unsure = np.sqrt(np.log(40) / 2 / len(p)) + np.sqrt(np.log(40) / 2 / len(u))
    best = np.argmin((q_u + unsure) / q_p)
    return float(min(q_u[best] / q_p[best], most))


def fit_nnpu(net: Network, x: np.ndarray, positive: np.ndarray, prior: float, epochs: int = 60, unlabelled: np.ndarray | None = None) -> None:
    """Logistic loss. positive marks the confirmed rows, unlabelled those that count as such (every row if not given)."""
    free = np.ones(len(x), bool) if unlabelled is None else unlabelled

    def slope(rows: np.ndarray, z: np.ndarray) -> np.ndarray:
        s, p, u = _sigmoid(z), positive[rows], free[rows]
        out = np.zeros(len(rows))
        if p.any():
            out[p] += prior * (s[p] - 1) / p.sum()
        part_u, part_p = np.where(u, s / max(u.sum(), 1), 0), np.where(p, prior * s / max(p.sum(), 1), 0)
        loss = np.logaddexp(0, z)
        negative = (loss[u].mean() if u.any() else 0) - (prior * loss[p].mean() if p.any() else 0)
        return out + (part_u - part_p) if negative >= 0 else -(part_u - part_p)

    net.fit(x, slope, epochs=epochs, batch=512)


def _evidence(texts: pa.Array, lexica: Lexica) -> np.ndarray:
    rows = [evidence_features(*word_features(data, offsets), lexica) for _, _, data, offsets in K.slices(texts, DRIVER_SLICE)]
    return np.concatenate([*rows, np.zeros((lexica.evidence.shape[1], 0, 1 + 2 * len(LEVELS)), np.float32)], axis=1)


def train(texts: pa.Array, toxic: np.ndarray, part: np.ndarray, unlabelled: np.ndarray | None = None, most: float = PRIOR) -> ToxicityModel:
    """toxic is 1 for confirmed rows, unlabelled marks the rows of the unlabelled sample (every row if not given).

    Each bit of part halves the rows in one way. A half's lexicon describes the other half to the network of that way.
    Without positives every score is low.
    """
    positive = toxic == 1
    free = np.ones(len(positive), bool) if unlabelled is None else unlabelled
    halves = [(part >> way & 1) == 1 for way in range(WAYS)]
    lexica = Lexica([build_lexicon(texts, positive, free, use) for half in halves for use in (half, ~half)])
    every = _evidence(texts, lexica)
    said = [np.where(half[:, None], every[2 * k + 1], every[2 * k]) for k, half in enumerate(halves)]
    prior = float(np.mean([class_prior(x[:, 0], positive, free, most) for x in said]))
    networks = []
    for k, x in enumerate(said):
        net = Network(x.shape[1], hidden=8, seed=5 + k)
        if positive.any():
            fit_nnpu(net, x, positive, prior, unlabelled=free)
        else:
            net.w[2] *= 0
            net.w[3] = np.array([-6.0])
        networks.append(net)
    return ToxicityModel(lexica, networks, prior)


def sampled(docs: DataFrame, labels: DataFrame, rows: int, positives: int) -> pa.Table:
    """text, toxic (1 if confirmed), unlabelled, part of two samples outside the held-out remainder 2, in order of id.

    About `rows` documents are drawn whatever their label, and about `positives` of the confirmed toxic ones; one that is in
    both samples has a row of each. part is 0 to 2 ** WAYS - 1. The few confirmed ids are broadcast, so that texts aren't shuffled.
    """
    texts = spread(docs, "doc_id", "text").where(~held_out())
    known = spread(labels, "doc_id", "toxic").where((F.col("toxic") == 1) & ~held_out()).select("doc_id").distinct()

    def drawn(frame: DataFrame, most: int, salt: str):
        n = frame.count()
        return F.lit(True) if n <= most else F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(1 << 20)) < int((1 << 20) * most / n)

    confirmed = texts.join(F.broadcast(known.where(drawn(known, positives, "toxic"))), "doc_id").select("doc_id", "text", F.lit(1).alias("toxic"), F.lit(False).alias("unlabelled"))
    free = texts.where(drawn(texts, rows, "unlabelled")).select("doc_id", "text", F.lit(0).alias("toxic"), F.lit(True).alias("unlabelled"))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(1 << WAYS)).cast("int").alias("part")
    return fetched(free.union(confirmed).select("doc_id", text_of().alias("text"), "toxic", "unlabelled", part)).sort_by([("doc_id", "ascending"), ("text", "ascending"), ("toxic", "ascending")])


def toxicity_model(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, positives: int = POSITIVE_ROWS, most: float = PRIOR) -> ToxicityModel:
    """A model from docs(doc_id, text) and the confirmed ones among labels(doc_id, toxic); labels of 0 serve for nothing.

    Null labels and ids are no labels; an id with several rows counts with each of its texts; null text is empty. Without
    rows or without confirmed ones every score is low.
    """
    sample = sampled(docs, labels, rows, positives)
    free = sample.column("unlabelled").to_numpy().astype(bool)
    model = train(sample.column("text"), sample.column("toxic").to_numpy(), sample.column("part").to_numpy(), free, most)
    del sample
    give_back()
    return model


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_documents over the whole texts of documents; nulls, ties and odd rows as stated there."""
    docs = documents(spark, sf_dir)
    return score_documents(spread(docs, "doc_id", "text"), toxicity_model(docs, table(spark, sf_dir, "labels")), THRESHOLD)
