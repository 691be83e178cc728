import functools
import os
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillmark.llm import decontaminate, mixing, quality, toxicity
from quillmark.llm.common import written
from quillmark.llm.registry import ORACLES, QUERIES
from quillmark.llm.token_output import default_tokenizer
from tests.conftest import SF, rows_of
from tests.llm import brute

#: Held-out quality needs more than a few labels.
LARGER = os.environ.get("TEST_LARGER_SF_DIR", "/root/testdata/sf0.1")


def labelled(n=900, seed=3):
    """Plain texts, some shouting or repeating themselves, some with words of a bad family."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su") for b in ("ra", "to", "vi", "we", "xo")]
    bad = ["grunk" + x for x in ("a", "b", "c", "da", "de")]
    texts, good, toxic = [], [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(3, 80))]
        low, rude = i % 6 == 0, i % 7 == 0
        if rude:
            for _ in range(max(1, len(w) // 15)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        if low:
            w = [x.upper() + "!!" for x in w] if i % 4 or rude else [w[0]] * len(w)
        texts.append(" ".join(w))
        good.append(not low)
        toxic.append(rude)
    return texts, np.array(good, int), np.array(toxic, int)


def test_quality_learns_on_unseen_texts():
    texts, good, _ = labelled()
    part = np.arange(600) % 8 == 0
    model = quality.train(pa.array(texts[:600]), good[:600], part)
    score = model.score(pa.array([*texts[600:], "", None]))
    assert ((score[:-2] >= 0.7) == good[600:]).mean() > 0.95
    assert np.isfinite(score).all() and score.min() >= 0 and score.max() <= 1 and score[-1] == score[-2]
    again = quality.train(pa.array(texts[:600]), good[:600], part)
    assert np.array_equal(again.score(pa.array(texts[600:])), score[:-2])


def test_quality_with_little_to_learn_from():
    model = quality.train(pa.array([], pa.string()), np.zeros(0, int), np.zeros(0, bool))
    assert 0 <= model.score(pa.array(["x"]))[0] <= 1
    one = quality.train(pa.array(["a b"] * 20), np.ones(20, int), np.arange(20) == 0)
    assert one.score(pa.array(["a b"]))[0] > 0.7


def test_temperature_softens_false_certainty():
    net = quality.Network(1)
    net.logits = lambda x: x[:, 0] * 20
    x, y = np.array([[1.0], [1.0], [1.0], [-1.0]] * 50), np.array([1, 1, 0, 0] * 50)
    net.calibrate(x, y)
    assert net.temperature > 4
    net.calibrate(x[:1], y[:1])
    assert 0.5 < net.temperature < 2


def test_toxicity_learns_from_positives_and_the_rest():
    texts, _, toxic = labelled()
    model = toxicity.train(pa.array(texts[:600]), toxic[:600], np.random.default_rng(1).integers(0, 16, 600))
    score = model.score(pa.array([*texts[600:], "", None]))
    found = score[:-2] >= 0.3
    assert found[toxic[600:] == 1].mean() > 0.95 and found[toxic[600:] == 0].mean() < 0.05 and score[-1] < 0.3
    long = " ".join(texts[k] for k in range(600, 900) if not toxic[k])
    assert model.score(pa.array([long]))[0] < 0.3


def test_toxicity_learns_from_texts_without_a_label(spark):
    """Only some toxic texts carry a label, and none that isn't: the rest must serve as unlabelled, at a prior of its own."""
    texts, _, toxic = labelled()
    docs = brute.frame(spark, texts)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 600, 14)], "doc_id long, toxic int")
    model = toxicity.toxicity_model(docs, labels, most=0.5)
    assert 0.08 < model.prior < 0.25
    found = model.score(pa.array(texts[600:])) >= 0.3
    assert found[toxic[600:] == 1].mean() > 0.9 and found[toxic[600:] == 0].mean() < 0.1


def test_toxicity_without_positives():
    model = toxicity.train(pa.array(["a", "b"]), np.zeros(2, int), np.array([0, 15]))
    assert model.score(pa.array(["a", ""])).max() < 0.3
    empty = toxicity.train(pa.array([], pa.string()), np.zeros(0, int), np.zeros(0, int))
    assert empty.score(pa.array(["a"]))[0] < 0.3


def test_nnpu_steps_back_when_the_negative_part_is_below_zero():
    net = quality.Network(1, hidden=2)
    x, p = np.array([[1.0], [1.0], [-1.0]]), np.array([True, True, False])
    toxicity.fit_nnpu(net, x, p, prior=0.9, epochs=20)
    assert np.isfinite(net.score(x)).all()


def auc(score, label):
    """The chance that a random row of label 1 scores above one of label 0; ties count half."""
    rank = pd.Series(score).rank().to_numpy()
    one = label == 1
    return (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


@pytest.mark.parametrize(("name", "label", "least"), [("op5_quality", "quality", (0.98, 0.97, 0.97)), ("op8_toxicity", "toxic", (0.97, 0.9, 0.85))])
def test_model_queries_on_held_out_rows(spark, name, label, least):
    """Area under the curve, precision and recall on labelled rows that no model has seen; a constant answer has 0.5."""
    rows = QUERIES[name](spark, LARGER).toPandas()
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").toPandas()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    both = rows.merge(labels, on="doc_id").query("held_out")
    hit, one = (both.predicted == 1).to_numpy(), (both[label] == 1).to_numpy()
    got = auc(both.score, both[label].to_numpy()), (hit & one).sum() / hit.sum(), (hit & one).sum() / one.sum()
    assert all(x >= y for x, y in zip(got, least, strict=True)), got


@pytest.mark.parametrize(("make", "label"), [(quality.quality_model, "quality"), (toxicity.toxicity_model, "toxic")])
def test_models_of_odd_tables(spark, make, label):
    """Empty tables, repeated rows, equal texts, null ids, labels and texts, ids without labels, clashing columns."""
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (2, None), (None, 1), (99, 1)], f"doc_id long, {label} int")
    docs = brute.frame(spark, ["some text", "OTHER!! TEXT!!", None, "", "some text"]).withColumn("label", F.lit(3)).withColumn("part", F.lit("p"))
    docs = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    for table in (labels, labels.limit(0)):
        for frame in (docs, docs.limit(0)):
            model = make(frame, table)
            scored = quality.score_documents(frame, model, 0.5).toPandas()
            assert len(scored) == frame.count() and scored.score.between(0, 1).all() and not scored.held_out.isna().any()
            assert (scored.predicted == (scored.score >= 0.5)).all()
    by_text = spark.createDataFrame(scored) if len(scored) else None
    assert by_text is None or by_text.count() == 15
    model = make(docs, labels)
    scores = quality.score_documents(docs.where("doc_id IN (0, 4)"), model, 0.5).select("score").distinct()
    assert scores.count() == 1  # equal texts tie
    assert quality.score_documents(docs.where("doc_id IN (2, 3)"), model, 0.5).select("score").distinct().count() == 1


def test_samples_are_bounded_by_bytes(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.repeat(F.lit("x"), F.lit(quality.SAMPLE_TEXT + 1))).otherwise(F.repeat(F.lit("y"), F.lit(1000))).alias("text"))
    assert quality.fetched(docs).num_rows == 399
    assert 20 <= quality.fetched(docs, 100_000).num_rows <= 200


# --- decontamination -------------------------------------------------------------------------------------------------


def plain_hits(texts, items, window):
    grams = {}
    for name, t in items:
        w = [x.decode() for x in decontaminate.words_of((t or "").encode())]
        for g in [tuple(w[k : k + window]) for k in range(len(w) - window + 1)] if len(w) >= window else [tuple(w)] if w else []:
            grams.setdefault(g, set()).add(name)
    out = []
    for t in texts:
        w = [x.decode() for x in decontaminate.words_of((t or "").encode())]
        hit, names = [False] * len(w), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k : k + n])):
                    hit[k : k + n] = [True] * n
                    names |= found
        out.append((len(w), sum(hit), sorted(names)))
    return out


@pytest.mark.parametrize(("window", "block"), [(10, 1 << 20), (3, 1 << 20), (3, 200)])
def test_hits(spark, window, block):
    rng = random.Random(window)
    text = lambda n: " ".join(rng.choice("abcde") + rng.choice(["", "é", "X", ","]) for _ in range(n))
    items = [(str(i), text(rng.choice([0, 1, 2, 5, 12, 30]) + (4 if window == 10 else 2))) for i in range(12)] + [("a", None), ("b", "!!"), ("c", "a b")]
    texts = [None, "", "a, B", *[text(rng.randint(1, 60)) for _ in range(30)], *[f"{text(4)} {t} {text(3)}" for _, t in items[:6]]]
    bench = spark.createDataFrame([(n, t, "x") for n, t in items], "item_id string, text string, n_words string")
    got = {r["doc_id"]: r.asDict() for r in decontaminate.find_hits(brute.frame(spark, texts), bench, window, block).collect()}
    for i, (n, hit, names) in enumerate(plain_hits(texts, items, window)):
        assert (got[i]["n_words"], sum(b - a for a, b in got[i]["spans"]), got[i]["items"]) == (n, hit, names)


def test_cut_and_drop(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = brute.frame(spark, [f"Before it. {item.upper()}! After.", "clean text", None])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(docs, bench).collect()}
    assert cut == {0: "Before it. ! After.", 1: "clean text", 2: None}
    left = decontaminate.decontaminate(docs, bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2] and left.columns == docs.columns
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 3
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


# --- queries and pipeline --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert rows_of(got) == rows_of(want)


def test_pipeline_stages(spark, monkeypatch):
    """Each stage on what its predecessor kept, against a plain version."""
    monkeypatch.setattr(brute, "shingles", functools.partial(brute.shingles, k=5))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, SF), f"test-{name}")
        assert after.columns == docs.columns
        rows, kept = before.collect(), sorted(r["doc_id"] for r in after.collect())
        if name == "quality":
            model = quality.quality_model(before, spark.read.parquet(f"{SF}/labels.parquet"))
            score = model.score(pa.array([r["text"] for r in rows]))
            assert kept == sorted(r["doc_id"] for r, x in zip(rows, score, strict=True) if x >= 0.7)
        elif name == "near_dedup":
            want = brute.near_components([(r["doc_id"], r["text"]) for r in rows])
            assert kept == sorted(i for i, root in want.items() if i == root)
        elif name == "decontaminate":
            items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = [r["doc_id"] for r, h in zip(rows, plain_hits([r["text"] for r in rows], items, 10), strict=True) if not h[1]]
            assert kept == sorted(clean)
        elif name == "mix":
            drawn = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_sources(before).collect() if r["size"]}
            assert kept == sorted(i for i, n in drawn.items() for _ in range(n))
            assert after.distinct().exceptAll(before).count() == 0
        before = after
    library = Tokenizer.from_file(default_tokenizer())
    want, start = [], 0
    for i, text in sorted((r["doc_id"], r["text"] or "") for r in before.collect()):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()) == want


def test_pipeline_of_odd_tables(spark):
    """Empty tables, null texts, ids and sources, repeated ids and rows: each stage gives the columns of documents."""
    good = " ".join(f"plain word number {i} of this text." for i in range(20))
    rows = [(1, good), (1, good), (1, good + " and more"), (2, None), (2, ""), (None, good), (None, None), (3, "xx " * 5000)]
    docs = spark.createDataFrame([(i, t, None, "a" if i == 1 else None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, frame, SF), f"odd-{name}")
            assert name == "tokens" or out.columns == docs.columns
            if name == "near_dedup" and frame is docs:
                assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted([(1, good), (2, ""), (2, ""), (0, ""), (3, "xx " * 5000)])
            if name == "tokens":
                assert out.count() == frame.count()
            if frame is not docs:
                assert out.count() == 0
