"""Corpora whose columns are called as the operators' own columns are."""

import pytest
from pyspark.sql import functions as F

from quillmark.llm import decontaminate as D

ITEM = "one two three four five six seven eight nine ten eleven"
OWN = {"items": "string", "n_words": "int", "_hit": "int", "spans": "string", "key": "string", "row": "string", "_c0": "string", "K": "long"}


@pytest.fixture(scope="module")
def docs(spark):
    texts = [ITEM, f"x {ITEM} y", "clean text", None, "", f"x {ITEM} y", "word " * 200_000 + ITEM]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("7").cast(t) for c, t in OWN.items()})
    return df.select("items", "doc_id", *[c for c in df.columns if c not in ("items", "doc_id", "text")], "text")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("b1", ITEM), ("b2", "another item of no use to any of these texts at all"), ("b3", "a third one that is here so that there are several blocks")], "item_id string, text string")


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 40])
def test_decontaminated_rows_are_as_they_were(docs, bench, block):
    out = D.decontaminate(docs, bench, block_bytes=block)
    assert out.dtypes == docs.dtypes and sorted(map(str, out.collect())) == sorted(map(str, docs.where("doc_id IN (2, 3, 4)").collect()))
    twice = docs.unionByName(docs)
    assert D.decontaminate(twice, bench, block_bytes=block).count() == 6 and D.decontaminate(docs.limit(0), bench, block_bytes=block).count() == 0


def test_empty_benchmark(docs, bench):
    assert D.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_cut_rows_keep_their_columns(docs, bench):
    rows = {r["doc_id"]: r for r in D.cut_spans(docs, bench).collect()}
    assert {i: rows[i]["text"] for i in range(6)} == {0: "", 1: "x  y", 2: "clean text", 3: None, 4: "", 5: "x  y"}
    assert rows[6]["text"] == "word " * 200_000 and {str({c: r[c] for c in OWN}) for r in rows.values()} == {str({c: docs.first()[c] for c in OWN})}
    assert D.cut_spans(docs, bench).columns == docs.columns


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 40])
def test_hits_over_blocks(docs, bench, block):
    got = {r["doc_id"]: (r["items"], r["spans"]) for r in D.find_hits(docs, bench, block_bytes=block).collect()}
    assert got[1] == (["b1"], [[1, 12]]) and got[3] == ([], []) and got[6] == (["b1"], [[200_000, 200_011]])


def test_pipeline_stages_keep_odd_columns(spark, docs, tmp_path):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumns({c: F.lit("7").cast(t) for c, t in OWN.items()} | {c: F.lit("z") for c in ("node", "digest", "score", "copies", "rate", "sig")})
    now = base
    for _, stage in P.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == base.columns and {r["items"] for r in now.select("items").distinct().collect()} <= {"7"}
    assert P.STAGES[-1][1](spark, now, sf).count() == now.count()
