import json

import pytest
from pyspark.sql import functions as F

from quillmark.evals import harness
from quillmark.operators import joins, merge


def test_two_task_sources_merge(spark):
    schema = "task_id string, title string, observed_at int, completed_at string, inferred boolean, origin string"
    backup = spark.createDataFrame([("1", "old", 1, "real", False, "csv"), ("2", "only", 1, None, False, "csv")], schema)
    polled = spark.createDataFrame([("1", "new", 2, "guess", True, "api")], schema)
    rows = {r["task_id"]: r.asDict() for r in joins.merge_two_sources(backup, polled).collect()}
    assert rows["1"]["title"] == "new" and rows["1"]["completed_at"] == "real" and not rows["1"]["inferred"] and rows["2"]["title"] == "only"


def test_rebuild_guards(spark):
    stored = spark.range(200).select("id", F.lit("a").alias("source"))
    with pytest.raises(merge.ShrinkError):
        merge.rebuild(stored, stored.limit(10), "source", "a")
    assert merge.rebuild(stored, stored.limit(10), "source", "a", force=True).count() == 10
    with pytest.raises(ValueError):
        merge.rebuild(stored, stored.withColumn("source", F.lit("b")), "source", "a")


GOLDEN = json.dumps({"version": 1, "queries": [{"id": "q1", "query": "x", "kind": "natural", "origin": "t"}, {"id": "q2", "query": "none", "kind": "negative", "origin": "t"}]})


def test_harness(spark):
    golden = harness.load_golden(GOLDEN)
    run = lambda ids: harness.run_queries(spark, golden, lambda q, k: ids if q == "x" else [])
    frozen = harness.freeze(run(["a", "b", "c"]))
    same = {r["query"]: r.asDict() for r in harness.compare(run(["a", "b", "c"]), frozen).collect()}
    assert same["q1"]["drift"] == 0 and same["q2"]["drift"] == 0 and not same["q2"]["broke_silence"]
    grades = spark.createDataFrame([("q1", "b", 1)], "query string, id string, grade int")
    moved = {r["query"]: r.asDict() for r in harness.compare(run(["b", "a"]), frozen, grades).collect()}
    assert moved["q1"]["drift"] > 0 and moved["q1"]["top1_changed"] and moved["q1"]["mrr"] == 1 and moved["q2"]["ndcg"] is None
    assert "ndcg=-" in harness.report(harness.compare(run(["b"]), frozen, grades))
    with pytest.raises(ValueError):
        harness.freeze(harness.run_queries(spark, golden, lambda q, k: ["z"]))
    with pytest.raises(ValueError):
        harness.load_golden(GOLDEN.replace("natural", "odd"))
