"""Retrieval regression: freeze rankings of golden queries, run them again, and tell what moved."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.evals import metrics

KINDS = ("identifier", "natural", "negative")
FROZEN, FETCHED = 10, 50


@dataclass(frozen=True)
class GoldenQuery:
    id: str
    query: str
    kind: str
    origin: str
    tags: tuple[str, ...] = ()
    note: str = ""


def load_golden(text: str) -> list[GoldenQuery]:
    """Queries of a golden set; a missing field, an unknown kind or an id used twice is an error."""
    found = [GoldenQuery(q["id"], q["query"], q["kind"], q["origin"], tuple(q.get("tags", ())), q.get("note", "")) for q in json.loads(text)["queries"]]
    if bad := [q.id for q in found if q.kind not in KINDS]:
        raise ValueError(f"unknown kinds at {bad}")
    if len({q.id for q in found}) < len(found):
        raise ValueError("an id is used twice")
    return found


def run_queries(spark: SparkSession, golden: list[GoldenQuery], search: Callable[[str, int], list[str]], k: int = FETCHED) -> DataFrame:
    """query, kind, ids: what search returns now for each golden query."""
    rows = [(q.id, q.kind, search(q.query, k)) for q in golden]
    return spark.createDataFrame(rows, "query string, kind string, ids array<string>")


def freeze(now: DataFrame) -> DataFrame:
    """Baseline rows query, id, rank of the first ids; a negative query must have none."""
    if noisy := [r[0] for r in now.where("kind = 'negative' AND size(ids) > 0").select("query").collect()]:
        raise ValueError(f"negative queries with results: {noisy}")
    return now.select("query", F.posexplode(F.slice("ids", 1, FROZEN)).alias("at", "id")).select("query", "id", (F.col("at") + 1).alias("rank"))


def compare(now: DataFrame, frozen: DataFrame, grades: DataFrame | None = None) -> DataFrame:
    """Per query: drift, overlap, whether the first result changed, and labelled metrics where there are labels (else null)."""
    order = Window.partitionBy("query").orderBy("rank")
    lists = frozen.withColumn("n", F.row_number().over(order)).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("before"))
    joined = now.join(lists, "query", "left").withColumn("before", F.coalesce("before", F.array().cast("array<string>")))
    out = joined.select(
        "query", "kind", metrics.drift(F.col("before"), F.col("ids")).alias("drift"), metrics.overlap(F.col("before"), F.col("ids")).alias("overlap"),
        metrics.top1_changed(F.col("before"), F.col("ids")).alias("top1_changed"), ((F.col("kind") == "negative") & (F.size("ids") > 0)).alias("broke_silence"),
    )
    if grades is not None:
        ranked = now.select("query", F.posexplode("ids").alias("at", "id")).select("query", "id", (F.col("at") + 1).alias("rank"))
        for scored in (metrics.ndcg(ranked, grades), metrics.recall(ranked, grades), metrics.mrr(ranked, grades)):
            out = out.join(scored, "query", "left")
    return out


def report(rows: DataFrame) -> str:
    """One line a query; a metric without labels is a dash."""
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join("  ".join(f"{k}={show(v)}" for k, v in r.asDict().items()) for r in rows.orderBy("query").collect())
