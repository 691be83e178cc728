"""Retrieval metrics over frames ranked(query, id, rank) and grades(query, id, grade), and over two ranked lists.

A query without a positive grade isn't scored: it has no row, as no labels isn't a score of zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P, DEPTH = 0.9, 10


def _positive(grades: DataFrame) -> DataFrame:
    return grades.where("grade > 0").groupBy("query", "id").agg(F.max("grade").alias("grade"))


def _hits(ranked: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.col("rank") <= k).join(_positive(grades), ["query", "id"])


def ndcg(ranked: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """Linear gain over log2(rank + 1)."""
    gain = lambda rank: F.sum(F.col("grade") / F.log2(F.col(rank) + 1))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade")))
    ideal = _positive(grades).withColumn("place", best).where(F.col("place") <= k).groupBy("query").agg(gain("place").alias("ideal"))
    got = _hits(ranked, grades, k).groupBy("query").agg(gain("rank").alias("got"))
    return ideal.join(got, "query", "left").select("query", (F.coalesce("got", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def recall(ranked: DataFrame, grades: DataFrame, k: int = 50) -> DataFrame:
    total = _positive(grades).groupBy("query").agg(F.count("*").alias("total"))
    found = _hits(ranked, grades, k).groupBy("query").agg(F.countDistinct("id").alias("found"))
    return total.join(found, "query", "left").select("query", (F.coalesce("found", F.lit(0)) / F.col("total")).alias("recall"))


def mrr(ranked: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    labelled = _positive(grades).select("query").distinct()
    first = _hits(ranked, grades, k).groupBy("query").agg(F.min("rank").alias("first"))
    return labelled.join(first, "query", "left").select("query", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def overlap(before: Column, after: Column, k: int = DEPTH) -> Column:
    b, a = F.slice(before, 1, k), F.slice(after, 1, k)
    longest = F.greatest(F.size(b), F.size(a))
    return F.when(longest == 0, 1.0).otherwise(F.size(F.array_intersect(b, a)) / longest)


def rbo(before: Column, after: Column, p: float = P, depth: int = DEPTH) -> Column:
    """Rank-biased overlap over the depth used, by the weight used, so that equal lists score 1."""
    b, a = F.slice(before, 1, depth), F.slice(after, 1, depth)
    d = F.greatest(F.size(b), F.size(a))
    agree = lambda i: F.size(F.array_intersect(F.slice(b, F.lit(1), i), F.slice(a, F.lit(1), i))) / i
    places = F.sequence(F.lit(1), F.greatest(d, F.lit(1)))
    total = lambda f: F.aggregate(places, F.lit(0.0), lambda acc, i: acc + f(i))
    weight = lambda i: F.pow(F.lit(p), i - 1)
    return F.when(d == 0, 1.0).otherwise(total(lambda i: weight(i) * agree(i)) / total(weight))


def drift(before: Column, after: Column, p: float = P, depth: int = DEPTH) -> Column:
    return 1.0 - rbo(before, after, p, depth)


def top1_changed(before: Column, after: Column) -> Column:
    return ~F.get(before, F.lit(0)).eqNullSafe(F.get(after, F.lit(0)))


def suggestions(misses: DataFrame, frozen: DataFrame) -> DataFrame:
    """Missed queries that aren't frozen yet, with when each was first seen."""
    return misses.join(frozen, "query", "left_anti").groupBy("query").agg(F.min("id").alias("first_seen"))
