"""Places of rows in a total order of any size, and CRC-32 in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import written


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with place, a long: 0 for the first row by order, then 1 and so on; written as a table of the name.

    Rows are dealt by ranges and sorted in their parts; a part's start is the sum of the parts before it (a row for each
    part, as many as the shuffle has). Rows that tie in every column of order follow each other in any order: an order
    that ends in a column of different values keeps them from meeting in one part. df is read twice, for the ranges.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = written(dealt, name)
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    placed = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")  # as many rows as the shuffle has parts
    return placed.withColumn("place", F.col("_start") + at).drop("_part", "_start", "_id")


#: A DuckDB expression for the unsigned CRC-32 of a text's UTF-8 bytes.
CRC32 = """xor(list_reduce(list_transform(range(0, length(hex({text})) // 2), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT),
  lambda c, b: list_reduce(range(0, 8), lambda k, j: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384::BIGINT) ELSE k >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""
