"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

All documents of a source are expected equally often: rate = target / source size. The prefix sum of expected copies
is then rate * rank, and a document is emitted once for each integer that rate * rank + offset passes over it. Ranks
follow the document's size, so that each part of the size range is drawn at its rate and the words come near target.
Ranks are places in one order of all rows by source and size, dealt by ranges, so no source, and no crowd of rows of one
size, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import documents, spread, written
from quillmark.llm.ordering import numbered

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Parts in which a source's rows meet its target.
DEALS = 64
WORD = r"[^\x20\x09-\x0D]+"


def _fraction(text: Column) -> Column:
    """The first 32 bits of the text's MD5 as a number from 0 to under 1."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(skey, source, size) -> one row per source: skey, source_size, target.

    The budget is share * all sizes. Sources in code point order (null last) have the weights in turn; a source's
    target stops at most * its size and the excess goes to the others by weight. With sources in order of
    most * size / weight, those that stop are the first few; the rest share what is left by weight.
    """
    sums = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighed = sums.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("skey").asc())
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.lit(share) * F.sum("source_size").over(every) - before) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighed.withColumn("level", level).withColumn("stops", F.col("level") >= F.col("cap") / F.col("w"))
    rest = F.max(F.when(~F.col("stops"), F.col("level"))).over(every)
    return leveled.select("skey", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(rest * F.col("w")).alias("target"))


def draw(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, salts: int = 16) -> DataFrame:
    """sized(doc_id, source, size, tie) -> doc_id, source, size, source_size, target, copies: how often the mix holds each row.

    tie is a number that differs from row to row; it decides between rows that share all else.
    """
    sized = sized.withColumn("skey", F.coalesce(F.concat(F.lit("s:"), "source"), F.lit("null")))
    goals = targets(sized, weights, share, most)
    bits = F.length(F.bin("size"))
    band = F.when(F.col("size") < 32, F.col("size")).otherwise(bits * 16 + F.expr("shiftright(size, length(bin(size)) - 5)") - 16)
    salt = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 4), 16, 10).cast("long") % salts
    sized = sized.withColumn("band", band).withColumn("salt", salt)
    placed = numbered(sized, [F.col(c).asc() for c in ("skey", "band", "salt", "size", "doc_id", "tie")], "mix-placed")
    starts = placed.groupBy("skey").agg(F.min("place").alias("start"))
    goals = goals.join(starts, "skey").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))  # a row for each part of a source
    ranked = placed.withColumn("deal", F.pmod(F.xxhash64("tie"), F.lit(DEALS)).cast("int")).join(goals, ["skey", "deal"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _fraction(F.concat(F.lit(f"{seed}/"), F.col("skey")))
    rank = F.col("place") - F.col("start") + 1
    ranked = ranked.withColumn("rate", rate).withColumn("offset", offset).withColumn("rank", rank)
    passed = F.floor(F.col("rate") * F.col("rank") + F.col("offset")) - F.floor(F.col("rate") * (F.col("rank") - 1) + F.col("offset"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", passed.cast("long").alias("copies"))


def word_sizes(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    sized = spread(docs, "doc_id", "source", "text").select("doc_id", "source", size, F.monotonically_increasing_id().alias("tie"))
    return written(sized, "mix-sizes")


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    Null text has size 0; a null source is a source of its own, last in order. Rows of equal size, and rows that repeat,
    each count as a row. An empty table, or one without words, takes nothing.
    """
    return draw(word_sizes(docs), **how).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is drawn, with the columns of docs.

    Rows that share a doc_id and a source are drawn together, as one unit of their joint size.
    """
    units = word_sizes(docs).groupBy("doc_id", "source").agg(F.sum("size").alias("size"), F.min("tie").alias("tie"))
    drawn = draw(units, **how).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.expr("sequence(1, cast(copies as int))").alias("_copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & F.col("row.source").eqNullSafe(F.col("_source"))
    joined = rows.join(drawn, same).select("row", F.explode("_copies"))
    return joined.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_sources over all documents; nulls, ties and odd rows as stated there."""
    return mix_sources(documents(spark, sf_dir))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s:' || source, 'null') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), banded AS (
  SELECT *, CASE WHEN size < 32 THEN size ELSE length(bin(size)) * 16 + (size >> (length(bin(size)) - 5)) - 16 END AS band,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::BIGINT % 16 AS salt
  FROM sized
), sums AS (
  SELECT skey, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY skey, source
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sums
), goals AS (
  SELECT skey, source_size, CASE WHEN level >= cap / w THEN cap
         ELSE max(CASE WHEN level < cap / w THEN level END) OVER () * w END AS target
  FROM levels
), ranked AS (
  SELECT b.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1/' || skey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift,
         row_number() OVER (PARTITION BY skey ORDER BY band, salt, size, doc_id) AS rank
  FROM banded b JOIN goals USING (skey)
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate * rank + shift) - floor(rate * (rank - 1) + shift)))::BIGINT AS taken
FROM ranked
"""
