"""Exact deduplication that no hot text can skew.

Texts are read once. Each task first combines equal texts of some MB of its own rows and keeps their ids beside the
text; then salted groups of equal texts meet; then the winners of a text's salts. Rows merge only where their full texts
are equal: the text is part of every grouping key, beside its digest. Ids go back by digest, which the groups have shown
to stand for one text only, and by salt; where a digest stood for several texts, ids go back by the text itself.

A text that is in every chunk meets itself in groups of about the square root of the chunks, as many as there are salts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import discard, documents, spread, text_of, tidied, written

#: Fewest salts; a corpus of many chunks has as many as the square root of their number.
SALTS = 16
#: Bytes of different texts, and rows, that a task combines at once.
LOCAL_BYTES, LOCAL_ROWS = 16 << 20, 100_000


def combined(base: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """sha, digest, body, chunk, top, n, ids of base(doc_id, body): equal texts of a chunk are one row.

    ids are in falling order, null last; top is the first of them. A chunk has a number of its own.
    """
    kind = base.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: dict[bytes, list] = {}
        size = rows = 0
        names = ["sha", "digest", "body", "chunk", "top", "n", "ids"]
        id_type = None

        def flush() -> pa.RecordBatch:
            shas = [hashlib.sha256(b).digest() for b in held]
            ids = [sorted((x for x in own if x is not None), reverse=True) + [None] * own.count(None) for own in held.values()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(shas, pa.binary()), pa.array([x[:digest_bytes] for x in shas], pa.binary()), pa.array(list(held), pa.binary()), pa.array([chunk] * len(held), pa.int64()),
                    pa.array([x[0] for x in ids], id_type), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(id_type)),
                ],
                names,
            )

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                body = body.as_py()
                if (own := held.get(body)) is None:
                    own = held[body] = []
                    size += len(body)
                own.append(doc_id)
                rows += 1
                if size >= LOCAL_BYTES or rows >= LOCAL_ROWS:
                    yield flush()
                    held, size, rows, chunk = {}, 0, 0, chunk + 1
        if held:
            yield flush()

    return base.mapInArrow(tidied(scan), f"sha binary, digest binary, body binary, chunk long, top {kind}, n long, ids array<{kind}>")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest_bytes: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the largest id stays; a null id is below all others. Rows
    that repeat both id and text are told apart by no column, so exactly one of them is kept. Ids may be numbers or
    strings. An empty table gives no rows; further columns are ignored. A text must fit a task's memory a few times.
    """
    base = spread(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("body"))
    local = written(combined(base, digest_bytes), "exact-local")
    salts = max(salts, math.isqrt(local.select("chunk").distinct().count()))
    local = local.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)))  # a chunk's number alone is 0 in each task's first
    top = F.max(F.struct(F.col("top").isNotNull().alias("known"), "top", "chunk"))
    salted = local.groupBy("digest", "salt", "body").agg(top.alias("best"), F.sum("n").alias("n"))
    salted = written(salted, "exact-salted")
    again = salted.groupBy("digest").agg(F.count("*").alias("times")).where("times > 1").select("digest")
    once = salted.join(again, "digest", "left_anti").select("digest", "salt", "best", "n")
    merged = salted.join(again, "digest", "left_semi").groupBy("digest", "body").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    merged = written(merged, "exact-merged")
    twins = merged.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    none = twins.isEmpty()
    winners = (merged if none else merged.join(twins, "digest", "left_anti")).select("digest", "best", "n")
    clear = once.union(salted.select("digest", "salt").join(winners, "digest").select("digest", "salt", "best", "n"))
    clear = written(clear.select("digest", "salt", F.col("best.top").alias("keep_id"), F.col("best.chunk").alias("stays"), F.col("n").alias("group_size")), "exact-winners")
    discard(salted)
    found = local.select("digest", "salt", "sha", "chunk", "ids").join(clear, ["digest", "salt"])
    columns = ("sha", "chunk", "ids", "keep_id", "stays", "group_size")
    if none:
        discard(merged)
    else:  # a digest of several texts: by the texts
        split = merged.join(twins, "digest", "left_semi").select("digest", "body", F.col("best.top").alias("keep_id"), F.col("best.chunk").alias("stays"), F.col("n").alias("group_size"))
        found = found.select(*columns).union(local.join(split, ["digest", "body"]).select(*columns))
    rows = found.select(*columns, F.posexplode("ids").alias("at", "doc_id"))
    kept = (F.col("chunk") == F.col("stays")) & (F.col("at") == 0)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup over the whole texts of documents; nulls, ties and odd rows as stated there."""
    return exact_dedup(documents(spark, sf_dir))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
