"""Target-distribution importance resampling: hashed n-gram gains, summed by document, drawn with Gumbel noise.

Words of a document are posexploded with their places; lead() over the document concatenates the words that follow, once
for each order; a feature's CRC-32 gives its bucket. Documents are dealt by row first, so that the explode, the window
and its sort stay in the same partitions: texts are shuffled once and words never. Buckets of all words are written once
and read twice: for the counts, whose groups are as few as the buckets, and for the join with their gains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import discard, documents, keyed, spread, table, written
from quillmark.llm.ordering import CRC32, numbered

ORDERS, BUCKETS = 2, 10_000
#: Words that a document must have to be drawn, and the percentage of those documents that is.
LEAST_WORDS, PERCENT = 20, 25
SEED = "7"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def feature_buckets(rows: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """rows(key, text) -> a row for each word: key, and the buckets b1, b2 .. of the features that begin there, null past the end."""
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    placed = rows.select("key", "text").repartition("key").select("key", F.posexplode(words).alias("pos", "word"))
    after = Window.partitionBy("key").orderBy("pos")
    gram, out = F.col("word"), []
    for k in range(1, orders + 1):
        out.append(F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int").alias(f"b{k}"))
        gram = F.concat(gram, F.lit(" "), F.lead("word", k).over(after))  # null where a following word is missing
    return placed.select("key", *out)


def _features(grams: DataFrame) -> DataFrame:
    """key, bucket of each feature."""
    found = F.array_compact(F.array(*[F.col(c) for c in grams.columns if c != "key"]))
    return grams.select("key", F.explode(found).alias("bucket"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket: the floored logarithm, in thousandths, of how much likelier the target's features hold it.

    corpus and target are feature_buckets. Counts are by bucket, so the result has that many rows, whatever the input.
    """
    count = lambda grams, name: _features(grams).groupBy("bucket").agg(F.count("*").alias(name))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(count(corpus, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    whole = Window.partitionBy()  # over one row a bucket
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * (F.sum(s).over(whole) + buckets)) / ((s + 1) * (F.sum(t).over(whole) + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def _noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, by the id and the seed alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """key, doc_id, n_words, n_features, weight, score of each row of docs(doc_id, text, ..), against target(text, ..).

    Null and wordless texts have no feature and weight 0. A null id takes its noise from the empty id. Rows that repeat,
    or share an id, are scored each. A text's words must fit a task's memory as one array.
    """
    rows = keyed(spread(docs, "doc_id", "text"))
    aims = keyed(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text")), by_id=False)
    grams = written(feature_buckets(rows, orders, buckets), "importance-grams")
    wanted = written(feature_buckets(aims, orders, buckets), "importance-target")
    gain = F.broadcast(gains(grams, wanted, buckets))  # buckets rows, a parameter
    sums = _features(grams).join(gain, "bucket").groupBy("key").agg(F.count("*").alias("n_features"), F.sum("gain").alias("total"))
    words = grams.groupBy("key").agg(F.count("*").alias("n_words"))
    scored = rows.select("key", "doc_id").join(sums.join(words, "key"), "key", "left").fillna(0, ["n_features", "n_words", "total"])
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("total") / F.col("n_features"))).otherwise(F.lit(0)).cast("long")
    out = written(scored.select("key", "doc_id", "n_words", "n_features", weight.alias("weight"), (weight + _noise(F.col("doc_id"), seed)).cast("long").alias("score")), "importance-scored")
    discard(grams)
    discard(wanted)
    return out


def importance_sample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, **how) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs; rank is null where the row isn't drawn.

    Of the N rows with at least least_words words the floor(percent * N / 100) highest scores are drawn, ties to the smaller
    id, a null id last; rows that share score and id are drawn in any order. An empty docs gives no rows; with an empty
    target every feature of the corpus has a negative or zero gain by its own count. Ranks come from a distributed sort.
    """
    scored = weighed(docs, target, **how)
    able = numbered(scored.where(F.col("n_words") >= least_words), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key")], "importance-ranked")
    most = able.agg(F.floor(F.lit(percent) * F.count("*") / F.lit(100)).alias("n")).first()["n"]
    rank = F.when(F.col("place") < most, F.col("place") + 1).cast("long")
    names = ("doc_id", "n_features", "weight", "score")
    rest = scored.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank"))
    return able.select(*names, rank.alias("rank")).union(rest)


def resampled_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of docs, with their columns. Rows that share a doc_id stay or go together, by the best of them; null ids are never drawn here."""
    drawn = importance_sample(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(drawn, F.col("row.doc_id") == F.col("_id"), "left_semi")
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """importance_sample of all documents towards all benchmark texts; nulls, ties and odd rows as stated there."""
    return importance_sample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH words AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
features AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM words),
aims AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM (SELECT {_WORDS} AS ws FROM benchmark)),
names AS (SELECT f, {CRC32.format(text="f")} % 10000 AS bucket FROM (SELECT f FROM features UNION SELECT f FROM aims)),
s AS (SELECT bucket, count(*) AS s FROM features JOIN names USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN names USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s)::DOUBLE + 10000) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT doc_id, floor(sum(gain) / count(*)) AS mean FROM features JOIN names USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, greatest(2 * len(ws) - 1, 0)::BIGINT AS n_features, coalesce(mean, 0)::BIGINT AS weight,
         (coalesce(mean, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM words LEFT JOIN sums USING (doc_id)
), able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored LEFT JOIN able USING (doc_id)
"""
