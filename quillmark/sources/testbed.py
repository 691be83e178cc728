"""Records, sessions and observations derived from the driver's tables by fixed rules, and the same rules as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.authorship import author
from quillmark.functions.text import token_text
from quillmark.operators.postings import OPTIONS, TERM_OPTIONS, TextIndex, postings, terms
from quillmark.workspace import stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: dates follow from the id and some are null; labels give the tags of a model."""
    labels = read(spark, sf_dir, "labels")
    llm = F.array(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "toxic").otherwise("civil"))
    docs = read(spark, sf_dir, "documents").join(labels.select("doc_id", llm.alias("llm_tags")), "doc_id", "left")
    start = F.lit("2024-01-01").cast("timestamp")
    created = F.when(F.col("doc_id") % 11 != 0, F.timestamp_add("HOUR", F.col("doc_id").cast("int"), start))
    updated = F.when(F.col("doc_id") % 13 != 0, F.timestamp_add("HOUR", (F.col("doc_id") + 24 * (F.col("doc_id") % 5)).cast("int"), start))
    return docs.select(
        F.concat(F.lit("doc:"), "doc_id").alias("stable_id"), "source", F.substring("text", 1, 80).alias("subject"), F.col("text").alias("body"),
        F.array("lang", "source").alias("tags"), "llm_tags", created.alias("created_at"), updated.alias("updated_at"),
        F.sha2("text", 256).alias("src_hash"), F.when(F.col("llm_tags").isNotNull() & (F.col("doc_id") % 3 != 0), F.sha2("text", 256)).alias("llm_tags_src_hash"), "doc_id",
    )


def record_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without what is made of their texts, so that a scan leaves the texts out."""
    return records(spark, sf_dir).drop("subject", "body", "src_hash", "llm_tags_src_hash")


def observations(spark: SparkSession, sf_dir: str, classified: bool = True) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    c = F.col("conv_id")
    sid, child = F.concat(F.lit("s"), c), c % 5 == 4
    body, kind = F.col("text"), F.when(child, "subagent").otherwise("session")
    ts = F.timestamp_add("MINUTE", (c * 60 + F.col("turn")).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return turns.select(
        F.concat(c.cast("string"), F.lit(":"), "turn").alias("obs_id"), sid.alias("session_id"), F.when(child, F.concat(F.lit("s"), (c - 4).cast("string"))).otherwise(sid).alias("root_session_id"),
        F.col("role").alias("type"), ts.alias("ts"), body.alias("body"), kind.alias("kind"), "conv_id",
        (author(F.col("role"), body, kind) if classified else F.lit(None).cast("string")).alias("provenance"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    spans = observations(spark, sf_dir).groupBy("session_id", "root_session_id", "kind", "conv_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    child = F.col("kind") == "subagent"
    return spans.select(
        "session_id", "root_session_id", F.when(child, F.col("root_session_id")).alias("parent_session_id"), "kind",
        F.when(child, F.concat(F.lit("a"), c)).alias("agent_id"), F.when(child, F.when(c % 2 == 1, "explore").otherwise("general")).alias("agent_type"),
        F.concat(F.lit("/work/p"), c % 7).alias("cwd"), F.when(c % 4 != 0, F.concat(F.lit("b"), c % 3)).alias("git_branch"), "first_ts", "last_ts",
        F.when(c % 3 == 0, "claude-code").when(c % 3 == 1, "chatgpt").otherwise("claude-web").alias("origin"),
        F.when(c % 6 == 0, F.concat(F.lit("/t/s"), c, F.lit(".jsonl"))).alias("jsonl_path"), "conv_id",
    )


_INDEXES: dict[tuple, TextIndex] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files at path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(place)))


def text_index(spark: SparkSession, sf_dir: str, table: str, stem: bool = False) -> TextIndex:
    """The stored index of records or observations: written once a session and version of the files, as an ingest would, and read by each query after."""
    name = (spark.sparkContext.applicationId, sf_dir, table, stem, _stamp(spark, f"{sf_dir}/{'documents' if table == 'records' else 'conversations'}.parquet"))
    if name not in _INDEXES:
        if table == "records":
            rows, key, carry = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("stable_id"), F.col("text").alias("body")), "stable_id", ()
        else:
            rows, key, carry = observations(spark, sf_dir, classified=False).select("obs_id", "session_id", "root_session_id", "body"), "obs_id", ("session_id", "root_session_id")
        every = stored(postings(rows, key, F.col("body"), carry, stem), f"index-{table}", **OPTIONS)
        _INDEXES[name] = TextIndex(every, key, carry, ((every, stored(terms(every), f"terms-{table}", **TERM_OPTIONS)),))
    return _INDEXES[name]


def indexed(df: DataFrame, *columns: str) -> DataFrame:
    """With the unstemmed index column over the named texts."""
    return df.withColumn("terms", token_text(F.concat_ws(" ", *columns)))


def _terms(text: str) -> str:
    return rf"' ' || trim(regexp_replace(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


_BODY = "coalesce(text, '')"
_CLASSIFY = f"""CASE WHEN role IN ('assistant', 'tool_use') THEN 'agent' WHEN role = 'hook' THEN 'hook' WHEN role IS NULL OR role <> 'user' THEN 'system'
  WHEN conv_id % 5 = 4 THEN 'agent' WHEN contains({_BODY}, '<task-notification>') THEN 'agent'
  WHEN contains({_BODY}, '<command-name>') OR contains({_BODY}, '<local-command-stdout>') OR contains({_BODY}, '<local-command-caveat>') THEN 'command'
  WHEN contains({_BODY}, 'You are a classifier') THEN 'hook' WHEN contains({_BODY}, '<system-reminder>') THEN 'system'
  WHEN starts_with(ltrim({_BODY}), 'API Error') THEN 'system' ELSE 'human' END"""

#: Tables rec, obs and ses for oracles.
CTES = rf"""
rec AS (
  SELECT 'doc:' || d.doc_id AS stable_id, d.source, substr(text, 1, 80) AS subject, text AS body, [lang, d.source] AS tags,
         CASE WHEN l.doc_id IS NOT NULL THEN [CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'civil' END] END AS llm_tags,
         CASE WHEN d.doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(d.doc_id) END AS created_at,
         CASE WHEN d.doc_id % 13 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(d.doc_id + 24 * (d.doc_id % 5)) END AS updated_at,
         sha256(text) AS src_hash, CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 3 <> 0 THEN sha256(text) END AS llm_tags_src_hash,
         d.doc_id, {_terms("text")} AS terms
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), obs AS (
  SELECT conv_id || ':' || turn AS obs_id, 's' || conv_id AS session_id, 's' || CASE WHEN conv_id % 5 = 4 THEN conv_id - 4 ELSE conv_id END AS root_session_id,
         role AS type, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn) AS ts, text AS body,
         CASE WHEN conv_id % 5 = 4 THEN 'subagent' ELSE 'session' END AS kind, conv_id, {_CLASSIFY} AS provenance, {_terms("text")} AS terms
  FROM conversations
), ses AS (
  SELECT session_id, root_session_id, CASE WHEN kind = 'subagent' THEN root_session_id END AS parent_session_id, kind,
         CASE WHEN kind = 'subagent' THEN 'a' || conv_id END AS agent_id, CASE WHEN kind = 'subagent' THEN CASE WHEN conv_id % 2 = 1 THEN 'explore' ELSE 'general' END END AS agent_type,
         '/work/p' || (conv_id % 7) AS cwd, CASE WHEN conv_id % 4 <> 0 THEN 'b' || (conv_id % 3) END AS git_branch, min(ts) AS first_ts, max(ts) AS last_ts,
         CASE conv_id % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'chatgpt' ELSE 'claude-web' END AS origin, CASE WHEN conv_id % 6 = 0 THEN '/t/s' || conv_id || '.jsonl' END AS jsonl_path, conv_id
  FROM obs GROUP BY session_id, root_session_id, kind, conv_id
)
"""
