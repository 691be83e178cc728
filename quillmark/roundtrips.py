"""Queries that write the driver's tables in the formats of the sources and read them back by the sources' own parsers.

Each has SQL over the tables themselves, so a parser that loses, cuts or changes anything shows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.catalog import DAY, HTML_SQL, day, query
from quillmark.functions.redact import redact_cards, redact_json
from quillmark.functions.scalar import fault_key, file_stamp, parse_epoch, parse_time, row_hash
from quillmark.operators import joins as J
from quillmark.operators import merge as M
from quillmark.operators import backfill, tagging
from quillmark.sources import chats, files, hits, polls, splits, tasks, transcripts
from quillmark.sources import testbed as T
from quillmark.streaming import ingest, outbox
from quillmark.streaming import state as ST
from quillmark.workspace import staging, stored

_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.read(spark, sf_dir, "conversations")
    at = F.timestamp_add("SECOND", (F.col("conv_id") * 600 + F.col("turn")).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return t.select("conv_id", "turn", "role", "text", at.alias("at"))


_AT = "TIMESTAMP '2024-01-01' + to_seconds(conv_id * 600 + turn)"


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


# --- transcripts -----------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a conversation, a line a turn; assistant turns are lists of blocks, some with a tool; each file starts with a broken line."""
    t = _turns(spark, sf_dir)
    sid, uid = F.concat(F.lit("s"), "conv_id"), F.concat("conv_id", F.lit(":"), "turn")
    plain = F.to_variant_object(F.struct(F.col("role").alias("role"), F.col("text").alias("content")))
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"))
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("call-"), uid).alias("id"), F.lit("Find").alias("name"))
    blocks = F.when(F.col("turn") % 3 == 1, F.array(text, tool)).otherwise(F.array(text))
    listed = F.to_variant_object(F.struct(F.col("role").alias("role"), blocks.alias("content")))
    raw = _json(type=F.col("role"), uuid=uid, sessionId=sid, timestamp=F.date_format("at", _ISO), cwd=F.concat(F.lit("/w/"), F.col("conv_id") % 5), message=F.when(F.col("role") == "assistant", listed).otherwise(plain))
    good = t.select(F.concat(F.lit("/t/"), sid, F.lit(".jsonl")).alias("path"), (F.col("turn") + 2).cast("int").alias("lineno"), raw.alias("raw"))
    bad = t.select(F.concat(F.lit("/t/"), sid, F.lit(".jsonl")).alias("path")).distinct().select("path", F.lit(1).alias("lineno"), F.lit('{"broken').alias("raw"))
    return good.union(bad)


@query("transcript_observations", f"""SELECT conv_id || ':' || turn AS obs_id, 's' || conv_id AS session_id, CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'tool_use' ELSE role END AS type, {DAY(_AT)} AS ts,
coalesce(text, '') AS body, CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'Find' END AS tool_name, CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'call-' || conv_id || ':' || turn END AS tool_use_id FROM conversations""")
def transcript_observations(spark, sf_dir):
    _, observations, _ = transcripts.entities(_lines(spark, sf_dir))
    return observations.select("obs_id", "session_id", "type", day("ts").alias("ts"), "body", "tool_name", "tool_use_id")


@query("transcript_sessions", f"""SELECT 's' || conv_id AS session_id, 's' || conv_id AS root_session_id, 'session' AS kind, '/w/' || (conv_id % 5) AS cwd, {DAY(f'min({_AT})')} AS first_ts, {DAY(f'max({_AT})')} AS last_ts,
'/t/s' || conv_id || '.jsonl' AS jsonl_path FROM conversations GROUP BY conv_id""")
def transcript_sessions(spark, sf_dir):
    sessions, _, _ = transcripts.entities(_lines(spark, sf_dir))
    return sessions.select("session_id", "root_session_id", "kind", "cwd", day("first_ts").alias("first_ts"), day("last_ts").alias("last_ts"), "jsonl_path")


@query("transcript_faults", "SELECT DISTINCT '/t/s' || conv_id || '.jsonl' AS path, 1 AS lineno, 'corrupt JSON' AS reason FROM conversations")
def transcript_faults(spark, sf_dir):
    return transcripts.entities(_lines(spark, sf_dir))[2]


def _nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c is a subagent of conversation c - c % 4; the first line of a top session's file launches its three."""
    t = _turns(spark, sf_dir)
    top, child = (F.col("conv_id") - F.col("conv_id") % 4).cast("string"), F.col("conv_id") % 4 != 0
    sid, agent = F.concat(F.lit("s"), top), F.concat(F.lit("a"), "conv_id")
    path = F.when(child, F.concat(F.lit("/t/"), sid, F.lit("/subagents/agent-"), agent, F.lit(".jsonl"))).otherwise(F.concat(F.lit("/t/"), sid, F.lit(".jsonl")))
    said = F.to_variant_object(F.struct(F.col("role").alias("role"), F.col("text").alias("content")))
    raw = _json(type=F.col("role"), uuid=F.concat("conv_id", F.lit(":"), "turn"), sessionId=sid, timestamp=F.date_format("at", _ISO), agentType=F.when(child, "explore"), message=said)
    lines = t.select(path.alias("path"), (F.col("turn") + 10).cast("int").alias("lineno"), raw.alias("raw"))
    launch = F.array(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("call-"), "conv_id").alias("tool_use_id"), F.concat(F.lit("started agentId: "), agent, F.lit(" now")).alias("content")))
    result = F.to_variant_object(F.struct(F.lit("user").alias("role"), launch.alias("content")))
    calls = t.where(child).groupBy("conv_id").agg(F.min("at").alias("at")).select(
        F.concat(F.lit("/t/"), sid, F.lit(".jsonl")).alias("path"), (F.col("conv_id") % 4).cast("int").alias("lineno"),
        _json(type=F.lit("user"), uuid=F.concat(F.lit("launch:"), "conv_id"), sessionId=sid, timestamp=F.date_format("at", _ISO), message=result).alias("raw"),
    )
    return lines.union(calls)


@query("transcript_subagents", """SELECT 's' || (conv_id - conv_id % 4) || ':a' || conv_id AS session_id, 's' || (conv_id - conv_id % 4) AS root_session_id, 'a' || conv_id AS agent_id, 'explore' AS agent_type, 'call-' || conv_id AS spawned_by_tool_use_id
FROM conversations WHERE conv_id % 4 <> 0 GROUP BY conv_id""")
def transcript_subagents(spark, sf_dir):
    sessions, _, _ = transcripts.entities(_nested_lines(spark, sf_dir))
    return sessions.where("kind = 'subagent'").select("session_id", "root_session_id", "agent_id", "agent_type", "spawned_by_tool_use_id")


@query("spawn_index", "SELECT 's' || (conv_id - conv_id % 4) AS parent, 'a' || conv_id AS agent_id, 'call-' || conv_id AS spawned_by FROM conversations WHERE conv_id % 4 <> 0 GROUP BY conv_id")
def spawn_index(spark, sf_dir):
    objects, _ = transcripts.parse(_nested_lines(spark, sf_dir))
    return transcripts.spawn_index(objects)


@query("split_lines", "SELECT doc_id, true AS numbered FROM documents")
def split_lines(spark, sf_dir):
    """A line for each document, in files that many tasks read a part of: each line has the number that it was written with."""
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    with staging(spark) as work:
        docs.select(_json(id=F.col("doc_id"), at=at, text=F.col("text")).alias("value")).write.text(f"{work.root}/lines")
        was = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
        try:
            lines = splits.numbered_lines(spark.read.option("pathGlobFilter", "part-*"), f"{work.root}/lines")
            numbered = F.get_json_object("raw", "$.at").cast("int") == F.col("lineno")
            return stored(lines.select(F.get_json_object("raw", "$.id").cast("long").alias("doc_id"), numbered.alias("numbered")), "split-lines")
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@query("backfill_archive", f"""SELECT obs_id, CASE WHEN conv_id % 3 = 0 AND type IS NOT NULL AND type = 'user' AND kind <> 'subagent' THEN CASE conv_id % 4 WHEN 1 THEN 'system' WHEN 2 THEN 'hook' WHEN 3 THEN 'agent' ELSE provenance END ELSE provenance END AS provenance FROM obs""")
def backfill_archive(spark, sf_dir):
    """Turns without a class; the transcripts of every third conversation are still there and say who wrote its turns."""
    turns = T.observations(spark, sf_dir, classified=False)
    kept = turns.where("conv_id % 3 = 0")
    how = F.col("conv_id") % 4
    raw = _json(uuid=F.col("obs_id"), type=F.lit("user"), isMeta=how == 1, promptSource=F.when(how == 2, "sdk"), isSidechain=F.when(how == 3, True))
    lines = kept.select(F.concat(F.lit("/t/"), "session_id").alias("path"), F.lit(1).alias("lineno"), raw.alias("raw"))
    found = transcripts.structure(transcripts.parse(lines)[0])
    return backfill.by_structure(turns.select("obs_id", "session_id", "type", "body", "provenance"), T.sessions(spark, sf_dir), found).select("obs_id", "provenance")


# --- chat exports ----------------------------------------------------------------------------------------------------


def _exports(conversations: DataFrame) -> DataFrame:
    """Files of ten conversations each, and an older file of all with another text."""
    array = lambda c: F.concat(F.lit("["), F.array_join(F.collect_list(c), ","), F.lit("]"))
    new = conversations.groupBy((F.col("conv_id") / 10).cast("int").alias("k")).agg(array("raw").alias("value")).select(F.concat(F.lit("/x/"), "k", F.lit(".json")).alias("path"), F.lit("2024-03-02").cast("timestamp").alias("modified"), "value")
    old = conversations.groupBy((F.col("conv_id") / 10).cast("int").alias("k")).agg(array("stale").alias("value")).select(F.concat(F.lit("/o/"), "k", F.lit(".json")).alias("path"), F.lit("2024-03-01").cast("timestamp").alias("modified"), "value")
    return new.union(old)


def _node_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).withColumn("node", F.concat(F.lit("n"), "conv_id", F.lit("-"), "turn"))
    seconds = F.unix_seconds("at").cast("double") + 0.5
    message = F.struct(F.struct(F.col("role").alias("role")).alias("author"), F.struct(F.array("text").alias("parts")).alias("content"), seconds.alias("create_time"))
    node = F.struct(F.when(F.col("turn") > 0, F.concat(F.lit("n"), "conv_id", F.lit("-"), F.col("turn") - 1)).alias("parent"), message.alias("message"))
    grouped = t.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("node", node.alias("value")))).alias("mapping"), F.min(F.unix_seconds("at")).alias("lo"), F.max(F.unix_seconds("at")).alias("hi"))
    cid = F.concat(F.lit("c"), "conv_id")
    raw = _json(conversation_id=cid, create_time=F.col("lo"), update_time=F.col("hi"), mapping=F.col("mapping"))
    stale = _json(conversation_id=cid, create_time=F.col("lo"), update_time=F.col("hi"), mapping=F.map_filter("mapping", lambda k, v: F.lit(False)))
    return _exports(grouped.select("conv_id", raw.alias("raw"), stale.alias("stale")))


@query("export_nodes", f"""SELECT 'chatgpt:n' || conv_id || '-' || turn AS obs_id, 'chatgpt:c' || conv_id AS session_id,
CASE WHEN lag(text) OVER w <> '' THEN 'chatgpt:n' || conv_id || '-' || (turn - 1) END AS parent_obs_id, role AS type, {DAY(_AT)} AS ts, text AS body
FROM conversations WHERE text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def export_nodes(spark, sf_dir):
    _, observations, _ = chats.node_map(files.sniff_exports(_node_exports(spark, sf_dir), "node_map"))
    return observations.select("obs_id", "session_id", "parent_obs_id", "type", day("ts").alias("ts"), "body")


@query("export_node_sessions", f"SELECT 'chatgpt:c' || conv_id AS session_id, {DAY(f'min({_AT})')} AS first_ts, {DAY(f'max({_AT})')} AS last_ts, '/x/' || (conv_id // 10) || '.json' AS jsonl_path FROM conversations GROUP BY conv_id")
def export_node_sessions(spark, sf_dir):
    """Of a conversation in two files the newer file's counts."""
    sessions, _, _ = chats.node_map(files.sniff_exports(_node_exports(spark, sf_dir), "node_map"))
    return sessions.select("session_id", day("first_ts").alias("first_ts"), day("last_ts").alias("last_ts"), "jsonl_path")


def _message_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    uid = F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn")
    block = lambda kind, text, name: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.concat(F.lit("t"), uid).alias("id"), F.lit(name).alias("name"), F.struct(F.col("turn").alias("q")).alias("input"))
    said, used = block("text", F.col("text"), None), block("tool_use", F.lit(None).cast("string"), "find")
    content = F.when(F.col("role") == "assistant", F.array(said, used)).otherwise(F.array(said))
    message = F.struct(uid.alias("uuid"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.date_format("at", _ISO).alias("created_at"), F.when(F.col("turn") > 0, F.concat(F.lit("m"), "conv_id", F.lit("-"), F.col("turn") - 1)).alias("parent_message_uuid"), content.alias("content"))
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("chat_messages"))
    uuid = F.concat(F.lit("c"), "conv_id")
    return _exports(grouped.select("conv_id", _json(uuid=uuid, chat_messages=F.col("chat_messages")).alias("raw"), _json(uuid=uuid, chat_messages=F.slice("chat_messages", 1, 1)).alias("stale")))


@query("export_messages", f"""SELECT 'claude-web:m' || conv_id || '-' || turn AS obs_id, 'claude-web:c' || conv_id AS session_id, CASE WHEN turn > 0 THEN 'claude-web:m' || conv_id || '-' || (turn - 1) END AS parent_obs_id,
role AS type, {DAY(_AT)} AS ts, text AS body, NULL AS tool_name FROM conversations WHERE text <> ''
UNION ALL SELECT 'claude-web:m' || conv_id || '-' || turn || ':b1', 'claude-web:c' || conv_id, 'claude-web:m' || conv_id || '-' || turn, 'tool_use', {DAY(_AT)}, '{{"q":' || turn || '}}', 'find' FROM conversations WHERE role = 'assistant'""")
def export_messages(spark, sf_dir):
    _, observations, _ = chats.message_list(files.sniff_exports(_message_exports(spark, sf_dir), "message_list"))
    return observations.select("obs_id", "session_id", "parent_obs_id", "type", day("ts").alias("ts"), "body", "tool_name")


@query("export_elements", """SELECT conv_id, row_number() OVER (PARTITION BY conv_id // 50 ORDER BY conv_id) - 1 AS at, count(*) AS turns, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def export_elements(spark, sf_dir):
    """Exports of fifty conversations each, cut at their elements by tasks that read a part of a file each; texts hold all that JSON escapes."""
    turns = T.read(spark, sf_dir, "conversations")
    each = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"), F.lit(',"[{\\').alias("odd")))).alias("turns"))
    one = each.select("conv_id", _json(id=F.col("conv_id"), turns=F.col("turns")).alias("raw"))
    files_of = one.groupBy(F.floor(F.col("conv_id") / 50).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "raw"))), lambda x: x["raw"]), " , ").alias("all"))
    with staging(spark) as work:
        files_of.select("k", F.concat(F.lit("[ "), "all", F.lit(" ]\n")).alias("value")).repartition("k").write.partitionBy("k").text(f"{work.root}/exports")
        was = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
        try:
            found = splits.json_elements(spark.read.option("recursiveFileLookup", "true"), f"{work.root}/exports")
            v = F.try_parse_json("value")
            texts = F.try_variant_get(v, "$[0].turns", "array<struct<turn bigint, text string, odd string>>")
            rows = found.select(F.try_variant_get(v, "$[0].id", "bigint").alias("conv_id"), F.col("first").alias("at"), texts.alias("t"))
            sums = F.aggregate("t", F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]))
            return stored(rows.select("conv_id", "at", F.size("t").cast("long").alias("turns"), sums.alias("chars")), "export-elements")
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", was)


# --- search hits, tasks, files ---------------------------------------------------------------------------------------


def _hit_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Documents as hits of two endpoints; those with doc_id % 3 = 0 are in both, later in the second; % 50 = 7 lack a repository."""
    d = T.read(spark, sf_dir, "documents")
    stamp = lambda n: F.date_format(F.timestamp_add("HOUR", (F.col("doc_id") + n).cast("int"), F.lit("2024-01-01").cast("timestamp")), _ISO)
    place = F.when(F.col("doc_id") % 50 != 7, F.concat(F.lit("https://api.x/repos/"), "lang", F.lit("/"), "source"))
    hit = lambda title, n: _json(number=F.col("doc_id"), title=F.concat(F.lit(title), F.substring("text", 1, 300)), state=F.when(F.col("doc_id") % 2 == 0, "open").otherwise("closed"), repository_url=place, body=F.col("text"), created_at=stamp(0), updated_at=stamp(n), user=F.struct(F.lit("u").alias("login")))
    return {"pr": d.select(hit("P ", 1).alias("raw")), "assigned": d.where("doc_id % 3 = 0").select(hit("I ", 2).alias("raw"))}


@query("hit_records", """SELECT 'github:' || lang || '/' || source || ':' || doc_id AS stable_id, substr(CASE WHEN doc_id % 3 = 0 THEN 'I ' ELSE 'P ' END || substr(text, 1, 300), 1, 280) AS subject, text AS body,
CASE WHEN doc_id % 3 = 0 THEN [lang || '/' || source, 'issue', CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'closed' END, 'assigned'] ELSE [lang || '/' || source, 'pr', CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'closed' END] END AS tags,
strftime(TIMESTAMP '2024-01-01' + to_hours(doc_id + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END), '%Y-%m-%d %H:%M:%S') AS updated_at FROM documents WHERE doc_id % 50 <> 7""")
def hit_records(spark, sf_dir):
    """Of an item that two endpoints have the later stays."""
    return hits.all_endpoints(_hit_frames(spark, sf_dir))[0].select("stable_id", "subject", "body", "tags", day("updated_at").alias("updated_at"))


@query("hit_faults", "SELECT 'number=' || doc_id AS row, 'no repository in the hit' AS reason FROM documents WHERE doc_id % 50 = 7 UNION ALL SELECT 'number=' || doc_id, 'no repository in the hit' FROM documents WHERE doc_id % 50 = 7 AND doc_id % 3 = 0")
def hit_faults(spark, sf_dir):
    return hits.all_endpoints(_hit_frames(spark, sf_dir))[1]


#: Rows of orders that lie in one split of their backups.
_ROWS_A_SPLIT = 50_000


def _backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of task backups: a file for each status, with a preamble, quotes and commas; one row in each lacks its id."""
    o = T.read(spark, sf_dir, "orders")
    cell = lambda c: F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    made = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ssxx")
    cells = [F.lit("F"), F.concat(F.lit("L"), F.col("o_custkey") % 9), F.concat(F.lit('Order "'), "o_orderkey", F.lit('", '), "o_orderpriority"), F.concat(F.lit("x, "), F.lower("o_orderstatus")), F.lit("two\nlines"), F.lit("5"), F.when(F.col("o_orderstatus") == "F", "2").otherwise("0"), made, F.when(F.col("o_orderstatus") == "F", made).otherwise(""), F.col("o_orderkey")]
    row = F.concat_ws(",", *[cell(c) for c in cells])
    head = ("Date: 2024", '"Folder Name","List Name","Title","Tags","Content","Priority","Status","Created Time","Completed Time","taskId"')
    path = F.concat(F.lit("/b/"), "o_orderstatus", F.lit(".csv")).alias("path")
    split = F.floor(F.col("key") / _ROWS_A_SPLIT).cast("long") + 1
    o = o.withColumn("key", F.monotonically_increasing_id())
    rows = o.select(path, split.alias("split"), "key", F.posexplode(F.split(row, "\n")).alias("n", "raw"))
    ends = o.groupBy(path).agg(F.max(split).alias("last"))
    more = lambda split, *lines: ends.select("path", split.cast("long").alias("split"), F.lit(0).cast("long").alias("key"), F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("n", "raw"))
    lines = rows.unionByName(more(F.lit(0), *head)).unionByName(more(F.col("last") + 1, '"F","L","lost","","","0","0","","",""', ""))
    return lines.select("path", F.lit("2024-03-01").cast("timestamp").alias("modified"), "split", F.struct("key", "n").alias("at"), "raw")


@query("task_backups", """SELECT 'ticktick:' || o_orderkey AS stable_id, 'Order "' || o_orderkey || '", ' || o_orderpriority AS subject, 'two' || chr(10) || 'lines' AS body,
['x', lower(o_orderstatus), 'L' || (o_custkey % 9), 'F', CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'open' END] AS tags, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at FROM orders""")
def task_backups(spark, sf_dir):
    return tasks.csv_records(tasks.parse_backups(_backups(spark, sf_dir))).select("stable_id", "subject", "body", "tags", day("created_at").alias("created_at"))


@query("task_backup_faults", "SELECT DISTINCT '/b/' || o_orderstatus || '.csv' AS path, 1::BIGINT AS lost FROM orders")
def task_backup_faults(spark, sf_dir):
    return tasks.parse_backups(_backups(spark, sf_dir)).select("path", "lost").distinct()


@query("task_polls", """SELECT 'ticktick:' || o_orderkey AS stable_id, 'Order ' || o_orderkey AS subject, 'c' || chr(10) || '- one' AS body, ['t', 'P' || (o_custkey % 9), CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'open' END] AS tags,
strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at FROM orders""")
def task_polls(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders")
    raw = _json(id=F.col("o_orderkey"), title=F.concat(F.lit(" Order "), "o_orderkey", F.lit(" ")), content=F.lit("c"), items=F.array(F.struct(F.lit("one").alias("title")), F.struct(F.lit("").alias("title"))), tags=F.array(F.lit(" t "), F.lit("")), status=F.when(F.col("o_orderstatus") == "F", 2).otherwise(0), createdTime=F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSxx"))
    frame = o.select(raw.alias("raw"), F.concat(F.lit("P"), F.col("o_custkey") % 9).alias("project_name"))
    return tasks.api_records(frame)[0].select("stable_id", "subject", "body", "tags", day("created_at").alias("created_at"))


@query("task_merge", """SELECT o_orderkey AS task_id, CASE WHEN o_custkey % 3 = 0 THEN 'backup' ELSE 'polled' END AS origin,
CASE WHEN o_orderstatus = 'F' THEN 'measured' WHEN o_custkey % 3 <> 0 THEN 'guess' END AS completed_at, o_orderstatus <> 'F' AND o_custkey % 3 <> 0 AS inferred FROM orders""")
def task_merge(spark, sf_dir):
    """Backup and poll of the same tasks: the later observation wins, a measured end beats a guessed one."""
    o = T.read(spark, sf_dir, "orders")
    backup = o.select(F.col("o_orderkey").alias("task_id"), F.lit("backup").alias("origin"), F.when(F.col("o_custkey") % 3 == 0, 9).otherwise(1).alias("observed_at"), F.when(F.col("o_orderstatus") == "F", "measured").alias("completed_at"), F.lit(False).alias("inferred"))
    polled = o.select(F.col("o_orderkey").alias("task_id"), F.lit("polled").alias("origin"), F.lit(5).alias("observed_at"), F.lit("guess").alias("completed_at"), F.lit(True).alias("inferred"))
    return J.merge_two_sources(backup, polled).select("task_id", "origin", "completed_at", "inferred")


_PROJECT, _OPEN = "(o_custkey % 20)", "o_orderstatus <> 'F'"


def _poll_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that aren't finished as a poll: a listing of projects 0 to 17, and a payload for each; 3 and 7 go on elsewhere, 11 is empty, 18 and 19 aren't listed."""
    o = T.read(spark, sf_dir, "orders").withColumn("p", (F.col("o_custkey") % 20).cast("string"))
    task = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.lit(0).alias("status"))
    whole = F.collect_list(F.when((F.col("o_orderstatus") != "F") & (F.col("p") != "11"), task))  # a payload is as large as its project
    held = o.groupBy("p").agg(whole.alias("tasks")).withColumn("more", F.when(F.col("p").isin("3", "7"), True))
    payload = _json(project=F.struct(F.col("p").alias("id")), tasks=F.col("tasks"), hasMore=F.col("more"))
    listed = F.array(*[F.struct(F.lit(str(k)).alias("id")) for k in range(18)])
    return held.select(payload.alias("value")).union(spark.range(1).select(_json(projects=listed).alias("value")))


@query("poll_covered", f"SELECT DISTINCT {_PROJECT}::VARCHAR AS project_id, false AS complete FROM orders WHERE {_PROJECT} < 18 AND {_PROJECT} NOT IN (3, 7)")
def poll_covered(spark, sf_dir):
    """Projects that a poll covered: listed, and read to the end. With two that weren't it isn't complete."""
    poll = polls.read_poll(_poll_lines(spark, sf_dir))
    return poll.covered.withColumn("complete", poll.complete.scalar())


@query("poll_tasks", f"SELECT 'ticktick:' || o_orderkey AS stable_id, {_PROJECT}::VARCHAR AS project_id FROM orders WHERE {_OPEN} AND {_PROJECT} <> 11")
def poll_tasks(spark, sf_dir):
    """Tasks out of the payloads of a poll, each with its project."""
    records, _ = tasks.api_records(polls.read_poll(_poll_lines(spark, sf_dir)).tasks)
    return records.select("stable_id", F.get_json_object("extra", "$.project_id").alias("project_id"))


_FATES = f"""CASE WHEN {_OPEN} AND {_PROJECT} <> 11 THEN CASE WHEN o_custkey % 7 = 0 THEN 'new' ELSE 'open' END
WHEN {_PROJECT} < 18 AND {_PROJECT} NOT IN (3, 7) THEN 'completed' WHEN o_orderkey % 2 = 0 THEN 'retained' ELSE 'missed' END"""


def _fates(spark: SparkSession, sf_dir: str, complete: bool) -> DataFrame:
    """All orders but those of every seventh customer were open before, half of them were missed before."""
    poll = polls.read_poll(_poll_lines(spark, sf_dir))
    before = T.read(spark, sf_dir, "orders").where("o_custkey % 7 <> 0").select(F.col("o_orderkey").cast("string").alias("task_id"), (F.col("o_custkey") % 20).cast("string").alias("project_id"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("2024-01-01").cast("timestamp")).alias("missed_at"))
    polled = poll.tasks.select(F.get_json_object("raw", "$.id").alias("task_id"), "project_id")
    return polls.poll_diff(before, polled, poll.covered, F.lit(complete))


@query("poll_fates", f"SELECT o_orderkey::VARCHAR AS task_id, {_PROJECT}::VARCHAR AS project_id, {_FATES} AS fate FROM orders WHERE o_custkey % 7 <> 0 OR ({_OPEN} AND {_PROJECT} <> 11)")
def poll_fates(spark, sf_dir):
    """What a poll says of each task: open, new, completed where it looked, kept and reported first or again where it didn't."""
    return _fates(spark, sf_dir, True)


@query("poll_incomplete", f"SELECT CASE WHEN o_custkey % 7 = 0 THEN 'ignored' ELSE 'kept' END AS fate, count(*) AS n FROM orders WHERE o_custkey % 7 <> 0 OR ({_OPEN} AND {_PROJECT} <> 11) GROUP BY 1")
def poll_incomplete(spark, sf_dir):
    """From a poll that isn't complete nothing follows."""
    return _fates(spark, sf_dir, False).groupBy("fate").agg(F.count("*").alias("n"))


@query("poison_rows", "SELECT doc_id, '[REDACTED:email] of ' || doc_id AS held FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)")
def poison_rows(spark, sf_dir):
    """All documents go through a parser that one of them makes fail: that row alone is set aside, as redacted JSON, and the others are written."""
    docs = T.read(spark, sf_dir, "documents")
    last = docs.agg(F.max("doc_id")).scalar()
    raw = docs.select("doc_id", "text", F.concat(F.lit("a@b.org of "), "doc_id").alias("note"))

    def parse(rows: DataFrame) -> DataFrame:
        return rows.select(F.concat(F.lit("doc:"), "doc_id").alias("stable_id"), F.lit("docs").alias("source"), F.lit("s").alias("subject"), F.when(F.col("doc_id") == last, F.raise_error(F.lit("can't be read"))).otherwise(F.col("text")).alias("body"))

    with staging(spark) as work:
        batch = ingest.staged(work, "docs", "records", ingest.Rows(raw, parse, ("doc_id",)))
        if batch.rows.count() + 1 != docs.count():
            raise AssertionError("a sound row was lost")
        held = batch.aside.select(F.get_json_object("payload", "$.doc_id").cast("long").alias("doc_id"), F.get_json_object("payload", "$.note").alias("held"))
        return stored(held, "poison-rows")


@query("extra_scrubbed", """SELECT doc_id, '{"note":"by [REDACTED:email]","n":' || doc_id || '}' AS extra FROM documents""")
def extra_scrubbed(spark, sf_dir):
    """Addresses inside JSON are redacted, and it stays JSON."""
    extra = _json(note=F.concat(F.lit("by user"), F.col("doc_id"), F.lit("@example.org")), n=F.col("doc_id"))
    return T.read(spark, sf_dir, "documents").select("doc_id", redact_json(extra).alias("extra"))


_LINE = "'set aside ' || doc_id || ': ' || source"


@query("outbox_unread", f"SELECT {_LINE} AS line FROM documents WHERE lang <> 'en'")
def outbox_unread(spark, sf_dir):
    """Of a line for each document those that no delivered batch carries as a whole line stay to be read; a longer line carries none."""
    d = T.read(spark, sf_dir, "documents")
    line = F.concat(F.lit("set aside "), "doc_id", F.lit(": "), "source")
    due = outbox.lines(d, F.lit("docs"), "held", line, F.col("doc_id"), F.lit("2024-01-01").cast("timestamp"))
    carried = d.select(F.when(F.col("lang") == "en", line).otherwise(F.concat(line, F.lit(" and more"))).alias("line"))
    return outbox.unread(due, carried).select("line")


@query("tree_files", r"""SELECT 'dropbox:' || source || '/d' || doc_id || '.md' AS stable_id, CASE WHEN doc_id % 2 = 0 THEN 'Head ' || doc_id ELSE 'd' || doc_id END AS subject,
substr(CASE WHEN doc_id % 2 = 0 THEN '# Head ' || doc_id || chr(10) ELSE '' END || text, 1, 200000) AS body, [source, 'md'] AS tags FROM documents WHERE text <> '' OR doc_id % 2 = 0""")
def tree_files(spark, sf_dir):
    """Documents as files of a tree, half of them with a heading."""
    d = T.read(spark, sf_dir, "documents")
    relative = F.concat("source", F.lit("/d"), "doc_id", F.lit(".md"))
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# Head "), "doc_id", F.lit("\n"))).otherwise(""), "text")
    found = d.select(F.concat(F.lit("/root/"), relative).alias("path"), relative.alias("relative"), F.lit("md").alias("extension"), F.lit("2024-01-01").cast("timestamp").alias("modified"), F.encode(text, "utf-8").alias("content"))
    return files.tree_records(found)[0].where("body <> ''").select("stable_id", "subject", "body", "tags")


def _zips(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        for k, part in df.groupby("k"):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("posts.csv", "a")
                for page, html in zip(part["page_id"], part["html"], strict=True):
                    z.writestr(f"posts/{page}.some-slug.html", html)
                    z.writestr(f"posts/{page}.opens.csv", "a")
            yield pd.DataFrame({"path": [f"/z/{k}.zip"], "modified": [pd.Timestamp("2024-03-01")], "content": [out.getvalue()]})


@query("post_zips", f"SELECT 'substack:' || page_id AS stable_id, coalesce(title, 'Some Slug') AS subject, body, CASE WHEN octet_length(encode(body)) < {files.STUB_BYTES} THEN ['substack', 'published', 'stub'] ELSE ['substack', 'published'] END AS tags FROM ({HTML_SQL})")
def post_zips(spark, sf_dir):
    """Pages as posts in export zips."""
    pages = T.read(spark, sf_dir, "pages").select("page_id", "html", (F.col("page_id") % 7).alias("k")).repartition("k")
    zips = pages.mapInPandas(_zips, "path string, modified timestamp, content binary")
    return files.post_records(zips).select("stable_id", "subject", "body", "tags")


# --- scalars ---------------------------------------------------------------------------------------------------------


@query("row_fingerprints", "SELECT doc_id, sha256('v' || doc_id || chr(30) || 'v' || text || chr(30) || CASE WHEN doc_id % 3 = 0 THEN 'n' ELSE 'v' END || chr(30)) AS hash FROM documents")
def row_fingerprints(spark, sf_dir):
    """Null and empty parts give other hashes."""
    return T.read(spark, sf_dir, "documents").select("doc_id", row_hash(F.col("doc_id"), F.col("text"), F.when(F.col("doc_id") % 3 != 0, "")).alias("hash"))


@query("fault_keys", "SELECT doc_id, sha256(source || chr(31) || lang || chr(31) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE doc_id::VARCHAR END) AS key FROM documents")
def fault_keys(spark, sf_dir):
    detail = F.when(F.col("doc_id") % 2 != 0, F.col("doc_id").cast("string"))
    return T.read(spark, sf_dir, "documents").select("doc_id", fault_key(F.col("source"), F.col("lang"), detail).alias("key"))


@query("file_stamps", "SELECT event_id, (epoch_us(ts) * 1000)::VARCHAR || ':' || user_id AS stamp FROM events")
def file_stamps(spark, sf_dir):
    return T.read(spark, sf_dir, "events").select("event_id", file_stamp(F.col("ts").cast("timestamp"), F.col("user_id")).alias("stamp"))


_SPELLED = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+0000'", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'", "yyyy-MM-dd'T'HH:mm:ss'+01:00'")


@query("iso_times", f"SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL ELSE {DAY('ts - to_hours(CASE WHEN event_id % 6 = 4 THEN 1 ELSE 0 END)')} END AS t FROM events")
def iso_times(spark, sf_dir):
    """Times in five spellings, and one that is no time."""
    e, spelled = T.read(spark, sf_dir, "events"), F.lit("not a time")
    for k, form in enumerate(_SPELLED):
        spelled = F.when(F.col("event_id") % 6 == k, F.date_format("ts", form)).otherwise(spelled)
    return e.select("event_id", day(parse_time(spelled)).alias("t"))


@query("epoch_times", f"SELECT event_id, {DAY('ts')} AS t FROM events")
def epoch_times(spark, sf_dir):
    return T.read(spark, sf_dir, "events").select("event_id", day(parse_epoch(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)).alias("t"))


_CARD = "lpad((c_custkey * 7919 % 10000)::VARCHAR, 4, '0')"
_DIGITS = f"('4000' || {_CARD} || lpad(c_custkey::VARCHAR, 8, '0'))"


@query("luhn_cards", f"WITH c AS (SELECT c_custkey, {_DIGITS} AS n FROM customer) SELECT c_custkey, 'card ' || CASE WHEN ("
       "(SELECT sum(CASE WHEN k % 2 = 1 THEN CASE WHEN 2 * d > 9 THEN 2 * d - 9 ELSE 2 * d END ELSE d END) FROM (SELECT k, substr(n, k::INT, 1)::INT AS d FROM range(1, 17) r(k))) % 10 = 0) "
       "THEN '[REDACTED:credit_card]' ELSE substr(n, 1, 4) || '-' || substr(n, 5, 4) || '-' || substr(n, 9, 4) || '-' || substr(n, 13, 4) END || ' end' AS body FROM c")  # fmt: skip
def luhn_cards(spark, sf_dir):
    """Card-like numbers, of which those with a right check digit are redacted."""
    c = T.read(spark, sf_dir, "customer")
    digits = F.concat(F.lit("4000"), F.lpad((F.col("c_custkey") * 7919 % 10000).cast("string"), 4, "0"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    parts = F.concat_ws("-", *[F.substring(digits, k, 4) for k in (1, 5, 9, 13)])
    return c.select("c_custkey", redact_cards(F.concat(F.lit("card "), parts, F.lit(" end"))).alias("body"))


# --- writes and ingest state -----------------------------------------------------------------------------------------


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All records as stored, with earlier bodies for some; and all records as a batch, without times for some."""
    r = T.records(spark, sf_dir).withColumn("extra", F.lit(None).cast("string"))
    columns = ("stable_id", "source", "subject", "body", "tags", "llm_tags", "created_at", "updated_at", "extra", "src_hash", "llm_tags_src_hash")
    plain = r.withColumn("body", F.concat(F.lit("body "), "doc_id")).withColumn("subject", F.lit("s"))
    old = plain.withColumn("src_hash", F.when(F.col("doc_id") % 4 == 0, "older").otherwise(F.col("src_hash"))).withColumn("body", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("body")))
    new = plain.withColumn("created_at", F.when(F.col("doc_id") % 3 == 0, F.col("created_at"))).withColumn("updated_at", F.timestamp_add("DAY", F.lit(1), F.col("updated_at"))).withColumn("source", F.lit("moved"))
    return old.select(*columns), new.select(*columns)


@query("upsert_records", f"""SELECT stable_id, source, 'body ' || doc_id AS body, {DAY('created_at')} AS created_at, {DAY('updated_at + INTERVAL 1 DAY')} AS updated_at, llm_tags FROM rec""")
def upsert_records(spark, sf_dir):
    """Source, first created_at and model tags of stored rows stay; body and updated_at move on."""
    done = M.upsert_records(*_old_and_new(spark, sf_dir))
    return done.select("stable_id", "source", "body", day("created_at").alias("created_at"), day("updated_at").alias("updated_at"), "llm_tags")


@query("rebuild_source", "SELECT stable_id, source, CASE WHEN source = 'src3' THEN 'fresh' ELSE 'kept' END AS what FROM rec")
def rebuild_source(spark, sf_dir):
    stored = T.records(spark, sf_dir).select("stable_id", "source", F.lit("kept").alias("what"))
    fresh = stored.where("source = 'src3'").withColumn("what", F.lit("fresh"))
    return M.rebuild(stored, fresh, "source", "src3")


@query("write_tags", "SELECT stable_id, CASE WHEN doc_id % 2 = 0 THEN ['new'] ELSE llm_tags END AS llm_tags FROM rec")
def write_tags(spark, sf_dir):
    r = T.records(spark, sf_dir)
    tagged = r.where("doc_id % 2 = 0").select("stable_id", F.array(F.lit("new")).alias("llm_tags"), F.col("src_hash").alias("llm_tags_src_hash"))
    return tagging.write_tags(r.drop("doc_id"), tagged).select("stable_id", "llm_tags")


@query("pending_tags", "SELECT stable_id FROM rec WHERE llm_tags IS NULL OR llm_tags_src_hash IS DISTINCT FROM src_hash")
def pending_tags(spark, sf_dir):
    return tagging.pending(T.records(spark, sf_dir)).select("stable_id")


@query("author_backfill", "SELECT obs_id, CASE WHEN conv_id % 2 = 0 THEN 'human' ELSE provenance END AS provenance FROM obs")
def author_backfill(spark, sf_dir):
    """Classes that are stored stay, the rest follow from type, body and kind of session."""
    some = T.observations(spark, sf_dir, classified=False).withColumn("provenance", F.when(F.col("conv_id") % 2 == 0, "human")).drop("kind", "conv_id")
    return tagging.classify_missing(some, T.sessions(spark, sf_dir)).select("obs_id", "provenance")


_NOW = "2024-06-01"


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = T.read(spark, sf_dir, "documents"), F.lit("2024-05-31").cast("timestamp")
    held = d.select("source", F.col("doc_id").cast("string").alias("record_key"), F.col("lang").alias("error_type"), F.lit("d").alias("error_detail"), (1 + F.col("doc_id") % 3).alias("attempts"), t.alias("first_seen_at"), t.alias("last_seen_at"))
    return held.withColumn("next_retry_at", F.timestamp_add("HOUR", (F.col("record_key").cast("int") % 48), t))


_HELD_SQL = "WITH held AS (SELECT *, 1 + doc_id % 3 AS attempts, TIMESTAMP '2024-05-31' + to_hours(doc_id % 48) AS next_retry_at FROM documents)"


@query("quarantine_again", f"""{_HELD_SQL} SELECT doc_id::VARCHAR AS record_key, attempts + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS attempts, '2024-05-31 00:00:00' AS first_seen_at,
CASE WHEN doc_id % 2 = 0 THEN '2024-06-01 00:00:00' ELSE '2024-05-31 00:00:00' END AS last_seen_at,
{DAY("CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-06-01' + to_seconds(900 * (1 << attempts)) ELSE next_retry_at END")} AS next_retry_at FROM held
UNION ALL SELECT 'new' || doc_id, 1, '2024-06-01 00:00:00', '2024-06-01 00:00:00', '2024-06-01 00:15:00' FROM documents""")
def quarantine_again(spark, sf_dir):
    """Rows that fail again are counted up and wait twice as long; new ones are added."""
    now, held = F.lit(_NOW).cast("timestamp"), _held(spark, sf_dir)
    failed = held.where("record_key % 2 = 0").select("source", "record_key", "error_type", "error_detail")
    more = held.select("source", F.concat(F.lit("new"), "record_key").alias("record_key"), "error_type", "error_detail")
    out = ST.quarantine(held, failed.union(more), now)
    return out.select("record_key", "attempts", day("first_seen_at").alias("first_seen_at"), day("last_seen_at").alias("last_seen_at"), day("next_retry_at").alias("next_retry_at"))


@query("quarantine_due", f"{_HELD_SQL} SELECT doc_id::VARCHAR AS record_key FROM held WHERE attempts < 3 AND next_retry_at <= TIMESTAMP '{_NOW}'")
def quarantine_due(spark, sf_dir):
    return ST.retry_due(_held(spark, sf_dir), F.lit(_NOW).cast("timestamp")).select("record_key")


@query("quarantine_release", "SELECT doc_id::VARCHAR AS record_key FROM documents WHERE lang <> 'en'")
def quarantine_release(spark, sf_dir):
    held = _held(spark, sf_dir)
    return ST.release(held, held.where("error_type = 'en'")).select("record_key")


@query("run_state", """SELECT source, CASE WHEN lang_ok THEN greatest('5', top) ELSE '5' END AS cursor_value, CASE WHEN lang_ok THEN 0 ELSE 3 END AS consecutive_failures, (10 + CASE WHEN lang_ok THEN n ELSE 0 END)::BIGINT AS rows_seen,
CASE WHEN NOT lang_ok THEN 'boom' END AS last_error, NULL AS next_attempt_at
FROM (SELECT source, (hash_n % 2 = 0) AS lang_ok, top, n FROM (SELECT source, count(*) AS n, max(doc_id % 9)::VARCHAR AS top, length(source) AS hash_n FROM documents GROUP BY source))""")
def run_state(spark, sf_dir):
    """The state of every source after a run in which some failed for the third time."""
    d = T.read(spark, sf_dir, "documents")
    old = d.select("source").distinct().select("source", F.lit("5").alias("cursor_value"), F.lit(2).cast("long").alias("consecutive_failures"), F.lit(10).cast("long").alias("rows_seen"), *[F.lit(None).cast("timestamp").alias(c) for c in ("last_run_at", "last_ok_at", "next_attempt_at")], F.lit(None).cast("string").alias("last_error"))
    runs = d.groupBy("source").agg(F.count("*").alias("rows_seen"), F.max(F.col("doc_id") % 9).cast("string").alias("cursor_value")).withColumn("ok", F.length("source") % 2 == 0).withColumn("error", F.lit("boom"))
    out = ST.after_run(old, runs, F.lit(_NOW).cast("timestamp"))
    return out.select("source", "cursor_value", F.col("consecutive_failures").cast("int").alias("consecutive_failures"), "rows_seen", "last_error", day("next_attempt_at").alias("next_attempt_at"))


@query("stale_inputs", f"SELECT source, (2 + length(source)) * 86400::BIGINT AS threshold_seconds FROM documents GROUP BY source HAVING epoch(TIMESTAMP '{_NOW}') - epoch(TIMESTAMP '2024-01-01' + to_days(max(doc_id % 150)::INT)) > (2 + length(source)) * 86400")
def stale_inputs(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents")
    inputs = d.groupBy("source").agg(F.timestamp_add("DAY", F.max(F.col("doc_id") % 150).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("input_at")).withColumn("threshold_seconds", (2 + F.length("source")).cast("long") * 86400)
    return ST.stale_episodes(inputs, inputs.limit(0), F.lit(_NOW).cast("timestamp")).select("source", "threshold_seconds")


@query("split_bad", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'no stable_id' WHEN doc_id % 7 = 0 THEN 'no source' END AS error_detail FROM documents")
def split_bad(spark, sf_dir):
    """Every row is either good or bad with a reason."""
    d = T.read(spark, sf_dir, "documents")
    batch = d.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("d:"), "doc_id")).alias("stable_id"), F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("source")).alias("source"))
    good, bad = ingest.split_bad(batch, ingest.fault_in("records", batch.columns))
    return good.select("doc_id", F.lit(None).cast("string").alias("error_detail")).union(bad.select("doc_id", "error_detail"))


@query("batch_rows", "SELECT user_id::VARCHAR AS stable_id, arg_max(event_type, (ts, event_id)) AS subject, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM events GROUP BY user_id")
def batch_rows(spark, sf_dir):
    """What the writer keeps of many versions of a row in one batch."""
    e = T.read(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    batch = e.select(F.col("user_id").cast("string").alias("stable_id"), F.col("event_type").alias("subject"), at.alias("created_at"), at.alias("updated_at"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("src_hash"))
    return ingest.coalesced(batch, "records").select("stable_id", "subject", day("created_at").alias("created_at"), day("updated_at").alias("updated_at"))
