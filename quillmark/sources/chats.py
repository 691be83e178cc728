"""Chat exports of two shapes: conversations as maps of nodes, and as lists of messages with blocks.

Both readers take frames (path, modified, value) of export files, whose JSON is an array of conversations; with first,
a value is the part of its file from that conversation on.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.authorship import author
from quillmark.functions.scalar import parse_epoch, parse_time
from quillmark.operators.joins import first_claim_wins
from quillmark.sources.transcripts import _is, _text

_NO_PARENT = "00000000-0000-4000-8000-"
_SENDERS = {"human": "user", "assistant": "assistant"}
_MISSING = ("cwd", "git_branch", "agent_id", "agent_type", "spawned_by_tool_use_id", "parent_session_id")


def conversations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, modified, at, v of each conversation; faults path, reason of files that aren't arrays)."""
    seen = files.withColumn("v", F.try_parse_json("value"))
    whole = seen.where(_is(F.col("v"), "ARRAY"))
    split = whole.select("path", "modified", F.posexplode(F.variant_get("v", "$", "array<variant>")).alias("at", "v"), *(["first"] if "first" in files.columns else []))
    if "first" in files.columns:  # a value is a part of its file
        split = split.select("path", "modified", (F.col("first") + F.col("at")).alias("at"), "v")
    return split, seen.where(~_is(F.col("v"), "ARRAY")).select("path", F.lit("not a JSON array of conversations").alias("reason"))


def _seconds(v: Column, path: str) -> Column:
    return parse_epoch(F.try_variant_get(v, path, "double"))


def _part_text(part: Column) -> Column:
    plain, text, kind = F.try_variant_get(part, "$", "string"), _text(part, "$.text"), _text(part, "$.content_type")
    label = F.concat(F.lit("[non-text part: "), F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")), F.lit("]"))
    return F.when(_is(part, "STRING"), plain).when(_is(part, "OBJECT"), F.coalesce(F.nullif(text, F.lit("")), label))


def _node_body(content: Column) -> Column:
    parts = F.try_variant_get(content, "$.parts", "array<variant>")
    joined = F.array_join(F.filter(F.transform(parts, _part_text), lambda t: t.isNotNull() & (t != "")), "\n")
    return F.when(parts.isNotNull(), joined).otherwise(F.coalesce(F.try_variant_get(content, "$.text", "string"), F.lit("")))


def node_map(files: DataFrame, since: datetime | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, observations, faults) of exports whose conversations map ids to nodes.

    Empty nodes are left unless they are a tool's; a parent is kept only where its node is. Of a conversation in several
    files the newest counts.
    """
    every, bad = conversations(files)
    v = F.col("v")
    named = every.withColumn("cid", F.coalesce(F.nullif(_text(v, "$.conversation_id"), F.lit("")), F.nullif(_text(v, "$.id"), F.lit(""))))
    faults = bad.unionByName(named.where("cid IS NULL").select("path", F.lit("conversation without an id").alias("reason")))
    one = first_claim_wins(named.where("cid IS NOT NULL"), "cid", "modified", "path", "at")
    nodes = one.select("cid", F.explode(F.try_variant_get(v, "$.mapping", "map<string,variant>")).alias("node", "n"))
    n, said = F.col("n"), F.try_variant_get(F.col("n"), "$.message", "variant")
    role = F.coalesce(F.nullif(_text(said, "$.author.role"), F.lit("")), F.lit("other"))
    flat = nodes.where(_is(said, "OBJECT")).select(
        "cid", "node", _text(n, "$.parent").alias("parent"), role.alias("type"), _seconds(said, "$.create_time").alias("own_ts"), _node_body(F.try_variant_get(said, "$.content", "variant")).alias("body"),
        F.nullif(_text(said, "$.metadata.model_slug"), F.lit("")).alias("model"), F.when(role == "tool", F.nullif(_text(said, "$.author.name"), F.lit(""))).alias("tool_name"),
    )
    flat = flat.where("body <> '' OR type = 'tool'")
    spans = flat.groupBy("cid").agg(F.min("own_ts").alias("lo"), F.max("own_ts").alias("hi"))
    created, updated = _seconds(v, "$.create_time"), _seconds(v, "$.update_time")
    timed = one.join(spans, "cid", "left").select("cid", "path", F.coalesce(created, updated, "lo").alias("first_ts"), F.coalesce(updated, created, "hi").alias("last_ts"))
    faults = faults.unionByName(timed.where("first_ts IS NULL OR last_ts IS NULL").select("path", F.lit("no usable times").alias("reason")))
    timed = timed.where("first_ts IS NOT NULL AND last_ts IS NOT NULL")
    if since:
        timed = timed.where(F.col("last_ts") >= F.lit(since))
    prefixed = lambda c: F.concat(F.lit("chatgpt:"), c)
    there = flat.select("cid", F.col("node").alias("parent"), F.lit(True).alias("has_parent"))
    rows = flat.join(timed, "cid").join(there, ["cid", "parent"], "left")
    observations = rows.select(
        prefixed("node").alias("obs_id"), prefixed("cid").alias("session_id"), prefixed("cid").alias("root_session_id"), F.when(F.col("has_parent"), prefixed("parent")).alias("parent_obs_id"), "type",
        F.coalesce("own_ts", "first_ts").alias("ts"), "model", F.lit(None).cast("long").alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"), "tool_name",
        F.lit(None).cast("string").alias("tool_use_id"), "body", author(F.col("type"), F.col("body")).alias("provenance"),
    )
    return _session_rows(timed, prefixed("cid"), "chatgpt"), observations, faults


def _session_rows(timed: DataFrame, key: Column, origin: str) -> DataFrame:
    nulls = [F.lit(None).cast("string").alias(c) for c in _MISSING]
    return timed.select(key.alias("session_id"), key.alias("root_session_id"), F.lit("session").alias("kind"), "first_ts", "last_ts", F.col("path").alias("jsonl_path"), F.lit(origin).alias("origin"), *nulls)


def _block_body(block: Column) -> Column:
    inner = F.try_variant_get(block, "$.content", "array<variant>")
    texts = F.array_join(F.transform(F.filter(inner, lambda b: _is(b, "OBJECT")), lambda b: F.coalesce(_text(b, "$.text"), F.lit(""))), "\n")
    given = F.try_variant_get(block, "$.input", "variant")
    used = F.coalesce(F.to_json(given), F.lit(""))
    return F.when(_text(block, "$.type") == "tool_use", used).otherwise(F.coalesce(_text(block, "$.content"), texts, F.lit("")))


def message_list(files: DataFrame, since: datetime | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, observations, faults) of exports whose conversations list messages; tool blocks are rows of their own."""
    every, bad = conversations(files)
    v = F.col("v")
    named = every.withColumn("cid", F.nullif(_text(v, "$.uuid"), F.lit(""))).withColumn("messages", F.try_variant_get(v, "$.chat_messages", "array<variant>"))
    broken = named.where("cid IS NULL OR messages IS NULL").select("path", F.when(F.col("cid").isNull(), "conversation without an id").otherwise("no list of messages").alias("reason"))
    one = first_claim_wins(named.where("cid IS NOT NULL AND messages IS NOT NULL"), "cid", "modified", "path", "at")
    times = F.transform("messages", lambda m: parse_time(_text(m, "$.created_at")))
    first = F.coalesce(parse_time(_text(v, "$.created_at")), F.array_min(times))
    last = F.coalesce(parse_time(_text(v, "$.updated_at")), F.array_max(times), first)
    timed = one.withColumn("first_ts", first).withColumn("last_ts", last)
    faults = bad.unionByName(broken).unionByName(timed.where("first_ts IS NULL").select("path", F.lit("no usable times").alias("reason")))
    timed = timed.where("first_ts IS NOT NULL")
    if since:
        timed = timed.where(F.col("last_ts") >= F.lit(since))
    prefixed = lambda c: F.concat(F.lit("claude-web:"), c)
    m = F.col("m")
    sender = F.coalesce(F.nullif(_text(m, "$.sender"), F.lit("")), F.lit("other"))
    for old, new in _SENDERS.items():
        sender = F.when(sender == old, new).otherwise(sender)
    blocks = F.filter(F.coalesce(F.try_variant_get(m, "$.content", "array<variant>"), F.array().cast("array<variant>")), lambda b: _is(b, "OBJECT"))
    text = lambda b: F.when(_text(b, "$.type") == "text", _text(b, "$.text")).when(_text(b, "$.type") == "thinking", F.coalesce(F.nullif(_text(b, "$.thinking"), F.lit("")), _text(b, "$.text")))
    joined = F.array_join(F.filter(F.transform(blocks, text), lambda t: t.isNotNull() & (t != "")), "\n\n")
    parent = _text(m, "$.parent_message_uuid")
    messages = timed.select("cid", "first_ts", F.explode("messages").alias("m")).where(F.coalesce(_text(m, "$.uuid"), F.lit("")) != "")
    flat = messages.select(
        "cid", _text(m, "$.uuid").alias("mid"), F.when((parent != "") & ~F.startswith(parent, F.lit(_NO_PARENT)), parent).alias("parent"), sender.alias("type"),
        F.coalesce(parse_time(_text(m, "$.created_at")), "first_ts").alias("ts"), F.coalesce(F.nullif(joined, F.lit("")), _text(m, "$.text"), F.lit("")).alias("body"),
        F.try_variant_get(m, "$.content", "array<variant>").alias("blocks"),
    )
    tools = flat.select("cid", "mid", "ts", F.posexplode("blocks").alias("i", "b")).where(F.coalesce(_text(F.col("b"), "$.type"), F.lit("")).isin("tool_use", "tool_result"))
    b = F.col("b")
    kind = _text(b, "$.type")
    common = lambda df: df.select(
        prefixed("id").alias("obs_id"), prefixed("cid").alias("session_id"), prefixed("cid").alias("root_session_id"), prefixed("parent").alias("parent_obs_id"), "type", "ts",
        F.lit(None).cast("string").alias("model"), F.lit(None).cast("long").alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"), "tool_name", "tool_use_id", "body",
        author(F.col("type"), F.col("body")).alias("provenance"),
    )
    tool_rows = tools.select(
        "cid", F.concat("mid", F.lit(":b"), F.col("i")).alias("id"), F.col("mid").alias("parent"), kind.alias("type"), F.coalesce(parse_time(_text(b, "$.start_timestamp")), "ts").alias("ts"),
        F.when(kind == "tool_use", _text(b, "$.name")).alias("tool_name"), F.when(kind == "tool_use", _text(b, "$.id")).otherwise(_text(b, "$.tool_use_id")).alias("tool_use_id"), _block_body(b).alias("body"),
    )
    has_tools = F.exists(F.coalesce("blocks", F.array().cast("array<variant>")), lambda x: F.coalesce(_text(x, "$.type"), F.lit("")).isin("tool_use", "tool_result"))
    turns = flat.where((F.col("body") != "") | has_tools).select("cid", F.col("mid").alias("id"), "parent", "type", "ts", F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_use_id"), "body")
    return _session_rows(timed, prefixed("cid"), "claude-web"), common(turns).unionByName(common(tool_rows)), faults
