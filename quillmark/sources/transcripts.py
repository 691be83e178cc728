"""Session transcripts: JSONL files, one event a line, subagents in folders of their own.

Lines are parsed as VARIANT, so unknown keys and wrong types are nulls and not failures. Corrupt lines become faults.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.authorship import author
from quillmark.functions.scalar import parse_time
from quillmark.sources.splits import numbered_lines

# Fixed values.
LINE_TYPES = (
    "user", "assistant", "tool_use", "tool_result", "system", "attachment", "progress", "queue-operation", "last-prompt", "hook",
    "file-history-snapshot", "rate_limit_event", "permission-mode",
)
TOOL_INPUT_CHARS = 4096
CUT = " …[truncated]"
AGENT_ID = r"agentId: ([A-Za-z0-9_-]+)"
LIVE_MINUTES = 5


def read_lines(spark: SparkSession, root: str, modified_before: datetime | None = None, modified_after: datetime | None = None) -> DataFrame:
    """path, lineno, raw of every non-blank line of *.jsonl under root.

    Files changed since modified_before are live and left; those not changed since modified_after were read before.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    if modified_before:
        reader = reader.option("modifiedBefore", _utc(modified_before))
    if modified_after:
        reader = reader.option("modifiedAfter", _utc(modified_after))
    return numbered_lines(reader, root).where(F.btrim("raw") != "")


def _utc(t: datetime) -> str:
    return (t.astimezone(UTC) if t.tzinfo else t).strftime("%Y-%m-%dT%H:%M:%S")


def _at(value: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(value) if isinstance(value, str) else value, path, kind)


def _is(value: Column, kind: str) -> Column:
    return F.startswith(F.coalesce(F.schema_of_variant(value), F.lit("VOID")), F.lit(kind))


def _text(value: Column, path: str) -> Column:
    """The string at the path; null if there is none or it isn't a string."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(_is(found, "STRING"), F.try_variant_get(value, path, "string"))


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects: path, lineno, v; faults: path, lineno, reason)."""
    seen = lines.withColumn("v", F.try_parse_json("raw"))
    reason = F.when(F.col("v").isNull(), "corrupt JSON").when(~_is(F.col("v"), "OBJECT"), "not an object")
    marked = seen.withColumn("reason", reason)
    return marked.where("reason IS NULL").select("path", "lineno", "v"), marked.where("reason IS NOT NULL").select("path", "lineno", "reason")


def _result_text(block: Column) -> Column:
    whole = _text(block, "$.content")
    inner = F.try_variant_get(block, "$.content", "array<variant>")
    texts = F.filter(F.transform(inner, lambda b: F.when(_text(b, "$.type") == "text", _text(b, "$.text"))), lambda t: t.isNotNull())
    return F.coalesce(whole, F.get(texts, F.lit(0)), F.lit(""))


def _tool_text(block: Column) -> Column:
    name, given = F.coalesce(_text(block, "$.name"), F.lit("")), F.try_variant_get(block, "$.input", "variant")
    payload = F.to_json(given)
    payload = F.when(F.length(payload) > TOOL_INPUT_CHARS, F.concat(F.left(payload, F.lit(TOOL_INPUT_CHARS)), F.lit(CUT))).otherwise(payload)
    return F.when(given.isNull(), name).otherwise(F.btrim(F.concat(name, F.lit(" "), payload)))


def flatten(message: Column) -> Column:
    """body, tool_name, tool_use_id, has_result of a message: the first block that gives text, and the first tool."""
    blocks = F.coalesce(F.try_variant_get(message, "$.content", "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda b: F.coalesce(_text(b, "$.type"), F.lit(""))
    text = lambda b: (
        F.when(kind(b) == "text", _text(b, "$.text")).when(kind(b) == "tool_use", _tool_text(b)).when(kind(b) == "tool_result", _result_text(b))
        .when(kind(b) == "thinking", F.coalesce(_text(b, "$.text"), _text(b, "$.thinking")))
    )
    first = lambda f: F.get(F.filter(F.transform(blocks, f), lambda x: x.isNotNull() & (x != "")), F.lit(0))
    return F.struct(
        F.coalesce(_text(message, "$.content"), first(text), F.lit("")).alias("body"),
        first(lambda b: F.when(kind(b) == "tool_use", _text(b, "$.name"))).alias("tool_name"),
        first(lambda b: F.when(kind(b) == "tool_use", _text(b, "$.id")).when(kind(b) == "tool_result", _text(b, "$.tool_use_id"))).alias("tool_use_id"),
        F.exists(blocks, lambda b: kind(b) == "tool_result").alias("has_result"),
    )


def _structure(v: Column) -> dict[str, Column]:
    """What a line says of who wrote it, beside its type and text."""
    return {
        "is_sidechain": _at(v, "$.isSidechain", "boolean"), "is_meta": _at(v, "$.isMeta", "boolean"), "is_compact_summary": _at(v, "$.isCompactSummary", "boolean"),
        "prompt_source": _text(v, "$.promptSource"), "origin_kind": _text(v, "$.origin.kind"),
    }


def structure(objects: DataFrame) -> DataFrame:
    """obs_id and the structural fields of lines that have an id."""
    found = objects.select(_text(F.col("v"), "$.uuid").alias("obs_id"), *[c.alias(k) for k, c in _structure(F.col("v")).items()])
    return found.where("coalesce(obs_id, '') <> ''")


def fields(objects: DataFrame) -> DataFrame:
    """Typed fields of lines that have a session and an id."""
    v = F.col("v")
    raw = F.coalesce(_text(v, "$.type"), F.lit("other"))
    known = F.when(raw.isin(*LINE_TYPES), raw).otherwise("other")
    m = objects.withColumn("flat", flatten(F.try_variant_get(v, "$.message", "variant"))).withColumn("known", known)
    kind = F.when((F.col("known") == "assistant") & F.col("flat.tool_name").isNotNull(), "tool_use").when((F.col("known") == "user") & F.col("flat.has_result"), "tool_result").otherwise(F.col("known"))
    typed = m.withColumn("type", kind)
    out = typed.select(
        "path", "lineno", _text(v, "$.sessionId").alias("sid"), _text(v, "$.uuid").alias("obs_id"), _text(v, "$.parentUuid").alias("parent_obs_id"), parse_time(_text(v, "$.timestamp")).alias("ts"),
        "type", _text(v, "$.agentId").alias("line_agent"), _text(v, "$.agentType").alias("line_agent_type"), _text(v, "$.cwd").alias("cwd"), _text(v, "$.gitBranch").alias("git_branch"),
        _text(v, "$.message.model").alias("model"), _at("v", "$.message.usage.input_tokens", "bigint").alias("input_tokens"), _at("v", "$.message.usage.output_tokens", "bigint").alias("output_tokens"),
        F.col("flat.tool_name").alias("tool_name"), F.col("flat.tool_use_id").alias("tool_use_id"), F.col("flat.body").alias("body"),
        author(F.col("type"), F.col("flat.body"), **_structure(v)).alias("provenance"),
    )
    return out.where("coalesce(sid, '') <> '' AND coalesce(obs_id, '') <> ''")


def dominant(lines: DataFrame) -> DataFrame:
    """file, sid: the session that most lines name, the greater name of equals."""
    counts = lines.groupBy("file", "sid").agg(F.count("*").alias("n"))
    return counts.groupBy("file").agg(F.max_by("sid", F.struct("n", "sid")).alias("sid"))


def owners(typed: DataFrame) -> DataFrame:
    """path, owner: the file's stem where a line names it, else the dominant session."""
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    named = typed.where(F.col("sid") == stem).select("path", F.col("sid").alias("named")).distinct()
    most = dominant(typed.select(F.col("path").alias("file"), "sid")).select(F.col("file").alias("path"), F.col("sid").alias("most"))
    return most.join(named, "path", "left").select("path", F.coalesce("named", "most").alias("owner"))


def is_subagent(path: str = "path") -> Column:
    return F.rlike(path, F.lit(r"/subagents/[^/]+\.jsonl$"))


def spawn_index(objects: DataFrame) -> DataFrame:
    """parent, agent_id, spawned_by: which tool call of a top session started which subagent.

    The structured field of a result line beats the id in its text.
    """
    v = F.col("v")
    blocks = F.coalesce(F.try_variant_get(v, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    results = F.filter(blocks, lambda b: _text(b, "$.type") == "tool_result")
    call = F.get(F.filter(F.transform(results, lambda b: _text(b, "$.tool_use_id")), lambda x: x.isNotNull()), F.lit(0))
    said = F.regexp_extract(F.array_join(F.transform(results, _result_text), ""), AGENT_ID, 1)
    structured = _text(v, "$.toolUseResult.agentId")
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    found = objects.where(~is_subagent()).select(
        _text(v, "$.sessionId").alias("parent"), stem.alias("stem"), F.coalesce(F.nullif(structured, F.lit("")), F.nullif(said, F.lit(""))).alias("agent_id"),
        call.alias("call"), F.coalesce(structured != "", F.lit(False)).alias("sure"), "lineno",
    )
    found = found.where("parent = stem AND agent_id IS NOT NULL AND call IS NOT NULL")
    order = F.struct(F.col("sure"), F.when(F.col("sure"), F.col("lineno")).otherwise(-F.col("lineno")))
    return found.groupBy("parent", "agent_id").agg(F.max_by("call", order).alias("spawned_by"))


def entities(lines: DataFrame, since: datetime | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, observations, faults) of the lines of transcript files.

    A file's lines of other sessions than its owner's are copies of a resumed session and are left. Lines without a
    time are dropped and counted as a fault; a session that ended before since is left.
    """
    objects, faults = parse(lines)
    typed = fields(objects)
    own = typed.join(owners(typed), "path").where("sid = owner")
    by_line = Window.partitionBy("path")
    sub = is_subagent()
    parent = F.nullif(F.regexp_extract("path", r"([^/]+)/subagents/[^/]+\.jsonl$", 1), F.lit(""))
    file_agent = F.nullif(F.regexp_extract("path", r"/subagents/agent-([^/]+)\.jsonl$", 1), F.lit(""))
    agent = F.when(sub, F.coalesce(file_agent, F.min_by("line_agent", F.when(F.col("line_agent").isNotNull(), F.col("lineno"))).over(by_line)))
    placed = own.withColumn("agent_id", agent).withColumn("parent", F.when(sub, parent))
    placed = placed.where(~sub | F.col("agent_id").isNotNull())
    key = F.when(F.col("agent_id").isNull(), F.col("sid")).otherwise(F.concat(F.coalesce("parent", F.lit("orphan")), F.lit(":"), "agent_id"))
    placed = placed.withColumn("session_id", key).withColumn("root_session_id", F.when(F.col("agent_id").isNull(), F.col("sid")).otherwise(F.coalesce("parent", key)))
    undated = placed.where("ts IS NULL").groupBy("path").agg(F.count("*").alias("n")).select("path", F.lit(None).cast("int").alias("lineno"), F.concat("n", F.lit(" lines without a time")).alias("reason"))
    dated = placed.where("ts IS NOT NULL")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c) != "", F.lit(False)), F.col("lineno"))).alias(c)
    grouped = placed.groupBy("path", "session_id", "root_session_id", "agent_id", "parent").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), first("cwd"), first("git_branch"), first("line_agent_type"))
    grouped = grouped.where("last_ts IS NOT NULL")
    if since:
        grouped = grouped.where(F.col("last_ts") >= F.lit(since))
    started = grouped.join(spawn_index(objects), ["parent", "agent_id"], "left")
    sessions = started.select(
        "session_id", "root_session_id", F.col("parent").alias("parent_session_id"), F.when(F.col("agent_id").isNull(), "session").otherwise("subagent").alias("kind"), "agent_id",
        F.when(F.col("agent_id").isNotNull(), F.col("line_agent_type")).alias("agent_type"), F.col("spawned_by").alias("spawned_by_tool_use_id"), "cwd", "git_branch", "first_ts", "last_ts",
        F.col("path").alias("jsonl_path"), F.lit("claude-code").alias("origin"),
    )
    kept = dated.join(grouped.select("path", "session_id"), ["path", "session_id"], "left_semi")
    observations = kept.select("obs_id", "session_id", "root_session_id", "parent_obs_id", "type", "ts", "model", "input_tokens", "output_tokens", "tool_name", "tool_use_id", "body", "provenance")
    return sessions, observations, faults.unionByName(undated)
