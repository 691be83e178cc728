"""Table schemas and closed value sets."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampType()
_TAGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RECORDS = _struct(stable_id=_S, source=_S, subject=_S, body=_S, tags=_TAGS, llm_tags=_TAGS, created_at=_TS, updated_at=_TS, extra=_S, src_hash=_S, llm_tags_src_hash=_S)
SESSIONS = _struct(
    session_id=_S, root_session_id=_S, parent_session_id=_S, kind=_S, agent_id=_S, agent_type=_S, spawned_by_tool_use_id=_S,
    cwd=_S, git_branch=_S, first_ts=_TS, last_ts=_TS, jsonl_path=_S, origin=_S, src_hash=_S,
)
OBSERVATIONS = _struct(
    obs_id=_S, session_id=_S, root_session_id=_S, parent_obs_id=_S, type=_S, ts=_TS, model=_S, input_tokens=_L, output_tokens=_L,
    tool_name=_S, tool_use_id=_S, body=_S, src_hash=_S, provenance=_S,
)
INGEST_STATE = _struct(source=_S, cursor_value=_S, cursor_kind=_S, last_run_at=_TS, last_ok_at=_TS, rows_seen=_L, consecutive_failures=_L, last_error=_S, next_attempt_at=_TS, input_at=_TS)
QUARANTINE = _struct(source=_S, record_key=_S, error_type=_S, error_detail=_S, attempts=_L, first_seen_at=_TS, last_seen_at=_TS, next_retry_at=_TS, payload=_S)
FAULTS = _struct(source=_S, fault_key=_S, scope=_S, scope_stamp=_S, reason=_S, detail=_S, record_count=_L, line=_L, first_seen_at=_TS, last_seen_at=_TS)

TABLES = {"records": RECORDS, "sessions": SESSIONS, "observations": OBSERVATIONS, "ingest_state": INGEST_STATE, "quarantine": QUARANTINE, "poison_faults": FAULTS}
STALE_TOLD = _struct(source=_S, input_at=_TS, threshold_seconds=_L)
MISSES = _struct(query=_S, at=_TS)
#: Tasks that the last complete poll left open; missed_at: absent since then, from polls that didn't cover the project.
OPEN_TASKS = _struct(source=_S, task_id=_S, project_id=_S, seen_at=_TS, missed_at=_TS, told_at=_TS)
#: Lines that someone is to read. batch and acked_at say which delivery carried them.
OUTBOX = _struct(source=_S, line_id=_S, kind=_S, line=_S, subject=_S, created_at=_TS, acked_at=_TS, batch=_S)
TABLES |= {"stale_told": STALE_TOLD, "misses": MISSES, "open_tasks": OPEN_TASKS, "outbox": OUTBOX}
KEYS = {
    "records": ("stable_id",), "sessions": ("session_id",), "observations": ("obs_id",), "ingest_state": ("source",), "quarantine": ("source", "record_key"),
    "poison_faults": ("source", "fault_key"), "stale_told": ("source", "input_at", "threshold_seconds"), "misses": ("query", "at"),
    "open_tasks": ("source", "task_id"), "outbox": ("line_id",),
}
#: Tables with an index: key, texts, and what postings carry.
INDEXED = {"records": ("stable_id", ("subject", "body"), ("src_hash",)), "observations": ("obs_id", ("body",), ("src_hash", "session_id", "root_session_id"))}
SCHEMA_VERSION, TOKENIZER_VERSION = 10, 2

# Fixed values.
KINDS = ("session", "subagent")
ORIGINS = ("claude-code", "chatgpt", "claude-web")
PROVENANCE = ("human", "agent", "hook", "command", "system")
MACHINE = ("agent", "hook", "command", "system")
SCOPES = ("observation", "session")
SESSION_SOURCES = ("sessions", "subagents", "observations", "chatgpt", "claude-web")
RECORD_SOURCES = ("dropbox", "github", "records", "research", "sota-watch", "substack", "ticktick")
RECORD_ONLY_KEYS = ("state", "check", "mergeable")
