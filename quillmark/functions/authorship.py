"""Who composed an observation: one ordered chain of conditions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
AGENT_ORIGIN_KINDS = ("task-notification", "coordinator", "peer")
AGENT_MARKERS = ("<task-notification>",)
COMMAND_MARKERS = ("<command-name>", "<local-command-stdout>", "<local-command-caveat>")
HOOK_MARKERS = (
    "You are watching a Claude Code session",
    "Your context was just cleared to make room",
    "You also asked yourself to focus on this first",
    "You are a classifier",
)
SYSTEM_MARKERS = ("<system-reminder>", "This session is being continued from a previous")
SYSTEM_PREFIXES = ("[Request interrupted", "API Error")


def _holds(text: Column, markers: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(m)) for m in markers])


def author(
    obs_type: Column, body: Column, session_kind: Column | None = None, is_sidechain: Column | None = None, is_meta: Column | None = None,
    is_compact_summary: Column | None = None, prompt_source: Column | None = None, origin_kind: Column | None = None,
) -> Column:
    """human, agent, hook, command or system. Structural columns that are null or not given say nothing.

    Type decides first, then structure, then marks in the body; what is left of the user's channel is human.
    """
    no, none = F.lit(False), F.lit(None).cast("string")
    flag = lambda c: F.coalesce(c.cast("boolean"), no) if c is not None else no
    said = lambda c: c if c is not None else none
    text = F.coalesce(body, F.lit(""))
    agent = F.coalesce(said(session_kind) == "subagent", no) | flag(is_sidechain) | F.coalesce(said(origin_kind).isin(*AGENT_ORIGIN_KINDS), no)
    opening = F.regexp_replace(text, r"^[\s\x{1c}-\x{1f}\x{85}]+", "")
    return (
        F.when(obs_type.isin("assistant", "tool_use"), "agent")
        .when(obs_type == "hook", "hook")
        .when(obs_type.isNull() | (obs_type != "user"), "system")
        .when(agent, "agent")
        .when(flag(is_meta) | flag(is_compact_summary) | F.coalesce(said(prompt_source) == "system", no), "system")
        .when(F.coalesce(said(prompt_source) == "sdk", no), "hook")
        .when(_holds(text, AGENT_MARKERS), "agent")
        .when(_holds(text, COMMAND_MARKERS), "command")
        .when(_holds(text, HOOK_MARKERS), "hook")
        .when(_holds(text, SYSTEM_MARKERS), "system")
        .when(reduce(or_, [F.startswith(opening, F.lit(p)) for p in SYSTEM_PREFIXES]), "system")
        .otherwise("human")
    )
