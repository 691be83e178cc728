"""Pull requests and issues from search hits (one JSON object a row), each endpoint's frame on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.scalar import parse_time
from quillmark.operators.joins import newest_wins
from quillmark.sources.transcripts import _is, _text

SUBJECT_CHARS = 280


def _two_segments(tail: Column) -> Column:
    parts = F.filter(F.split(tail, "/"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1))))


def repository(v: Column) -> Column:
    """owner/name from the API's address of the repository, else from the page's; null if neither says it."""
    after = lambda text, mark: F.when(F.contains(text, F.lit(mark)), F.substring_index(text, mark, -1) if mark == "/repos/" else F.regexp_extract(text, r"github\.com/(.*)$", 1))
    return F.coalesce(_two_segments(after(_text(v, "$.repository_url"), "/repos/")), _two_segments(after(_text(v, "$.html_url"), "github.com/")))


def records(hits: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(records, faults) of hits(raw); kind is 'pr' or a word for the sort of issue. Rows without a repository are faults."""
    v = F.col("v")
    seen = hits.withColumn("v", F.try_parse_json("raw")).withColumn("repo", F.when(_is(v, "OBJECT"), repository(v)))
    number, state, body = F.coalesce(F.try_variant_get(v, "$.number", "bigint"), F.lit(0)), _text(v, "$.state"), F.coalesce(_text(v, "$.body"), F.lit(""))
    tags = [F.col("repo"), F.lit("pr" if kind == "pr" else "issue"), F.coalesce(state, F.lit("unknown")), *([] if kind == "pr" else [F.lit(kind)])]
    extra = [F.col("repo"), number.alias("number"), state.alias("state"), _text(v, "$.user.login").alias("author"), _text(v, "$.html_url").alias("url")]
    if kind == "pr":
        extra += [_text(v, "$._checks.summary").alias("checks"), F.lit("pr").alias("kind")]
    else:
        logins = F.transform(F.try_variant_get(v, "$.assignees", "array<variant>"), lambda a: _text(a, "$.login"))
        extra += [F.coalesce(logins, F.array().cast("array<string>")).alias("assignees"), F.lit(f"issue-{kind}").alias("kind")]
    good = seen.where("repo IS NOT NULL").select(
        F.concat(F.lit("github:"), "repo", F.lit(":"), number).alias("stable_id"), F.lit("github").alias("source"), F.left(F.coalesce(_text(v, "$.title"), F.lit("")), F.lit(SUBJECT_CHARS)).alias("subject"),
        body.alias("body"), F.array(*tags).alias("tags"), parse_time(_text(v, "$.created_at")).alias("created_at"), parse_time(_text(v, "$.updated_at")).alias("updated_at"), F.to_json(F.struct(*extra)).alias("extra"),
    )
    label = F.coalesce(_text(v, "$.html_url"), _text(v, "$.url"), F.concat(F.lit("number="), number))
    return good, seen.where("repo IS NULL").select(label.alias("row"), F.lit("no repository in the hit").alias("reason"))


def all_endpoints(frames: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Records and faults of several endpoints by kind; of an item that two of them have, the last updated stays."""
    made = [records(df, kind) for kind, df in frames.items()]
    good, bad = made[0]
    for g, b in made[1:]:
        good, bad = good.unionByName(g), bad.unionByName(b)
    return newest_wins(good, "stable_id", F.coalesce("updated_at", "created_at"), F.col("extra")), bad


def since_filter(since: str | None) -> str:
    """What a live search adds to its query: day granularity."""
    return f" updated:>={since[:10]}" if since else ""
