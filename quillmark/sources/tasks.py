"""Tasks from backup CSV files and from the API's JSON, as records with the same words for status and priority."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.scalar import parse_time
from quillmark.sources.splits import csv_pieces
from quillmark.sources.transcripts import _is, _text

# Fixed values.
STATUS_TAGS = {"0": "open", "2": "completed", "-1": "abandoned"}
UNKNOWN_STATUS = "status-unrecognised"
PRIORITIES = {"0": "none", "1": "low", "3": "medium", "5": "high"}
REQUIRED = {"taskId", "Title", "Status"}
MAX_PREAMBLE_ROWS = 20
_USED = ("taskId", "Title", "Content", "Tags", "List Name", "Folder Name", "Status", "Priority", "Created Time", "Completed Time", "Due Date", "Start Date", "Repeat", "parentId")


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each piece of CSV, numbered by piece and place; most pieces are one row."""
    for df in batches:
        out = []
        for path, modified, row, text in zip(df["path"], df["modified"], df["row"], df["text"], strict=True):
            out += [(path, modified, row, at, cells) for at, cells in enumerate(csv.reader(io.StringIO(text, newline="")))]
        yield pd.DataFrame(out, columns=["path", "modified", "row", "at", "cells"])


def parse_backups(files: DataFrame) -> DataFrame:
    """path, modified, lost and the used columns of each row of files(path, modified, value), or of lines(path, modified, split, at, raw).

    The header is the first row, within a few, that has the required columns; lost counts a file's rows without an id. Rows
    are put together from lines, so no task holds a file; a file without rows has none.
    """
    if "value" in files.columns:
        files = files.select("path", "modified", F.lit(0).cast("long").alias("split"), F.posexplode(F.split("value", "\n")).alias("at", "raw"))
    text = F.when(F.col("row") == 0, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text"))
    found = csv_pieces(files).select("path", "modified", "row", text.alias("text")).mapInPandas(_cells, "path string, modified timestamp, row long, at int, cells array<string>")
    place = F.struct("row", "at")
    first = found.where(F.col("row") < MAX_PREAMBLE_ROWS).select("path", place.alias("place"), "cells")  # a piece is a row at least
    number = F.row_number().over(Window.partitionBy("path").orderBy("place"))
    heads = first.withColumn("number", number).where((F.col("number") <= MAX_PREAMBLE_ROWS) & F.forall(F.array(*[F.lit(c) for c in sorted(REQUIRED)]), lambda c: F.array_contains("cells", c)))
    heads = heads.groupBy("path").agg(F.min("place").alias("head"), F.min_by("cells", "place").alias("header"))
    at = lambda c: F.size("header") - F.array_position(F.reverse("header"), c)  # noqa: E731  of columns of one name the last counts
    cell = lambda c: F.when(F.array_contains("header", c), F.get("cells", at(c)))
    rows = found.join(F.broadcast(heads), "path").where((place > F.col("head")) & (F.size("cells") > 0))  # a row for each file
    rows = rows.select("path", "modified", *[cell(c).alias(c.replace(" ", "_").lower()) for c in _USED])
    sound = F.coalesce(F.col("taskid"), F.lit("")) != ""
    lost = rows.groupBy("path").agg(F.count_if(~sound).alias("lost"))
    return rows.where(sound).join(F.broadcast(lost), "path").select("path", "modified", "lost", *[c.replace(" ", "_").lower() for c in _USED])


def _mapped(value: Column, table: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value), otherwise)


def status_tag(status: Column) -> Column:
    return _mapped(status, STATUS_TAGS, F.lit(UNKNOWN_STATUS))


def priority_name(value: Column) -> Column:
    text = F.coalesce(F.nullif(F.btrim(value), F.lit("")), F.lit("0"))
    return _mapped(text, PRIORITIES, text)


def date_text(value: Column) -> Column:
    """One spelling for an instant; what can't be read stays as it is."""
    text = F.coalesce(F.btrim(value), F.lit(""))
    return F.when(text == "", "").otherwise(F.coalesce(F.date_format(parse_time(text), "yyyy-MM-dd'T'HH:mm:ssxx"), text))


def _blank(value: Column) -> Column:
    return F.btrim(F.coalesce(value, F.lit("")))


def csv_records(rows: DataFrame) -> DataFrame:
    """Records of parsed backup rows: the status alone says whether a task is done."""
    status = F.coalesce(F.nullif(_blank(F.col("status")), F.lit("")), F.lit("0"))
    own = F.filter(F.transform(F.split(_blank(F.col("tags")), ","), lambda t: F.btrim(t)), lambda t: t != "")
    more = F.filter(F.array(_blank(F.col("list_name")), _blank(F.col("folder_name"))), lambda t: t != "")
    created, done = parse_time(F.col("created_time")), parse_time(F.col("completed_time"))
    extra = F.to_json(F.struct(
        F.lit("csv").alias("provenance"), status.alias("status"), priority_name(F.col("priority")).alias("priority"), date_text(F.col("due_date")).alias("due_date"),
        date_text(F.col("start_date")).alias("start_date"), _blank(F.col("repeat")).alias("repeat"), _blank(F.col("parentid")).alias("parent_id"), F.col("path").alias("source_file"),
    ))
    return rows.select(
        F.concat(F.lit("ticktick:"), "taskid").alias("stable_id"), F.lit("ticktick").alias("source"), F.coalesce(F.nullif(_blank(F.col("title")), F.lit("")), "taskid").alias("subject"),
        F.coalesce("content", F.lit("")).alias("body"), F.concat(own, more, F.array(status_tag(status))).alias("tags"), created.alias("created_at"), F.coalesce(done, created).alias("updated_at"), extra.alias("extra"),
    )


def api_records(tasks: DataFrame, completed_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, faults) of tasks(raw, project_name) and perhaps project_id, which serves where a task doesn't name its own.

    completed_at names a column: then the completions are inferred.
    """
    owner = F.coalesce("project_id", F.lit("")) if "project_id" in tasks.columns else F.lit("")
    v = F.col("v")
    any_text = lambda path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    seen = tasks.withColumn("v", F.try_parse_json("raw")).withColumn("task_id", F.when(_is(v, "OBJECT"), F.nullif(F.btrim(any_text("$.id")), F.lit(""))))
    given = F.try_variant_get(v, "$.tags", "array<string>")
    listed = F.coalesce(given, F.split(any_text("$.tags"), ","))
    tags = F.filter(F.transform(listed, lambda t: F.btrim(t)), lambda t: t.isNotNull() & (t != ""))
    project = F.filter(F.array(_blank(F.col("project_name"))), lambda t: t != "")
    status = F.lit("2") if completed_at else F.coalesce(F.nullif(F.btrim(any_text("$.status")), F.lit("")), F.lit("0"))
    items = F.transform(F.try_variant_get(v, "$.items", "array<variant>"), lambda i: F.btrim(F.coalesce(_text(i, "$.title"), F.try_variant_get(i, "$", "string"), F.lit(""))))
    lines = F.transform(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda t: t != ""), lambda t: F.concat(F.lit("- "), t))
    body = F.array_join(F.filter(F.concat(F.array(any_text("$.content"), any_text("$.desc")), lines), lambda t: F.btrim(t) != ""), "\n")
    created = parse_time(_text(v, "$.createdTime"))
    updated = F.coalesce(*([F.col(completed_at)] if completed_at else []), parse_time(_text(v, "$.modifiedTime")), parse_time(_text(v, "$.completedTime")), created)
    extra = [
        F.lit("api-inferred-complete" if completed_at else "api").alias("provenance"), status.alias("status"), priority_name(any_text("$.priority")).alias("priority"), date_text(any_text("$.dueDate")).alias("due_date"),
        date_text(any_text("$.startDate")).alias("start_date"), any_text("$.repeatFlag").alias("repeat"), any_text("$.parentId").alias("parent_id"), F.coalesce(F.nullif(any_text("$.projectId"), F.lit("")), owner).alias("project_id"),
        *([F.coalesce("project_name", F.lit("")).alias("project_name")] if "project_id" in tasks.columns else []),
    ]
    if completed_at:
        extra.append(F.lit("true").alias("completed_time_approx"))
    good = seen.where("task_id IS NOT NULL").select(
        F.concat(F.lit("ticktick:"), "task_id").alias("stable_id"), F.lit("ticktick").alias("source"), F.coalesce(F.nullif(F.btrim(any_text("$.title")), F.lit("")), "task_id").alias("subject"), body.alias("body"),
        F.concat(tags, project, F.array(status_tag(status))).alias("tags"), created.alias("created_at"), updated.alias("updated_at"), F.to_json(F.struct(*extra)).alias("extra"),
    )
    return good, seen.where("task_id IS NULL").select("raw", F.lit("task without an id").alias("reason"))
