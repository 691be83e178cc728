"""Polls of open tasks, and what follows from two of them.

A poll is three tables: the open tasks it saw, the projects it covered, and whether it is complete. The service lists open
tasks only, so that a task is done shows as its absence alone, and absence says so only where the poll has looked: in a
project that it covered, by a poll that is complete. Anything else is kept as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.sources.transcripts import _is

# Keys (without case and _) that say that a payload goes on elsewhere.
PAGING_KEYS = ("nextpagetoken", "nextcursor", "hasmore", "nextpage")


@dataclass(frozen=True)
class Poll:
    """tasks(raw, project_id, project_name), covered(project_id), complete(complete): one row."""

    tasks: DataFrame
    covered: DataFrame
    complete: DataFrame


def _word(v: Column, path: str) -> Column:
    return F.nullif(F.btrim(F.try_variant_get(v, path, "string")), F.lit(""))


def read_poll(lines: DataFrame) -> Poll:
    """The poll of lines(value), each a JSON object:

    {"projects": [{"id", "name"}, ..]}                  the listing
    {"project": {"id", "name"}, "tasks": [..], ..}      what a project holds (tasks may lie in "data")
    {"projectId": .., "error": ..}                      a project that couldn't be read
    anything else                                       a task

    A project is covered if the listing names it and its payload has a list of task objects and no key that says there is
    more; an empty list counts. The poll is complete if the listing names projects, all with an id, and all are covered. A
    poll of tasks alone covers the projects that its tasks name, and is complete if it has any. Repeated lines count once.
    """
    v = F.col("v")
    read = lines.select("value", F.try_parse_json("value").alias("v"))
    listed, paid = _is(F.try_variant_get(v, "$.projects", "variant"), "ARRAY"), _is(F.try_variant_get(v, "$.project", "variant"), "OBJECT")
    failed = F.try_variant_get(v, "$.error", "variant").isNotNull() & (_word(v, "$.id").isNull())
    kind = F.when(listed, "listing").when(paid, "payload").when(failed, "failed").otherwise("task")
    read = read.withColumn("kind", F.coalesce(kind, F.lit("task")))
    entry = F.explode_outer(F.try_variant_get(v, "$.projects", "array<variant>")).alias("e")
    named = read.where("kind = 'listing'").select(entry).select(_word(F.col("e"), "$.id").alias("project_id"))
    found = F.coalesce(F.try_variant_get(v, "$.tasks", "variant"), F.try_variant_get(v, "$.data.tasks", "variant"))
    keys = F.map_filter(F.coalesce(F.from_json("value", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, x: F.replace(F.lower(k), F.lit("_"), F.lit("")).isin(*PAGING_KEYS) & ~F.coalesce(x, F.lit("")).isin("", "false", "null", "0", "[]", "{}"))
    more = F.size(F.map_keys(keys)) > 0
    payloads = read.where("kind = 'payload'").select(_word(v, "$.project.id").alias("project_id"), _word(v, "$.project.name").alias("project_name"), F.when(_is(found, "ARRAY"), F.try_variant_get(found, "$", "array<variant>")).alias("tasks"), more.alias("more"))
    whole = F.col("tasks").isNotNull() & ~F.col("more") & F.forall(F.coalesce("tasks", F.array().cast("array<variant>")), lambda t: F.coalesce(_is(t, "OBJECT"), F.lit(False)))
    payloads = payloads.withColumn("whole", F.coalesce(whole, F.lit(False)))
    inside = payloads.select("project_id", "project_name", F.explode("tasks").alias("t")).select(F.to_json("t").alias("raw"), "project_id", "project_name")
    bare = read.where("kind = 'task'").select(F.col("value").alias("raw"), _word(v, "$.projectId").alias("project_id"), _word(v, "$.projectName").alias("project_name"))
    tasks = inside.unionByName(bare)
    covered = named.join(payloads.groupBy("project_id").agg(F.bool_and("whole").alias("whole")).where("whole"), "project_id", "left_semi").distinct()
    by_name = bare.where(_is(F.try_parse_json("raw"), "OBJECT")).select(F.coalesce("project_id", "project_name").alias("project_id")).where("project_id IS NOT NULL").distinct()
    formal = ~read.where("kind <> 'task'").select(F.lit(1)).exists()  # tasks alone
    covered = covered.union(by_name.where(formal))
    counts = named.join(covered.withColumn("ok", F.lit(True)), "project_id", "left").agg(F.count("*").alias("n"), F.count("ok").alias("ok"))
    alone = read.agg((F.count_if(F.col("kind") != "task") == 0).alias("alone"), (F.count_if(F.col("kind") == "failed") == 0).alias("fine"), F.count("*").alias("lines"))
    complete = counts.select("n", "ok", alone.select("alone").scalar().alias("alone"), alone.select("fine").scalar().alias("fine"), alone.select("lines").scalar().alias("lines"))
    return Poll(tasks, covered, complete.select(F.when(F.col("alone"), F.col("lines") > 0).otherwise(F.col("fine") & (F.col("n") > 0) & (F.col("n") == F.col("ok"))).alias("complete")))


def poll_diff(before: DataFrame, polled: DataFrame, covered: DataFrame, complete: Column) -> DataFrame:
    """task_id, project_id, fate of each task of before(task_id, project_id, missed_at) or polled(task_id, project_id).

    open      in both                              new       only in the poll
    completed absent, its project covered          retained  absent, its project not covered, and told of before
    missed    as retained, for the first time      kept      any task of before, and
    ignored   any new task, by a poll that isn't complete: nothing follows from it

    project_id is the poll's where it has the task. A project that isn't known is not covered. Ids are different on each side.
    """
    b, p = before.alias("b"), polled.select("task_id", "project_id").alias("p")
    joined = b.join(p, F.col("b.task_id") == F.col("p.task_id"), "full_outer")
    flat = joined.select(
        F.coalesce("b.task_id", "p.task_id").alias("task_id"), F.col("b.task_id").isNotNull().alias("was"), F.col("p.task_id").isNotNull().alias("there"),
        F.when(F.col("p.task_id").isNotNull(), F.col("p.project_id")).otherwise(F.col("b.project_id")).alias("project_id"), F.col("b.missed_at").alias("missed_at"),
    )
    seen = flat.join(covered.select("project_id").distinct().withColumn("covers", F.lit(True)), "project_id", "left")
    fate = F.when(~complete, F.when(F.col("was"), "kept").otherwise("ignored")).when(F.col("was") & F.col("there"), "open").when(F.col("there"), "new").when(F.col("covers"), "completed").when(F.col("missed_at").isNotNull(), "retained").otherwise("missed")
    return seen.select("task_id", "project_id", fate.alias("fate"))
