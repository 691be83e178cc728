"""Large files read by many tasks each: lines with their numbers, and the elements of JSON arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, Window
from pyspark.sql import functions as F


def numbered_lines(reader: DataFrameReader, paths: str | list[str]) -> DataFrame:
    """path, lineno (from 1), raw of every line below paths; a line ends at \\n, and a \\r before it is no part of it.

    A file is read in splits, each by a task that holds one line at a time. A line knows its split and its place there;
    its number is its place after the lines of the file's earlier splits, which one pass over the files counts first (a row
    for each split). Files that change in between are misnumbered: read them when they are at rest.
    """
    lines = reader.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"),
    )
    splits = lines.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("path", "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = lines.join(starts, ["path", "split"])
    return numbered.select("path", (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias("lineno"), F.regexp_replace("raw", r"\r$", "").alias("raw"))


def _before(sums: DataFrame, value: str) -> DataFrame:
    """path, split and what the splits of the file before it sum up to, as value."""
    w = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("path", "split", F.coalesce(F.sum(value).over(w), F.lit(0)).alias(f"before_{value}"))


def _with_sums(pieces: DataFrame, value: str) -> DataFrame:
    """pieces with so_far_<value>: the sum of value over the pieces of the file before each."""
    own = Window.partitionBy("path", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy("path", "split").agg(F.sum(value).alias(value))
    joined = pieces.join(_before(totals, value), ["path", "split"])
    return joined.withColumn(f"so_far_{value}", F.col(f"before_{value}") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop(f"before_{value}")


def _opened(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    return F.regexp_count(text, F.lit(r"[\[{]")) - F.regexp_count(text, F.lit(r"[\]}]"))


def file_lines(reader: DataFrameReader, paths: str | list[str]) -> DataFrame:
    """path, modified, split, at, raw of every line: where it lies by its split and its place there."""
    return reader.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"),
    )


_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)'


def csv_pieces(lines: DataFrame) -> DataFrame:
    """path, modified, row (from 0), text of the rows of CSV files of any size, of lines(path, modified, split, at, raw).

    A line that begins inside quotes goes on with the row before it. Whether it does depends on all lines before: a line
    leaves that as it was, turns it, or settles it, so it follows from the last line that settled it and the number of turns
    since, running sums within the splits and then over their totals.
    """
    inside = lambda text: (~F.rlike(text, F.lit(f"^{_FIELD}(?:,{_FIELD})*+$"))).cast("int")  # noqa: E731  at the end of a text that begins outside
    lines = lines.withColumns({"a": inside(F.col("raw")), "b": inside(F.concat(F.lit('"'), "raw"))}).withColumn("turn", ((F.col("a") == 1) & (F.col("b") == 0)).cast("int"))
    lines = _with_sums(lines, "turn").withColumn("settled", F.when(F.col("a") == F.col("b"), (F.col("a") + F.col("so_far_turn")) % 2))
    over = lambda w, by: w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.groupBy("path", "split").agg(F.max_by("settled", F.when(F.col("settled").isNotNull(), F.col("at"))).alias("end"))
    ends = ends.select("path", "split", F.last("end", True).over(over(Window.partitionBy("path"), "split")).alias("before"))
    last = F.coalesce(F.last("settled", True).over(over(Window.partitionBy("path", "split"), "at")), F.col("before"), F.lit(0))
    lines = lines.join(ends, ["path", "split"]).withColumn("begins", (last + F.col("so_far_turn")) % 2)
    lines = lines.withColumn("done", (F.when(F.col("begins") == 0, F.col("a")).otherwise(F.col("b")) == 0).cast("int"))
    lines = _with_sums(lines, "done")
    parts = F.array_sort(F.collect_list(F.struct("split", "at", "raw")))
    return lines.groupBy("path", "modified", F.col("so_far_done").alias("row")).agg(F.array_join(F.transform(parts, lambda p: p["raw"]), "\n").alias("text"))


def json_elements(reader: DataFrameReader, paths: str | list[str]) -> DataFrame:
    """path, modified, first (from 0), value of every element of the JSON arrays in files of any size; value is an array of that one.

    A file is cut at its commas and read in splits by many tasks. Whether a piece begins inside a string follows from the
    number of quotes before it, how deep it is from the brackets before it outside strings, and its element from the commas
    before it at depth 1: three running sums, each within the splits and then over their totals (a row for each split). The
    file is scanned for each sum; a task holds pieces, and then elements, but never a file. A file that is no array, or is
    cut off, gives elements that don't parse. Nothing is written in between, as texts are still unredacted here.
    """
    pieces = reader.option("lineSep", ",").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"),
    )
    plain = F.regexp_replace("raw", r"(?s)\\.", "")
    bare = lambda text: F.regexp_replace(text, r'(?s)"[^"]*("|$)', "")  # noqa: E731  what is outside of strings
    after_string = F.regexp_replace(plain, r'(?s)^[^"]*("|$)', "")
    pieces = pieces.withColumns({"quotes": F.regexp_count(plain, F.lit('"')), "d0": _opened(bare(plain)), "d1": _opened(bare(after_string))})
    pieces = _with_sums(pieces, "quotes").withColumn("depth", F.when(F.col("so_far_quotes") % 2 == 1, F.col("d1")).otherwise(F.col("d0"))).drop("d0", "d1")
    pieces = _with_sums(pieces, "depth")
    ends = F.col("so_far_depth") + F.col("depth")
    outside = (F.col("so_far_quotes") + F.col("quotes")) % 2 == 0
    pieces = pieces.withColumn("cut", (outside & (ends == 1)).cast("int")).withColumn("closed", outside & (ends == 0))
    pieces = _with_sums(pieces, "cut")
    parts = F.array_sort(F.collect_list(F.struct("split", "at", "raw")))
    whole = pieces.groupBy("path", "modified", F.col("so_far_cut").alias("first")).agg(F.array_join(F.transform(parts, lambda p: p["raw"]), ",").alias("text"), F.bool_or("closed").alias("last"))
    begun = F.when(F.col("first") == 0, F.regexp_replace("text", r"^[\s\x{FEFF}]*\[", "")).otherwise(F.col("text"))
    text = F.when(F.col("last"), F.regexp_replace(begun, r"\]\s*$", "")).otherwise(begun)
    return whole.select("path", "modified", "first", text.alias("element")).where(F.btrim("element") != "").select("path", "modified", "first", F.concat(F.lit("["), "element", F.lit("]")).alias("value"))
