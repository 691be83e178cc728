"""Documents of a file tree, posts from zip files, reports and proposals: one record a file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import heading
from quillmark.sources.html import read_html
from quillmark.sources.splits import json_elements

# Fixed values.
EXTENSIONS = ("md", "txt", "docx", "pdf")
JUNK_DIRS = ("node_modules", "__pycache__", "venv", "dist", "build", "target")
MAX_BYTES = 20 << 20
BODY_CHARS = 200_000
LEAST_PDF_CHARS = 50
STUB_BYTES = 200
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extract(extension: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, fault) of a file. A pdf whose text can't be reached, as no pdf library is at hand, is a fault."""
    try:
        if extension in ("md", "txt"):
            return data.decode("utf-8", "replace"), None
        if extension == "docx":
            tree = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
            paragraphs = ["".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in tree.iter(f"{_WORD}p")]
            return "\n".join(p for p in paragraphs if p.strip()), None
        try:
            from pypdf import PdfReader
        except ImportError:
            return None, "no pdf reader is installed"
        text = "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)
        return (text, None) if len(text) >= LEAST_PDF_CHARS else (None, None)
    except Exception as e:  # a file that can't be read is reported and the rest goes on
        return None, f"{type(e).__name__}: {e}"


def scan_tree(spark: SparkSession, root: str, since: datetime | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, relative, extension, modified, content of the files to read; dates and sizes are tested before any is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if since:
        reader = reader.option("modifiedAfter", since.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S"))
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    relative = F.regexp_replace("path", r"^[a-z]+:/*" + re.escape(base) + "/", "")
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    pruned = "|".join(map(re.escape, (*JUNK_DIRS, *exclude)))
    files = reader.load(root).where(F.col("length") <= MAX_BYTES).select("path", relative.alias("relative"), extension.alias("extension"), F.col("modificationTime").alias("modified"), "content")
    return files.where(F.col("extension").isin(*EXTENSIONS) & ~F.rlike("relative", F.lit(rf"(^|/)(\.[^/]*|{pruned})(/|$)")))


def tree_records(files: DataFrame, source: str = "dropbox") -> tuple[DataFrame, DataFrame]:
    """(records, faults) of scanned files."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = [extract(e, bytes(c)) for e, c in zip(df["extension"], df["content"], strict=True)]
            yield pd.DataFrame({"path": df["path"], "relative": df["relative"], "extension": df["extension"], "modified": df["modified"], "text": [f[0] for f in found], "fault": [f[1] for f in found]})

    read = files.mapInPandas(scan, "path string, relative string, extension string, modified timestamp, text string, fault string")
    stem = F.regexp_extract("relative", r"([^/]+?)(\.[^./]*)?$", 1)
    top = F.when(F.contains("relative", F.lit("/")), F.substring_index("relative", "/", 1))
    cut = F.length("text") > BODY_CHARS
    records = read.where("text IS NOT NULL").select(
        F.concat(F.lit(f"{source}:"), "relative").alias("stable_id"), F.lit(source).alias("source"), F.coalesce(heading(F.col("text")), stem).alias("subject"), F.left("text", F.lit(BODY_CHARS)).alias("body"),
        F.array_compact(F.array(top, F.col("extension"))).alias("tags"), F.col("modified").alias("created_at"), F.col("modified").alias("updated_at"),
        F.to_json(F.struct(F.col("relative").alias("path"), cut.alias("truncated"))).alias("extra"),
    )
    return records, read.where("fault IS NOT NULL").select("path", F.col("fault").alias("reason"))


def report_records(spark: SparkSession, root: str, source: str, since: datetime | None = None) -> DataFrame:
    """Records of the *.md files right in root, changed after since; folders below it, quarantine included, are never read."""
    reader = spark.read.option("pathGlobFilter", "*.md")
    if since:
        reader = reader.option("modifiedAfter", since.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S"))
    files = reader.text(f"{root.rstrip('/')}/*.md", wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1)
    found = files.select(name.alias("name"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    return found.select(
        F.concat(F.lit(f"{source}:"), "name").alias("stable_id"), F.lit(source).alias("source"), F.coalesce(heading(F.col("text")), "name").alias("subject"), F.col("text").alias("body"),
        F.array(F.lit(source)).alias("tags"), F.col("modified").alias("created_at"), F.col("modified").alias("updated_at"), F.to_json(F.struct("name")).alias("extra"),
    )


def zip_members(files: DataFrame, pattern: str) -> DataFrame:
    """path, modified, member, at, data of the members of zip files(path, modified, content) whose names match."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for path, modified, content in zip(df["path"], df["modified"], df["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    rows = []
                    for at, info in enumerate(z.infolist()):
                        if re.search(pattern, info.filename):
                            when = datetime(*info.date_time, tzinfo=UTC)
                            rows.append((path, modified, info.filename, at, modified if info.date_time == (1980, 1, 1, 0, 0, 0) else pd.Timestamp(when), z.read(info)))
                    yield pd.DataFrame(rows, columns=["path", "modified", "member", "at", "written", "data"])

    return files.mapInPandas(scan, "path string, modified timestamp, member string, at int, written timestamp, data binary")


def post_records(zips: DataFrame) -> DataFrame:
    """Records of the posts in export zips: the newest zip's copy of each, short ones tagged as stubs."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            read = [read_html(bytes(d).decode("utf-8", "replace")) for d in df["data"]]
            yield df.drop(columns=["data"]).assign(title=[r[0] for r in read], body=[r[1] for r in read])

    from quillmark.operators.joins import first_claim_wins

    pages = zip_members(zips, r"(^|/)posts/[^/]+\.html$").mapInPandas(scan, "path string, modified timestamp, member string, at int, written timestamp, title string, body string")
    stem = F.regexp_extract("member", r"([^/]+)\.html$", 1)
    number = F.regexp_extract(stem, r"^(\d+)(?:\.(.*))?$", 1)
    slug = F.regexp_extract(stem, r"^(\d+)(?:\.(.*))?$", 2)
    posts = first_claim_wins(pages.withColumn("post_id", F.when(number != "", number).otherwise(stem)).withColumn("slug", slug), "post_id", "modified", "path", "at")
    named = F.array_join(F.transform(F.filter(F.split("slug", "-"), lambda w: w != ""), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), " ")
    tags = F.array_compact(F.array(F.lit("substack"), F.lit("published"), F.when(F.octet_length("body") < STUB_BYTES, "stub")))
    return posts.select(
        F.concat(F.lit("substack:"), "post_id").alias("stable_id"), F.lit("substack").alias("source"), F.coalesce(F.nullif("title", F.lit("")), F.nullif(named, F.lit("")), "post_id").alias("subject"), "body",
        tags.alias("tags"), F.col("written").alias("created_at"), F.col("written").alias("updated_at"), F.to_json(F.struct("post_id", "slug", "member")).alias("extra"),
    )


def export_files(spark: SparkSession, *roots: str) -> DataFrame:
    """path, modified, first, value of bare *.json exports, an element a row, and of whole JSON members of *.zip in the given folders."""
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(list(roots)).select("path", F.col("modificationTime").alias("modified"), "content")
    bare = json_elements(spark.read.option("pathGlobFilter", "*.json"), list(roots))
    packed = zip_members(zips, r"\.json$").select(F.concat("path", F.lit("!"), "member").alias("path"), "modified", F.lit(0).cast("long").alias("first"), F.decode("data", "utf-8").alias("value"))
    return bare.unionByName(packed)


def sniff_exports(files: DataFrame, shape: str) -> DataFrame:
    """Values of those export files whose first conversation has the shape: 'node_map' or 'message_list'."""
    head = F.try_variant_get(F.try_parse_json("value"), "$[0]", "variant")
    key = {"node_map": "$.mapping", "message_list": "$.chat_messages"}[shape]
    has = F.try_variant_get(head, key, "variant").isNotNull()
    if "first" not in files.columns:
        return files.where(has)
    return files.join(files.where((F.col("first") == 0) & has).select("path"), "path", "left_semi").select(*files.columns)


def inputs_of(spark: SparkSession, root: str) -> DataFrame:
    """path, modified of all files below root, none of which is opened; no rows if there is no such place."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, modified timestamp")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("modificationTime").alias("modified"))


def newest_input(files: DataFrame) -> DataFrame:
    return files.agg(F.max("modified").alias("newest"))
