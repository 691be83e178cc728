"""Tables as Parquet folders under one root, with numbered manifests that say what each version is made of.

A table is a base and some deltas: rows that later commits have added or replaced. A small commit thus writes its own
rows only; readers take the last version of each key, and after a few deltas a commit writes them into a new base.
Tables with texts have an index beside them, one segment of postings for each base and delta.

A commit writes new folders first and then a file with the whole manifest, which it gives the next number's name; that
fails if another writer was there first. Readers see all of it or nothing, and a writer that dies on the way leaves no
number behind. Cursors are part of the manifest: rows and cursor move together. What no manifest of the last days and of
the last few versions names is removed, so a reader that holds a version keeps its files that long.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.model import INDEXED, KEYS, SCHEMA_VERSION, TABLES, TOKENIZER_VERSION
from quillmark.operators.postings import OPTIONS, TERM_OPTIONS, TextIndex, postings, terms

#: Deltas of a table before they are merged into its base, and manifests whose folders stay.
MOST_DELTAS, KEPT_VERSIONS = 8, 3
#: Manifests and folders younger than this stay too, whatever names them.
KEPT_SECONDS = 2 * 86400


TERMS = "token string, df long, low string, high string"


def _terms_of(index: str) -> str:
    """The folder of the terms of an index segment."""
    table, name = index.split("/")
    return f"{table.removesuffix('-index')}-terms/{name}"


class StoreError(RuntimeError):
    """The store is newer than this code, or another writer was first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, kept_seconds: float = KEPT_SECONDS):
        self.spark, self.root, self.kept_seconds = spark, root.rstrip("/"), kept_seconds
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._path(name)

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_manifest/{name}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _versions(self) -> list[str]:
        return [n for n in self._names("_manifest") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self) -> dict:
        names = self._versions()
        found = self._load(names[-1]) if names else {"version": 0, "schema": SCHEMA_VERSION, "tokenizer": TOKENIZER_VERSION, "tables": {}, "cursors": {}}
        if found["schema"] > SCHEMA_VERSION:
            raise StoreError(f"the store has schema {found['schema']}, this code {SCHEMA_VERSION}")
        return found

    def ready(self) -> str | None:
        """Why the store can't be read, or None."""
        try:
            return None if self.manifest()["version"] else "nothing has been ingested yet"
        except StoreError as e:
            return str(e)

    def _parquet(self, table: str, path: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{path}")

    def read(self, table: str, manifest: dict | None = None) -> DataFrame:
        """The current version; columns that an older version lacks are null."""
        parts = (manifest or self.manifest())["tables"].get(table)
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        base = self._parquet(table, parts["base"]) if parts["base"] else self.spark.createDataFrame([], TABLES[table])
        if not parts["deltas"]:
            return base
        key = KEYS[table]
        deltas = None
        for n, path in enumerate(parts["deltas"]):
            one = self._parquet(table, path).withColumn("_n", F.lit(n))
            deltas = one if deltas is None else deltas.unionByName(one)
        last = deltas.groupBy(*key).agg(F.max_by(F.struct(*base.columns), "_n").alias("row")).select("row.*") if len(parts["deltas"]) > 1 else deltas.drop("_n")
        return base.join(deltas.select(*key), list(key), "left_anti").select(*base.columns).unionByName(last)

    def index(self, table: str) -> TextIndex | None:
        """The table's postings; a posting counts where the row still has the version (src_hash) that it carries."""
        parts = self.manifest()["tables"].get(table)
        if not parts or not parts["index"]:
            return None
        key, _, carry = INDEXED[table]
        every = self.spark.read.parquet(*[f"{self.root}/{p}" for p in parts["index"]])
        of = lambda p: self.spark.read.schema(every.schema).parquet(f"{self.root}/{p}")
        own = lambda p: self.spark.read.schema(TERMS).parquet(f"{self.root}/{_terms_of(p)}")
        whole = all(self._fs.exists(self._path(f"{self.root}/{_terms_of(p)}/_SUCCESS")) for p in parts["index"])  # older stores have none
        return TextIndex(every, key, carry, tuple((of(p), own(p)) for p in parts["index"]) if whole else ())

    def _write(self, table: str, df: DataFrame, kind: str) -> tuple[str, list[str]]:
        """The folder of df's rows, and of their postings."""
        name = f"{table}/{kind}-{uuid.uuid4().hex[:12]}"
        have = set(df.columns)
        filled = df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])
        if table in INDEXED and kind == "base":  # in order of the key, so that a few keys are in a few row groups
            filled = filled.repartitionByRange(*KEYS[table]).sortWithinPartitions(*KEYS[table])
        filled.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        if table not in INDEXED:
            return name, []
        return name, [self._write_index(table, self._parquet(table, name), kind)]

    def _write_index(self, table: str, rows: DataFrame, kind: str) -> str:
        key, texts, carry = INDEXED[table]
        name = f"{table}-index/{kind}-{uuid.uuid4().hex[:12]}"
        postings(rows, key, F.concat_ws(" ", *texts), carry, stem=True).write.options(compression="zstd", **OPTIONS).parquet(f"{self.root}/{name}")
        terms(self.spark.read.parquet(f"{self.root}/{name}")).write.options(compression="zstd", **TERM_OPTIONS).parquet(f"{self.root}/{_terms_of(name)}")
        return name

    def commit(self, tables: dict[str, DataFrame] | None = None, cursors: dict[str, str] | None = None, base: int | None = None, deltas: dict[str, DataFrame] | None = None) -> int:
        """A new version: tables replaced whole, deltas added, cursors moved. base is the version that the writer has read."""
        before = self.manifest()
        if base is not None and before["version"] != base:
            raise StoreError(f"version {base} was read, but {before['version']} is current")
        after = {"version": before["version"] + 1, "schema": SCHEMA_VERSION, "tokenizer": TOKENIZER_VERSION, "tables": {k: dict(v) for k, v in before["tables"].items()}, "cursors": before["cursors"] | (cursors or {})}
        for table, df in (tables or {}).items():
            path, index = self._write(table, df, "base")
            after["tables"][table] = {"base": path, "deltas": [], "index": index}
        for table, df in (deltas or {}).items():
            parts = after["tables"].get(table, {"base": None, "deltas": [], "index": []})
            path, index = self._write(table, df, "delta")
            after["tables"][table] = {"base": parts["base"], "deltas": [*parts["deltas"], path], "index": [*parts["index"], *index]}
            if len(after["tables"][table]["deltas"]) > MOST_DELTAS:
                path, index = self._write(table, self.read(table, after), "base")
                after["tables"][table] = {"base": path, "deltas": [], "index": index}
        self._publish(after)
        self._sweep()
        return after["version"]

    def _publish(self, manifest: dict) -> None:
        """Write the manifest aside and give it its number's name; whoever comes second finds the name taken."""
        jvm = self.spark.sparkContext._jvm
        path = self._path(f"{self.root}/_manifest/v{manifest['version']:012d}.json")
        aside = self._path(f"{self.root}/_manifest/.new-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            jvm.org.apache.commons.io.IOUtils.write(json.dumps(manifest), out, "UTF-8")
        finally:
            out.close()
        try:
            self._name(aside, path)
        except Exception as e:
            if self._fs.exists(path):
                raise StoreError("another writer has committed meanwhile") from e
            raise
        finally:
            self._fs.delete(aside, False)

    def _name(self, aside, path) -> None:
        """Give a file another name, which fails if the name is taken: a link on a local disk, a rename elsewhere."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        if self._fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(path), local(aside))
            return
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        none = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(aside, path, none)

    def _sweep(self) -> None:
        """Remove manifests that are neither recent nor among the last few, and old folders that none of the others names."""
        before = time.time() - self.kept_seconds
        listed = [s for s in self._fs.listStatus(self._path(f"{self.root}/_manifest")) if s.getPath().getName().endswith(".json")]
        listed.sort(key=lambda s: s.getPath().getName())
        gone = [s for s in listed[:-KEPT_VERSIONS] if s.getModificationTime() / 1000 < before]
        if not gone:
            return
        names = {s.getPath().getName() for s in gone}
        kept = [self._load(s.getPath().getName()) for s in listed if s.getPath().getName() not in names]
        named = {p for m in kept for t in m["tables"].values() for p in (t["base"], *t["deltas"], *t["index"], *map(_terms_of, t["index"])) if p}
        for folder in {p.split("/")[0] for p in named} | {f"{t}{x}" for t in TABLES for x in ("", "-index", "-terms")}:
            place = self._path(f"{self.root}/{folder}")
            for s in self._fs.listStatus(place) if self._fs.exists(place) else []:
                if f"{folder}/{s.getPath().getName()}" not in named and s.getModificationTime() / 1000 < before:
                    self._fs.delete(s.getPath(), True)  # also what a writer that lost or died has left
        for s in gone:
            self._fs.delete(s.getPath(), False)

    def reindex(self) -> int:
        """Indexes of all folders made anew beside the live ones, and swapped in one version; bodies are not written again.

        Queries answer from the old indexes until then. What is committed meanwhile is caught up with before the swap.
        """
        built: dict[str, str] = {}
        while True:
            now = self.manifest()
            folders = lambda m: {t: [p for p in (x["base"], *x["deltas"]) if p] for t, x in m["tables"].items() if t in INDEXED}
            for table, paths in folders(now).items():
                for path in paths:
                    if path not in built:
                        built[path] = self._write_index(table, self._parquet(table, path), "rebuilt")
            now = self.manifest()
            own = folders(now)
            if not all(p in built for paths in own.values() for p in paths):
                continue
            tables = {t: dict(x) | ({"index": [built[p] for p in own[t]]} if t in own else {}) for t, x in now["tables"].items()}
            try:
                self._publish(now | {"version": now["version"] + 1, "schema": SCHEMA_VERSION, "tokenizer": TOKENIZER_VERSION, "tables": tables})
            except StoreError:  # another commit: catch up with it
                continue
            self._sweep()
            return now["version"] + 1

    def migrate(self) -> bool:
        """Bring a store of older code up to this one: columns it lacks are read as null, indexes of another tokenizer are made anew."""
        now = self.manifest()
        if not now["version"] or (now["schema"] == SCHEMA_VERSION and now.get("tokenizer") == TOKENIZER_VERSION):
            return False
        if now.get("tokenizer") == TOKENIZER_VERSION:
            self._publish(now | {"version": now["version"] + 1, "schema": SCHEMA_VERSION})
        else:
            self.reindex()
        return True
