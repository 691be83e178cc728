"""Shared helpers: table access, and tables written to the folder all executors see."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import kernel as K
from quillmark.workspace import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return table(spark, sf_dir, "documents")


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that Python gets at once.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python end at BATCH_BYTES in this session, not at Spark's 64 MB, unless it has a bound of its own."""
    if spark.conf.get(_BYTES) == "67108864b":
        spark.conf.set(_BYTES, f"{BATCH_BYTES}b")


@contextlib.contextmanager
def _set(spark: SparkSession, **conf: str) -> Iterator[None]:
    names = {"tidy": _TIDY, "batch": _BATCH}
    before = {names[k]: spark.conf.get(names[k], None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str, batch: int = 1000) -> DataFrame:
    """df as a Parquet table in the shared folder: a lost executor costs no recomputation of what came before.

    Shuffle files of the write go when it ends, as nothing reads them again. Python gets batches of so many rows at most.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _set(spark, tidy="true", batch=str(batch)):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: By module: how to drop what its operators keep in a worker between tasks.
REMEMBERED: dict[str, Callable[[], None]] = {}


def forget_others(owner: str) -> None:
    for module, forget in REMEMBERED.items():
        if module != owner:
            forget()


def give_back() -> None:
    K.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tidied(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """scan for mapInArrow that drops what other operators remember and gives freed memory back when a task ends.

    Python workers live on from stage to stage and share an executor's memory.
    """

    owner = scan.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        yield from scan(batches)
        give_back()

    return run


def discard(df: DataFrame) -> None:
    """Remove the folder of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ids_are_keys(docs: DataFrame) -> bool:
    """Is doc_id a number that is never null and never repeats?"""
    number = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return number and docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()


def keyed(docs: DataFrame, whole: bool = False, by_id: bool | None = None) -> DataFrame:
    """doc_id, text (null: empty) and key, a long that tells rows apart; if whole, also row, all columns as a struct.

    The key is doc_id itself where ids_are_keys (by_id, if the caller has asked). Else rows are numbered and written once,
    so that a task that runs again meets the same numbers.
    """
    rows = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    base = docs.select(F.col("doc_id"), text_of().alias("text"), *rows)
    if ids_are_keys(docs) if by_id is None else by_id:
        return base.withColumn("key", F.col("doc_id").cast("long"))
    return written(base.withColumn("key", F.monotonically_increasing_id()), "keyed")


def spread(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that a clash or an odd type in another column does no harm."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])
