"""A training corpus from raw documents: classify, deduplicate, decontaminate, mix, and write token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm.common import documents, table, written
from quillmark.llm.decontaminate import decontaminate
from quillmark.llm.mixing import mixed_documents
from quillmark.llm.near_dedup import near_deduplicated
from quillmark.llm.quality import good_documents
from quillmark.llm.token_output import default_tokenizer, read_index, write_tokens

#: Words in a shingle of the near_dedup stage; the 2 of op3 is that query's own.
SHINGLE = 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by shingles of five words, stays: the one with the smallest id."""
    return near_deduplicated(docs, SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix draws them."""
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and their index."""
    return read_index(write_tokens(docs, default_tokenizer()))


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
    ("tokens", tokenize),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
