from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", shared.as_uri()).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple]:
    """Rows in a form that compares across engines: columns by name, numbers rounded, rows sorted."""

    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return f"{round(float(v), 6):g}"
        if hasattr(v, "__iter__") and not isinstance(v, (str, bytes)):
            return str([plain(x) for x in v])
        if isinstance(v, (int, bool)) or type(v).__module__ == "numpy":
            return f"{float(v):g}" if float(v) < 1e6 else str(int(v))
        return str(v)

    return sorted(tuple(plain(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))
