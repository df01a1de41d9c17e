import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def same():
    """Compare a query with its SQL twin as multisets of rows."""
    import duckdb
    import numpy as np
    import pandas as pd

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")

    def text(v):
        if isinstance(v, (list, np.ndarray)):
            return "[" + ",".join(map(text, v)) + "]"
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        return repr(round(float(v), 5)) if isinstance(v, float) else str(v)

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        return sorted(df.columns), sorted(tuple(map(text, r)) for r in df.itertuples(index=False, name=None))

    return lambda got, sql: rows(got.toPandas()) == rows(con.execute(sql).fetchdf())
