import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp())
        .config("spark.checkpoint.dir", tempfile.mkdtemp())
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_rows():
    """Whether a frame has the rows of DuckDB SQL over the same tables, as multisets."""
    import duckdb
    import numpy as np
    import pandas as pd

    def text(v):
        if isinstance(v, list | tuple | np.ndarray):
            return "[" + ",".join(map(text, v)) + "]"
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "null"
        if isinstance(v, float | np.floating):
            return repr(round(float(v), 9))
        return str(v)

    def rows(pdf):
        return sorted("|".join(map(text, r)) for r in pdf[sorted(pdf.columns)].astype(object).values.tolist())

    def check(df, sql, folder):
        con = duckdb.connect()
        for f in Path(folder).glob("*.parquet"):
            con.execute(f"create view {f.stem} as select * from '{f}'")
        got, want = df.toPandas(), con.execute(sql).df()
        whole = {c for c, kind in df.dtypes if kind in ("bigint", "int")}  # with nulls, pandas has them as floats
        got, want = (x.astype({c: "Int64" for c in x.columns if c in whole and x[c].dtype.kind == "f"}) for x in (got, want))
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return check
