from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sluicegate.session import build_session

    session = build_session("tests", "local[4]", spark__driver__memory="4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """A DuckDB connection with the driver's views for one folder."""
    import duckdb

    def connect(folder: str):
        con = duckdb.connect()
        for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{folder}/{name}.parquet'")
        return con

    return connect


@pytest.fixture(scope="session")
def same_rows():
    """Whether two pandas frames hold the same rows under the same names."""
    import math

    def normal(frame):
        rows = frame[sorted(frame.columns)].astype(object).values.tolist()
        plain = lambda v: "null" if v is None else "nan" if isinstance(v, float) and math.isnan(v) else str(v) if isinstance(v, (str, bool)) or type(v).__name__ == "bool_" else float(v)
        return sorted(tuple(map(str, map(plain, r))) for r in rows)

    return lambda a, b: sorted(a.columns) == sorted(b.columns) and normal(a) == normal(b)
