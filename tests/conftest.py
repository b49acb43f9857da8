"""One session for all tests, and tables that try an operator's edges."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.driver.memory", "6g")
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_rows():
    """Compares a query's rows with those of its SQL in DuckDB, columns by name, rows in any order."""
    import duckdb

    def plain(v):
        if isinstance(v, float):
            return None if v != v else float(f"{v:.9g}")
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v

    def rows(table):
        names = sorted(table.column_names)
        return names, sorted(repr([plain(x) for x in r]) for r in zip(*(table.column(c).to_pylist() for c in names), strict=True))

    def compare(df, sql: str, sf_dir: str) -> None:
        con = duckdb.connect()
        for p in Path(sf_dir).glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
        assert rows(df.toArrow()) == rows(con.sql(sql).to_arrow_table())

    return compare
