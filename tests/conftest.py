from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), os.environ.get("PYTHONPATH", "")) if x)
os.environ.setdefault("TZ", "UTC")

from pyspark.sql import SparkSession  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.maxMetadataStringLength", "2000").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoint')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    at = TESTDATA / "sf0.001"
    if not at.exists():
        pytest.skip("no test tables")
    return str(at)


def duck(sf_dir: str):
    """A DuckDB connection with the tables as views."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def same_rows(con, sql: str, df) -> None:
    import duckdb

    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    want = sorted(map(repr, rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want
