"""Every query of the engine against its SQL; streaming against batch; plans."""

from __future__ import annotations

import pytest
from conftest import duck, same_rows
from pyspark.sql import functions as F

from tidelog.plans.catalog import ORACLES, QUERIES
from tidelog.operators import state
from tidelog.sources import logs, wal
from tidelog.streaming import live


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        same_rows(duck(sf_dir), ORACLES[name], df)
    else:
        assert df.count() > 0


def test_varint_of_large_ids(spark, tmp_path):
    """Larger tables have ids whose numbers exceed a long, then 64 bits; the SQL has a result up to 209,089."""
    ids = [0, 1, 99_999, 209_089, 209_090, 263_436, 263_437, 599_999, 5_999_999, 2**40, 2**63 - 1]
    spark.createDataFrame([(x,) for x in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: (r["bytes"], r["back"]) for r in QUERIES["kv_varint"](spark, str(tmp_path)).collect()}
    want = {x: x**3 * 1009 % 2**64 for x in ids}
    assert got == {x: (len(wal.put_varint(n)), n - 2**64 if n >= 2**63 else n) for x, n in want.items()}
    assert [got[x][0] for x in (209_089, 209_090)] == [9, 10] and got[209_089][1] == 209_089**3 * 1009


def test_filters_reach_the_scan(spark, sf_dir, tmp_path):
    logs.events_log(spark, sf_dir).write.parquet(f"{tmp_path}/log")
    v = spark.read.parquet(f"{tmp_path}/log")
    plan = state.scan(v, "1", "2", 500)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,1)" in plan and "LessThan(key,2)" in plan and "LessThanOrEqual(seq,500)" in plan
    assert "WindowGroupLimit" in plan


def test_stream_of_batches(spark, sf_dir, tmp_path):
    log = logs.events_log(spark, sf_dir)
    log.repartition(4).write.parquet(f"{tmp_path}/log")
    log.limit(50).write.mode("append").parquet(f"{tmp_path}/log")  # repeated versions
    stream = live.read_log_stream(spark, f"{tmp_path}/log", log.schema, 1)
    live.append_batches(stream, f"{tmp_path}/all", f"{tmp_path}/cp")
    kept = state.visible(spark.read.parquet(f"{tmp_path}/all").drop("batch"))
    want = state.visible(log)
    assert sorted(map(tuple, kept.select("key", "seq", "value").collect())) == sorted(map(tuple, want.select("key", "seq", "value").collect()))


def test_number_batches(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("t")).repartition(5)
    got = logs.number_batches(df, "t").orderBy("t").collect()
    assert [r["seq"] for r in got] == list(range(1, 1001))
    assert logs.number_batches(df.limit(0), "t").count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
