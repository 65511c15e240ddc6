"""Golden cases of reading versions."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidelog.model import VERSIONS
from tidelog.operators import compaction, lookup, state, transactions


def log(spark, rows):
    """rows: (key, seq, kind, value[, ord])."""
    return spark.createDataFrame([(k if isinstance(k, bytes) else k.encode(), s, r[0] if r else 0, kind, v.encode()) for k, s, kind, v, *r in rows], VERSIONS)


def pairs(df):
    return [(bytes(r["key"]).decode("latin1"), bytes(r["value"]).decode()) for r in df.collect()]


def value(df):
    got = [bytes(r["value"]).decode() for r in df.collect()]
    return got[0] if got else None


def test_snapshot_get(spark):
    v = log(spark, [("a", 10, 1, "1"), ("b", 11, 1, "2"), ("a", 12, 1, "3")])
    assert value(state.get(v, b"a", 10)) == "1"
    assert value(state.get(v, b"a", 12)) == "3"
    assert value(state.get(v, b"c", 99)) is None


def test_delete_visibility(spark):
    v = log(spark, [("k", 5, 1, "v1"), ("k", 7, 2, "")])
    assert [value(state.get(v, b"k", ts)) for ts in (6, 7, 100)] == ["v1", None, None]
    assert state.tombstones(v).count() == 1


def test_range_scan(spark):
    v = log(spark, [("a", 1, 1, "1"), ("b", 2, 1, "1"), ("c", 3, 1, "1"), ("b", 4, 1, "2"), ("c", 5, 2, "")])
    assert pairs(state.scan(v, b"a", b"z", 3)) == [("a", "1"), ("b", "1"), ("c", "1")]
    assert pairs(state.scan(v, b"a", b"z", 6)) == [("a", "1"), ("b", "2")]
    assert pairs(state.scan(v, b"b")) == [("b", "2")]
    assert pairs(state.scan(v, None, b"b")) == [("a", "1")]
    assert pairs(state.scan(v, b"x")) == []


def test_tombstone_over_run(spark):
    run, mem = log(spark, [("k", 1, 1, "old")]), log(spark, [("k", 2, 2, "")])
    both = compaction.union_runs([run, mem])
    assert value(state.get(both, b"k", 1)) == "old"
    assert value(state.get(both, b"k", 2)) is None


def test_future_only_key(spark):
    assert pairs(state.scan(log(spark, [("z", 9, 1, "1")]), ts=5)) == []


def test_last_of_a_batch_wins(spark):
    v = log(spark, [("a", 4, 1, "1", 0), ("a", 4, 1, "2", 1)])
    assert value(state.get(v, b"a")) == "2"
    assert value(state.newest_by_max(v, ["value"])) == "2"


def test_empty_key_and_value(spark):
    v = log(spark, [("", 1, 1, "x"), ("e", 2, 1, "")])
    assert pairs(state.scan(v)) == [("", "x"), ("e", "")]


def test_byte_order(spark):
    keys = [b"", b"\x7f", b"\x7f\x00", b"\x80", b"\xff"]
    v = log(spark, [(k, i + 1, 1, "v") for i, k in enumerate(random.Random(1).sample(keys, 5))])
    assert [bytes(r["key"]) for r in state.scan(v).collect()] == keys


@pytest.mark.parametrize("bottommost", [True, False])
def test_tombstones_go_only_from_the_bottom(spark, bottommost):
    v = log(spark, [("k", 1, 1, "old"), ("k", 2, 2, "")])
    assert compaction.compact([v], bottommost=bottommost).count() == (0 if bottommost else 1)


rows = st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 12), st.integers(1, 2), st.sampled_from("xyz")), max_size=14, unique_by=lambda r: (r[0], r[1]))


def model(rows, ts):
    out = {}
    for k, s, kind, v in sorted(rows, key=lambda r: r[1]):
        if s <= ts:
            out[k] = (kind, v)
    return sorted((k, v) for k, (kind, v) in out.items() if kind == 1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows, cut=st.integers(0, 14), mark=st.integers(0, 12))
def test_runs_replay_and_compaction_keep_snapshots(spark, rows, cut, mark):
    whole = log(spark, rows)
    split = [log(spark, rows[:cut]), log(spark, rows[cut:])]
    assert pairs(compaction.merge(split).orderBy("key")) == model(rows, 99)
    assert pairs(state.scan(whole.unionByName(whole))) == model(rows, 99)
    kept = compaction.collect_versions(whole, mark)
    for ts in (mark, 12):
        assert pairs(state.scan(kept, ts=ts)) == model(rows, ts)


def test_find_block_and_pruning(spark):
    index = spark.createDataFrame([(b"d",), (b"m",), (b"t",)], "last_key binary")
    probes = spark.createDataFrame([(k,) for k in (b"", b"a", b"d", b"e", b"t", b"z")], "key binary")
    got = {bytes(r["key"]): r["last_key"] and bytes(r["last_key"]) for r in lookup.find_block(probes, index).collect()}
    assert got == {b"": b"d", b"a": b"d", b"d": b"d", b"e": b"m", b"t": b"t", b"z": None}
    runs = spark.createDataFrame([(1, b"a", b"m"), (2, b"n", b"z")], "run_id long, min_key binary, max_key binary")
    assert sorted((bytes(r["key"]), r["run_id"]) for r in lookup.prune_runs(probes, runs).collect()) == [(b"a", 1), (b"d", 1), (b"e", 1), (b"t", 2), (b"z", 2)]


def test_conflicts_and_increments(spark):
    w = spark.createDataFrame([("k", 1, 5), ("k", 2, 6), ("k", 6, 9), ("j", 1, 7)], "key string, start long, commit long")
    assert [tuple(r) for r in transactions.write_conflicts(w).collect()] == [("k", 5, 6)]
    v = log(spark, [("c", 1, 1, ""), ("c", 2, 2, ""), ("c", 3, 1, ""), ("c", 4, 1, "")])
    assert [r["n"] for r in transactions.increments(v).collect()] == [2]


def test_compaction_policies():
    run = lambda i, n, level, a, b: {"run_id": i, "n_rows": n, "level": level, "min_key": a, "max_key": b, "max_seq": i}
    tiered = [run(i, n, 0, b"a", b"z") for i, n in enumerate([100, 10, 11, 12, 9])]
    assert [r["run_id"] for r in compaction.pick_size_tiered(tiered)] == [1, 2, 3, 4]
    assert compaction.pick_size_tiered(tiered[:3]) == []
    level = [run(i, 5, 0, b"c", b"f") for i in range(4)] + [run(9, 50, 1, b"a", b"d"), run(10, 50, 1, b"x", b"z")]
    picked, target = compaction.pick_leveled(level, 1000)
    assert target == 1 and [r["run_id"] for r in picked] == [0, 1, 2, 3, 9]
    assert compaction.pick_leveled(level[4:], 1000) is None


def test_greedy_groups(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.choice([1, 40, 99, 100, 101, 250])) for s in "ab" for i in range(400)]
    want, used, no, at = {}, 0, 0, None
    for s, i, n in rows:
        if s != at:
            at, used, no = s, 0, 0
        if used and used + n > 100:
            no, used = no + 1, 0
        used += n
        want[(s, i)] = no
    df = spark.createDataFrame(rows, "s string, i long, n long").repartition(3)
    assert {(r["s"], r["i"]): r["group_no"] for r in lookup.greedy_groups(df, "s", "i", "n", 100).collect()} == want


def test_find_block_grows_in_proportion(spark):
    import time

    from tidelog.operators import lookup

    def took(n: int) -> float:
        probes = spark.range(n).selectExpr("lpad(cast(id as string), 9, '0') key")
        index = spark.range(0, n, 10).selectExpr("lpad(cast(id as string), 9, '0') last_key")
        began = time.perf_counter()
        got = lookup.find_block(probes, index).selectExpr("count(*) n", "sum(if(last_key is null, 0, cast(last_key as long) - cast(key as long))) far", "count(if(last_key is null, 1, null)) none").first()
        assert got["n"] == n and got["none"] == 9 and got["far"] == 45 * (n // 10 - 1)
        return time.perf_counter() - began

    took(1000)
    assert took(80_000) < 5 * took(20_000) + 2


def test_find_block_with_a_hot_probe(spark):
    from tidelog.operators import lookup

    probes = spark.createDataFrame([("m",)] * 4000 + [("z",), ("a",), ("n",)], "key string")
    index = spark.createDataFrame([("m",), ("c",), ("p",)], "last_key string")
    got = {(r["key"], r["last_key"]): r["count"] for r in lookup.find_block(probes, index).groupBy("key", "last_key").count().collect()}
    assert got == {("m", "m"): 4000, ("z", None): 1, ("a", "c"): 1, ("n", "p"): 1}


def test_multi_get_with_more_probes_than_are_broadcast(spark, monkeypatch):
    from tidelog.operators import state

    log = spark.createDataFrame([(f"k{i % 50}", i, 0, 1 + (i % 7 == 0), str(i)) for i in range(500)], "key string, seq long, ord int, kind int, value string")
    probes = spark.createDataFrame([(f"k{i}",) for i in range(40, 60)] * 2, "key string")
    few = sorted(map(tuple, state.multi_get(probes, log).collect()), key=str)
    absent = sorted(map(tuple, state.absent(probes, log).collect()))
    monkeypatch.setattr(state, "PROBES", 3)
    assert sorted(map(tuple, state.multi_get(probes, log).collect()), key=str) == few and len(few) == 40
    assert sorted(map(tuple, state.absent(probes, log).collect())) == absent


def test_conflicts_equal_all_pairs(spark):
    import random

    from tidelog.operators import transactions

    rng = random.Random(5)
    rows = [(rng.choice("ab"), s := rng.randint(0, 300), s + rng.choice([1, 2, 3, 9, 64, 65, 1000])) for _ in range(300)] + [("a", 5, 5), ("a", None, 7), ("b", 3, None)]
    got = transactions.write_conflicts(spark.createDataFrame(rows, "key string, start long, commit long")).collect()
    full = [r for r in rows if None not in r]
    want = [(k, w, c) for k, s, c in full for j, _, w in rows if j == k and w is not None and s < w < c]
    assert sorted(map(tuple, got)) == sorted(want)
    assert transactions.write_conflicts(spark.createDataFrame([], "key string, start long, commit long")).count() == 0


def test_tables_are_discarded(spark):
    import pytest

    from tidelog.sources import shared

    df = shared.materialize(spark.range(5), "gone")
    assert df.count() == 5
    shared.discard(df)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(df._written_at).count()
