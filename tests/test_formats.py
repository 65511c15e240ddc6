"""Codecs, checksums, filters, frames."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import bloom, codec
from tidelog.sources import tables, wal


def test_crc32c(spark):
    known = {b"123456789": 0xE3069283, b"": 0, bytes(32): 0x8A9136AA, b"\xff" * 32: 0x62A8AB43}
    assert {k: codec.crc32c_bytes(k) for k in known} == known
    df = spark.createDataFrame([(k,) for k in known], "b binary").select("b", codec.crc32c(F.col("b")).alias("c"))
    assert {bytes(r["b"]): r["c"] for r in df.collect()} == known


def test_fnv(spark):
    data = [b"", b"a", b"foobar", bytes(range(256))]
    df = spark.createDataFrame([(k,) for k in data], "b binary").select("b", codec.fnv1a64(F.col("b")).alias("h"))
    assert {bytes(r["b"]): (r["h"]["hi"] << 32) + r["h"]["lo"] for r in df.collect()} == {k: bloom.fnv64(k) for k in data}
    assert bloom.fnv64(b"a") == 0xAF63DC4C8601EC8C


def test_varint_vectors():
    assert [len(wal.put_varint(n)) for n in (0, 127, 128, 2**64 - 1)] == [1, 1, 2, 10]
    rng = random.Random(3)
    for _ in range(20_000):
        n = rng.getrandbits(rng.randint(1, 64))
        code = wal.put_varint(n)
        assert wal.get_varint(code, 0) == (n, len(code))
    with pytest.raises(wal.Corrupt):
        wal.get_varint(b"\x80", 0)
    with pytest.raises(wal.Corrupt):
        wal.get_varint(b"\xff" * 11, 0)


def test_varint_columns(spark):
    numbers = [0, 1, 127, 128, 16383, 16384, 2**35, 2**56, 2**63 - 1, -1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", codec.varint_encode(F.col("n")).alias("c"))
    got = df.select("n", "c", codec.varint_length(F.col("n")).alias("len"), codec.varint_decode(F.col("c")).alias("back")).collect()
    for r in got:
        assert bytes(r["c"]) == wal.put_varint(r["n"] % 2**64) and r["len"] == len(r["c"]) and r["back"] == r["n"]
    bad = spark.createDataFrame([(b"",), (b"\x80",), (b"\xff" * 11,), (b"\xff" * 9 + b"\x02",)], "c binary")
    assert [r[0] for r in bad.select(codec.varint_decode(F.col("c"))).collect()] == [None] * 4


def test_wrapping_product(spark):
    rng = random.Random(5)
    edges = [0, 1, -1, 1009, 2**31, 2**32 - 1, 2**32, 2**48 - 1, -(2**32), 2**63 - 1, -(2**63)]
    pairs = [(a, b) for a in edges for b in edges] + [(rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63) for _ in range(500)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", codec.wrapping_product(F.col("a"), F.col("b"), F.col("a")).alias("p"))
    assert all(r["p"] % 2**64 == r["a"] * r["b"] * r["a"] % 2**64 for r in df.collect())


def test_bloom(spark):
    assert [bloom.size(n) for n in (1, 10, 1000, 100_000)] == [(64, 16), (96, 7), (9586, 7), (958_506, 7)]
    m, k = bloom.size(1000)
    bits = set(bloom.positions([b"a", b"b", b"c"], m, k, digest=False).ravel().tolist())
    has = lambda x: set(bloom.positions([x], m, k, digest=False).ravel().tolist()) <= bits
    assert has(b"a") and has(b"b") and has(b"c") and not has(b"zzz")
    keys = spark.range(500).select(F.col("id").cast("string").alias("key"))
    probes = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    got = {r["key"]: r["may_contain"] for r in bloom.may_contain(probes, bloom.build(keys, 500), 500).collect()}
    assert len(got) == 3000 and all(got[str(i)] for i in range(500))
    assert np.mean([got[str(i)] for i in range(500, 3000)]) < 0.03


def test_log_round_trip_and_torn_tail():
    data = b"".join(map(wal.frame, (b"a", b"bb", b"ccc")))
    assert [p for _, _, p in wal.frames(data)] == [b"a", b"bb", b"ccc"]
    assert [p for _, _, p in wal.frames(data[:-2])] == [b"a", b"bb"]
    broken = bytearray(data)
    broken[5] ^= 1
    assert list(wal.frames(bytes(broken))) == []
    assert list(wal.frames(b"\x00" * 8)) == []


def test_batches_and_segments():
    entries = [(1, b"k", b"v" * 300), (2, b"", b"")]
    assert wal.decode_batch(wal.encode_batch(7, entries)) == (7, entries)
    with pytest.raises(wal.Corrupt):
        wal.decode_batch(b"short")
    with pytest.raises(wal.Corrupt):
        wal.decode_batch(wal.encode_batch(7, entries)[:-1])
    parts = wal.segments_of([b"x" * 400_000] * 5, 1 << 20)
    assert [len(list(wal.frames(p))) for p in parts] == [2, 2, 1]


def test_tables(spark, tmp_path):
    rows = [(f"k{i:05d}".encode(), b"v" * (i % 90)) for i in range(3000)]
    data = tables.build(rows)
    table = tables.Table(data)
    assert len(table.blocks) > 5 and list(table.scan()) == rows
    assert table.get(b"k00042") == b"v" * 42 and table.get(b"k00000") == b"" and table.get(b"zz") is None and table.get(b"") is None
    assert list(table.scan(b"k00010", b"k00013")) == rows[10:13] and list(table.scan(b"zz")) == []
    assert all(table.may_contain(k) for k, _ in rows) and np.mean([table.may_contain(b"x%d" % i) for i in range(2000)]) < 0.03
    assert list(tables.Table(tables.build([])).scan()) == []
    for bad in ([(b"b", b""), (b"a", b"")], [(b"a", b""), (b"a", b"")]):
        with pytest.raises(ValueError, match="ascend"):
            tables.build(bad)
    with pytest.raises(wal.Corrupt):
        tables.Table(data[:-1])
    (tmp_path / "1.sst").write_bytes(data)
    assert tables.read_tables(spark, [f"file://{tmp_path}/1.sst"]).count() == 3000


def test_valid_prefix(spark):
    rows = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False), (2, 0, False)], "segment int, offset int, bad boolean")
    assert sorted((r["segment"], r["offset"]) for r in wal.valid_prefix(rows).collect()) == [(1, 0), (2, 0)]
    assert sorted((r["segment"], r["offset"]) for r in wal.valid_prefix(rows, strict=True).collect()) == [(1, 0)]
