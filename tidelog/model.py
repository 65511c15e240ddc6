"""The data model: versions of keys, options and the manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PUT, DELETE = 1, 2
LATEST = (1 << 63) - 1

#: A database is a DataFrame of versions.  Keys are compared as unsigned bytes; `ord` orders versions that share a sequence number
#: (one batch), the last one wins.
VERSIONS = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("kind", T.IntegerType(), False),
    T.StructField("value", T.BinaryType(), False),
])

MANIFEST = T.StructType([
    T.StructField("run_id", T.LongType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("min_key", T.BinaryType()),
    T.StructField("max_key", T.BinaryType()),
    T.StructField("n_rows", T.LongType(), False),
    T.StructField("n_tombstones", T.LongType(), False),
    T.StructField("min_seq", T.LongType()),
    T.StructField("max_seq", T.LongType()),
    T.StructField("level", T.IntegerType(), False),
])


@dataclass(frozen=True)
class Options:
    memtable_bytes: int = 64 << 20
    block_size: int = 16 << 10
    segment_bytes: int = 64 << 20
    fsync_on_commit: bool = True
    rows_per_file: int = 5_000_000
    #: Batches that share one sync, and so one segment file.  Those of an unfinished group are lost in a crash.
    group_commit: int = 1
    #: Rows of runs that stay in Spark's storage (memory, then disk) between reads, the least recently read going first; 0: none.
    cache_rows: int = 0


def as_bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)
