"""Access paths as joins: run pruning by key range, block lookup, newest run first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.sources.shared import materialize


def prune_runs(probes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(key, run_id) of the runs whose key range holds the probe.  A manifest has a row for each run, not for each key; Spark
    broadcasts it below its own threshold and falls back to a nested loop over a shuffled side beyond."""
    return probes.join(manifest, (F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key"))).select("key", "run_id")


def find_block(probes: DataFrame, index: DataFrame) -> DataFrame:
    """Each probe with the first block whose last key is not below it; null beyond the run.  Blocks and probes are merged in key
    ranges of even size, whatever the keys begin with, and each range is walked once from its end: the last key met last is the next
    one behind a probe, and behind the last block of a range comes the first one of a later range.  Repeated probes are dealt to
    neighbouring ranges by a hash of their place, so a hot key is no hot range.  The list of ranges has a row for each partition."""
    both = probes.select("key", F.lit(0).alias("is_block"), F.lit(None).cast(dict(index.dtypes)["last_key"]).alias("last_key"))
    both = both.unionByName(index.select(F.col("last_key").alias("key"), F.lit(1).alias("is_block"), "last_key"))
    dealt = both.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange("key", "is_block", "spread").drop("spread")
    ranged = materialize(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    back = Window.partitionBy("part").orderBy(F.desc("key"), F.desc("is_block")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = ranged.withColumn("near", F.last("last_key", ignorenulls=True).over(back)).filter("is_block = 0")
    parts = ranged.groupBy("part").agg(F.min("last_key").alias("first_key"))
    after = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("next_key", F.last("first_key", ignorenulls=True).over(after)).select("part", "next_key")
    return inner.join(F.broadcast(parts), "part").select("key", F.coalesce("near", "next_key").alias("last_key"))


def newest_run_first(versions: DataFrame, run: str = "run_id") -> DataFrame:
    """The version that a search through the runs, newest first, meets first for each key."""
    order = Window.partitionBy("key").orderBy(F.desc(run), F.desc("seq"), F.desc("ord"))
    return versions.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def greedy_groups(rows: DataFrame, stream: str, pos: str, size: str, cap: int) -> DataFrame:
    """(stream, pos, group_no): sizes are added in order of pos and a group is closed before the row that would exceed the cap, as
    segments are rotated and blocks are cut.  A stream (a writer) is sequential by nature: its rows are sorted and pass through one
    task, which holds one Arrow batch and finds each cut by a search in running sums."""
    kinds = dict(rows.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used, no = object(), 0, 0
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            sums, out, i = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(sizes), np.int32), 0
            edges = [k for k in range(1, len(names)) if names[k] != names[k - 1]] + [len(names)]
            for edge in edges:
                if i < edge and names[i] != at:
                    at, used, no = names[i], 0, 0
                while i < edge:
                    stop = min(edge, int(np.searchsorted(sums, cap - used + sums[i], side="right")) - 1)
                    if stop <= i and used == 0:
                        stop = i + 1  # a row above the cap is a group of its own
                    out[i:stop] = no
                    used += int(sums[stop] - sums[i]) if stop > i else 0
                    i = max(i, stop)
                    if i < edge:
                        no, used = no + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=[stream, pos, "group_no"])

    ordered = rows.select(stream, pos, F.col(size).cast("long").alias("_size")).repartition(stream).sortWithinPartitions(stream, pos)
    return ordered.mapInArrow(cut, f"{stream} {kinds[stream]}, {pos} {kinds[pos]}, group_no int")
