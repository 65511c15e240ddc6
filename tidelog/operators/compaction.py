"""Rewriting versions: merging runs, compaction, collection of old versions, tree policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import DELETE, PUT


def union_runs(runs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), runs)


def merge(runs: list[DataFrame]) -> DataFrame:
    """The merging iterator: the live rows over all runs, whatever the split."""
    from tidelog.operators.state import visible

    return visible(union_runs(runs))


def collect_versions(versions: DataFrame, watermark: int, bottommost: bool = True) -> DataFrame:
    """What must stay so that every snapshot at or above the watermark reads as before: all versions above it, and the newest at or
    below it of each key.  That newest one may go if it is a tombstone, but only when no lower run can hold an older put."""
    below = F.when(F.col("seq") <= watermark, 0).otherwise(1)
    order = Window.partitionBy("key", below).orderBy(F.desc("seq"), F.desc("ord"))
    ranked = versions.withColumn("_rn", F.row_number().over(order))
    keep = (F.col("seq") > watermark) | ((F.col("_rn") == 1) & ((F.col("kind") == PUT) | F.lit(not bottommost)))
    return ranked.filter(keep).drop("_rn")


def compact(runs: list[DataFrame], watermark: int | None = None, bottommost: bool = True) -> DataFrame:
    """The versions of one run in place of several, in version order within its files."""
    every = union_runs(runs)
    mark = watermark if watermark is not None else (1 << 63) - 1
    return collect_versions(every, mark, bottommost)


def dropped_tombstones(versions: DataFrame, watermark: int) -> DataFrame:
    return versions.filter((F.col("kind") == DELETE) & (F.col("seq") <= watermark))


def pick_size_tiered(manifest: list[dict], ratio: float = 2.0, least: int = 4) -> list[dict]:
    """The oldest group of at least `least` neighbouring runs whose sizes differ by no more than `ratio`."""
    own = sorted(manifest, key=lambda r: r["max_seq"])
    for i in range(len(own)):
        group = [own[i]]
        for r in own[i + 1 :]:
            sizes = [g["n_rows"] for g in (*group, r)]
            if max(sizes) > ratio * max(1, min(sizes)):
                break
            group.append(r)
        if len(group) >= least:
            return group
    return []


def pick_leveled(manifest: list[dict], base_rows: int, fanout: int = 10, level0: int = 4) -> tuple[list[dict], int] | None:
    """(runs, target level): level 0 when it holds `level0` runs, else the first level above its size, with the runs of the next
    level that overlap it in keys."""
    levels: dict[int, list[dict]] = {}
    for r in manifest:
        levels.setdefault(r["level"], []).append(r)
    for level in sorted(levels):
        own = levels[level]
        if len(own) < level0 if level == 0 else sum(r["n_rows"] for r in own) <= base_rows * fanout ** (level - 1):
            continue
        low, high = min(r["min_key"] for r in own), max(r["max_key"] for r in own)
        return own + [r for r in levels.get(level + 1, []) if r["max_key"] >= low and r["min_key"] <= high], level + 1
    return None
