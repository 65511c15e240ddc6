"""Reading versions: one relational kernel, newest visible version of each key minus tombstones, and what follows from it.

All operators take a DataFrame with key, seq, ord, kind and payload columns.  The test of seq stands below the window, the test of
kind above it; a filter of the result by key reaches the scan through the window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import DELETE, PUT

#: Distinct probes that are broadcast at most, and bytes of their keys.
PROBES, PROBE_BYTES = 1 << 18, 16 << 20


def newest_first():
    return Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("ord"))


def newest(versions: DataFrame, ts: Column | int | None = None) -> DataFrame:
    """The newest version of each key with seq <= ts, tombstones included."""
    seen = versions if ts is None else versions.filter(F.col("seq") <= ts)
    return seen.withColumn("_rn", F.row_number().over(newest_first())).filter("_rn = 1").drop("_rn")


def visible(versions: DataFrame, ts: Column | int | None = None) -> DataFrame:
    """The live state at ts: newest versions that are puts."""
    return newest(versions, ts).filter(F.col("kind") == PUT)


def newest_by_max(versions: DataFrame, payload: list[str], ts: Column | int | None = None) -> DataFrame:
    """newest() as an aggregation: no sort of whole rows, best for narrow payloads."""
    seen = versions if ts is None else versions.filter(F.col("seq") <= ts)
    top = seen.groupBy("key").agg(F.max_by(F.struct("seq", "ord", "kind", *payload), F.struct("seq", "ord")).alias("_top"))
    return top.select("key", "_top.*")


def get(versions: DataFrame, key: Column | str | bytes, ts: Column | int | None = None) -> DataFrame:
    """The live row of one key, or none."""
    return visible(versions, ts).filter(F.col("key") == key)


def asked_for(versions: DataFrame, probes: DataFrame) -> DataFrame:
    """The versions whose key a probe asks for, if the distinct probes are few enough to be broadcast (`PROBES`, `PROBE_BYTES`, which
    a job counts first): the filter then stands below the window, in the scan's stage.  More probes leave the versions as they are:
    the window's group limit cuts a hot key to one row a task before any shuffle, which a join by key would not."""
    keys = probes.select("key").distinct()
    n, size = keys.limit(PROBES + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    return versions.join(F.broadcast(keys), "key", "left_semi") if n <= PROBES and size <= PROBE_BYTES else versions


def multi_get(probes: DataFrame, versions: DataFrame, ts: Column | int | None = None) -> DataFrame:
    """Every probe (a column key) with its live row, nulls where there is none.  A job counts the probes first."""
    return probes.join(visible(asked_for(versions, probes), ts), "key", "left")


def scan(versions: DataFrame, start=None, end=None, ts: Column | int | None = None, ordered: bool = True) -> DataFrame:
    """The live rows of the half-open range [start, end) in key order; null or empty bounds are open."""
    rows = visible(versions, ts)
    if bounded(start):
        rows = rows.filter(F.col("key") >= start)
    if bounded(end):
        rows = rows.filter(F.col("key") < end)
    return rows.orderBy("key") if ordered else rows


def bounded(bound) -> bool:
    return bound is not None and not (isinstance(bound, str | bytes) and not bound)


def history(versions: DataFrame) -> DataFrame:
    """Every version with its age (1: newest) and valid_to, the seq of the version that replaced it; one sort serves both."""
    return versions.withColumn("age", F.row_number().over(newest_first())).withColumn("valid_to", F.lag("seq").over(newest_first()))


def tombstones(versions: DataFrame, ts: Column | int | None = None) -> DataFrame:
    """Keys whose newest version is a delete."""
    return newest(versions, ts).filter(F.col("kind") == DELETE)


def find_first(versions: DataFrame, key, seq: int) -> DataFrame:
    """The first version at or behind (key, seq) in version order: key ascending, seq descending."""
    behind = versions.filter((F.col("key") > key) | ((F.col("key") == key) & (F.col("seq") <= seq)))
    return behind.orderBy("key", F.desc("seq"), F.desc("ord")).limit(1)


def absent(probes: DataFrame, versions: DataFrame) -> DataFrame:
    """The probes without a live row: deleted or never written.  A job counts the probes first."""
    return probes.join(visible(asked_for(versions, probes)).select("key"), "key", "left_anti")


def version_bytes(key: str = "key", value: str = "value") -> Column:
    """What a version counts in memory: key, value and 16 bytes."""
    return F.octet_length(key) + F.octet_length(value) + F.lit(16)


def order_violations(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """The rows of a run that do not come strictly after their predecessor in position (column pos)."""
    before = Window.partitionBy(run).orderBy("pos")
    return rows.withColumn("before", F.lag("key").over(before)).filter(F.col("before") >= F.col("key"))
