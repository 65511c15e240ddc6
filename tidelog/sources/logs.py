"""Logs of versions: from mutations, from write batches, and the two logs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import DELETE, PUT
from tidelog.sources.shared import materialize


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_mutations(df: DataFrame, key: str, seq: str, deleted: str | None = None, value: str | None = None, ord: str | None = None) -> DataFrame:  # noqa: A002
    """A versions log of a table of mutations; deletes carry an empty value."""
    gone = F.coalesce(F.expr(deleted), F.lit(False)) if deleted else F.lit(False)
    return df.select(
        F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), (F.col(ord) if ord else F.lit(0)).alias("ord"),
        F.when(gone, DELETE).otherwise(PUT).alias("kind"), F.when(gone, F.lit("")).otherwise(F.coalesce(F.col(value) if value else F.lit(""), F.lit(""))).alias("value"),
    )


def batches(versions: DataFrame) -> DataFrame:
    """One row for each write batch: (seq, entries), the entries in their order."""
    return versions.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("ord", "kind", "key", "value"))).alias("entries"))


def decode_batches(packed: DataFrame) -> DataFrame:
    """The versions of write batches (seq, entries); ord is the place in the batch."""
    return packed.select("seq", F.posexplode("entries").alias("ord", "e")).select("e.key", "seq", "ord", "e.kind", "e.value")


def number_batches(df: DataFrame, order: str, start: int = 1) -> DataFrame:
    """df with consecutive sequence numbers from `start` in order of a column: range partitions are numbered on their own and
    shifted by the counts of those before them, so no task sees the whole table.  The partitions are written first, as their bounds
    are sampled and another run could draw others."""
    ordered = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())
    ordered = materialize(ordered, "numbered")
    part = F.shiftright("_id", 33)
    counts = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).orderBy("_p").collect()  # one row for each partition
    first, at = {}, start
    for row in counts:
        first[row["_p"]], at = at, at + row["n"]
    shifts = F.create_map(*[F.lit(x).cast("long") for pair in (first or {0: start}).items() for x in pair])
    return ordered.withColumn("seq", F.element_at(shifts, part) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log E: one version for each event of a user, errors delete."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), (F.col("event_id") + 1).alias("n"), "event_type", "props")
    return from_mutations(events, "user", "n", "event_type = 'error'", "props")


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log L: order lines as keys, one sequence number for each shipping day, returns delete.  The payload is typed."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key"), F.datediff("l_shipdate", F.lit("1995-01-01")).cast("long").alias("seq"),
        F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("ord"), F.when(F.col("l_returnflag") == "R", DELETE).otherwise(PUT).alias("kind"),
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )
