"""Snapshot isolation: conflicts between writers, increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_conflicts(writes: DataFrame) -> DataFrame:
    """Pairs (key, winner, loser) under first committer wins.  writes: key, start, commit.  The loser started before the winner's
    commit and committed after it.

    A range join by key and cells of time: a write's span picks a cell width, the power of two from the span on, and lies in two
    neighbouring cells of it; every commit is offered in its cell of each width that occurs (64 at most, collected by a job).  A hot
    key is thus cut into cells, and a cell holds at most some four times the pairs that the result needs if commits come evenly."""
    spans = writes.filter(F.col("commit") > F.col("start")).withColumn("width", F.ceil(F.log2((F.col("commit") - F.col("start")).cast("double"))).cast("int"))
    widths = sorted(r["width"] for r in spans.select("width").distinct().collect())
    if not widths:
        return writes.select("key", F.col("commit").alias("winner"), F.col("commit").alias("loser")).limit(0)

    def cell(at):
        return F.call_function("shiftright", at, F.col("width"))

    commits = writes.filter("commit IS NOT NULL").select("key", F.col("commit").alias("winner"), F.explode(F.array(*map(F.lit, widths))).alias("width"))
    commits = commits.withColumn("cell", cell(F.col("winner")))
    losers = spans.select("key", "start", F.col("commit").alias("loser"), "width", F.explode(F.sequence(cell(F.col("start")), cell(F.col("commit")))).alias("cell"))
    return commits.join(losers, ["key", "width", "cell"]).filter("start < winner AND winner < loser").select("key", "winner", "loser")


def increments(versions: DataFrame) -> DataFrame:
    """(key, n): the puts after the last delete of each key, each of which counts as an increment by one from an absent key's 0."""
    reset = F.coalesce(F.max(F.when(F.col("kind") == 2, F.col("seq"))).over(Window.partitionBy("key")), F.lit(-1).cast("long"))
    return versions.withColumn("reset", reset).filter("kind = 1 AND seq > reset").groupBy("key").agg(F.count("*").alias("n"))
