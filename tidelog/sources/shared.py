"""Intermediate tables in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where the session names none, one of our own is set if all runs in one process (tests);
    on a cluster that is an error, as executors would each write to a disk of their own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it again: the lineage ends here, lost executors cost no recomputation
    of what stands above, values that depend on the run (partition numbers) are fixed, and later readers prune columns.  The table
    stays until discard() or clear_tables()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelog/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df._written_at)


def clear_tables(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application.  Results that were not written yet read them: call it behind the last one."""
    _delete(spark, f"{shared_dir(spark)}/tidelog/{spark.sparkContext.applicationId}")
