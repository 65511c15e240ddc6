"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.shared import discard, materialize, shared_dir

__all__ = ["ascii_lower", "discard", "give_back", "materialize", "shared_dir", "small_batches", "table"]

BATCH_ROWS = 1024
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are long: at most BATCH_ROWS rows go to a Python worker at once, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Returns freed memory of a Python worker to the system at the end of a task: workers are used again, and what they hold would
    add up over the stages of a job."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # no such call in this C library
        return


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(col, UPPER, LOWER)
