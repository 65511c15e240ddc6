"""Latest state over a stream of versions.

The newest version by (seq, ord) does not depend on arrival, so late and repeated batches are harmless and no watermark is needed
for correctness.  `live_stream` keeps one state row for each key; `append_batches` keeps none and leaves the work to the kernel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.model import PUT


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files with versions, each file once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def newest_stream(versions: DataFrame) -> DataFrame:
    """(key, seq, ord, kind, value) of each key's newest version so far, tombstones included: for update or complete mode."""
    top = versions.groupBy("key").agg(F.max_by(F.struct("seq", "ord", "kind", "value"), F.struct("seq", "ord")).alias("top"))
    return top.select("key", "top.seq", "top.ord", "top.kind", "top.value")


def live_stream(versions: DataFrame) -> DataFrame:
    return newest_stream(versions).filter(F.col("kind") == PUT)


def run_available(frame: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Runs a stream over what is there now, each micro-batch through sink(frame, batch id)."""
    frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()


def append_batches(versions: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a stream of versions to a folder, each batch to a sub-folder of its own, so that a batch that is run again replaces
    itself and nothing is kept in state."""
    run_available(versions, checkpoint, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"), "append")
