"""Sorted runs as Parquet and their manifest.

A run is written by one job, range-partitioned and sorted by (key, seq desc, ord desc), so that Parquet's statistics and page
index prune by key.  Runs keep seq, ord, kind and tombstones.  A run counts only when a manifest names it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import DELETE, VERSIONS, Options
from tidelog.sources.files import Files

HEADER = "tidelog-manifest-1"


class BadManifest(ValueError):
    pass


def summary(versions: DataFrame) -> DataFrame:
    """The manifest facts of the versions in a run."""
    return versions.agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_rows"),
        F.count(F.when(F.col("kind") == DELETE, 1)).alias("n_tombstones"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
    )


def summaries(versions: DataFrame, run: str = "run_id") -> DataFrame:
    """The manifest facts of many runs in one frame of versions."""
    return versions.groupBy(run).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_rows"),
        F.count(F.when(F.col("kind") == DELETE, 1)).alias("n_tombstones"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
    )


def write_run(versions: DataFrame, path: str, options: Options = Options(), files: int | None = None) -> None:
    ordered = (versions.repartitionByRange(files, "key") if files else versions.repartitionByRange("key")).sortWithinPartitions("key", F.desc("seq"), F.desc("ord"))
    ordered.write.option("maxRecordsPerFile", options.rows_per_file).option("parquet.page.size", options.block_size).option("parquet.bloom.filter.enabled#key", "true").parquet(path)


class Manifest:
    """Numbered manifest files, each the whole list of runs; the highest number is the present."""

    def __init__(self, files: Files):
        self.files = files
        files.mkdirs("manifest")

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.files.names("manifest") if n.endswith(".json"))

    def load(self, version: int | None = None) -> dict:
        """{"version", "runs", "floor"}; no manifest is an empty database."""
        known = self.versions()
        if not known:
            return {"version": 0, "runs": [], "floor": 0}
        at = known[-1] if version is None else version
        try:
            body = json.loads(self.files.read(f"manifest/{at:012d}.json"))
            if body["header"] != HEADER:
                raise BadManifest("header")
            runs = [r | {"min_key": bytes.fromhex(r["min_key"]), "max_key": bytes.fromhex(r["max_key"])} for r in body["runs"]]
            return {"version": at, "runs": runs, "floor": body["floor"]}
        except (KeyError, TypeError, ValueError) as error:
            raise BadManifest(str(error)) from error

    def commit(self, runs: list[dict], floor: int, base: int) -> int:
        """The next version.  It fails if another writer made it first: the file of that number exists then."""
        body = {"header": HEADER, "floor": floor, "runs": [r | {"min_key": r["min_key"].hex(), "max_key": r["max_key"].hex()} for r in runs]}
        name = f"manifest/{base + 1:012d}.json"
        self.files.write(name, json.dumps(body, sort_keys=True).encode())
        return base + 1


    def expire(self, keep: int) -> int:
        """Deletes all but the newest `keep` manifest versions, and returns how many went; snapshots of them cannot be read any more."""
        old = self.versions()[: -max(1, keep)]
        for version in old:
            self.files.delete(f"manifest/{version:012d}.json")
        return len(old)


def overlapping(runs: list[dict], start: bytes | None = None, end: bytes | None = None) -> list[dict]:
    """The runs whose key range meets [start, end)."""
    return [r for r in runs if (not start or r["max_key"] >= start) and (not end or r["min_key"] < end)]


def read_runs(spark: SparkSession, root: str, runs: list[dict]) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], VERSIONS)
    return spark.read.schema(VERSIONS).parquet(*[f"{root}/{r['path']}" for r in runs])
