"""Binary sorted tables as rows: built, scanned and searched in parallel.  A row (table, min_key, max_key, n_rows, content) holds
one table, whose size is bounded by the rows that a table takes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.lookup import find_block
from tidelog.sources.shared import materialize
from tidelog.sources.tables import Table, build

TABLE_ROWS = 50_000
TABLES = "table long, min_key binary, max_key binary, n_rows long, content binary"


def build_tables(live: DataFrame, rows: int = TABLE_ROWS, block_size: int = 16 << 10) -> DataFrame:
    """Tables of at most `rows` entries of live (key, value), whose keys are unique: range partitions in key order, each cut into
    tables, so that tables do not overlap."""
    ordered = live.select(F.col("key").cast("binary"), F.col("value").cast("binary")).repartitionByRange("key").sortWithinPartitions("key")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: list[tuple[bytes, bytes]] = []
        number = TaskContext.get().partitionId() << 32

        def table(entries) -> pd.DataFrame:
            return pd.DataFrame({"table": [number], "min_key": [entries[0][0]], "max_key": [entries[-1][0]], "n_rows": [len(entries)], "content": [build(entries, block_size)]})

        for part in parts:
            held += zip(map(bytes, part["key"]), map(bytes, part["value"]), strict=True)
            while len(held) >= rows:
                yield table(held[:rows])
                held, number = held[rows:], number + 1
        if held:
            yield table(held)

    return ordered.mapInPandas(cut, TABLES)


def scan_tables(tables: DataFrame, start: bytes = b"", end: bytes = b"") -> DataFrame:
    """(key, value) of [start, end); tables outside the range are not opened, nor blocks before it."""
    own = tables
    if start:
        own = own.filter(F.col("max_key") >= F.lit(start))
    if end:
        own = own.filter(F.col("min_key") < F.lit(end))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                rows = list(Table(bytes(content)).scan(start, end))
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "value"])

    return own.select("content").mapInPandas(run, "key binary, value binary")


def get_from_tables(tables: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, value) of the distinct probes that a table holds.  Each probe is sent to the one table that may hold it, by the tables'
    last keys; there the filter is asked, then one block is read.  tables must be written: it is read twice."""
    sent = find_block(probes.select(F.col("key").cast("binary")).distinct(), tables.select(F.col("max_key").alias("last_key"))).filter("last_key IS NOT NULL")

    def search(probes: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        found = []
        for content in tables["content"]:
            table = Table(bytes(content))
            found += [(k, v) for k in map(bytes, probes["key"]) if (v := table.get(k)) is not None]
        return pd.DataFrame(found, columns=["key", "value"])

    return sent.groupBy("last_key").cogroup(tables.select(F.col("max_key").alias("last_key"), "content").groupBy("last_key")).applyInPandas(search, "key binary, value binary")


def written(live: DataFrame, rows: int = TABLE_ROWS) -> DataFrame:
    """build_tables() as a table of its own in the shared folder."""
    return materialize(build_tables(live, rows), "tables")
