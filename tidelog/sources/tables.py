"""Binary sorted tables: data blocks, an index of last keys, a Bloom filter and a footer, for exchange with byte-level tools.

Block: (varint key length, varint value length, key, value) repeated.  Index: (varint key length, last key, u64 offset, u32 length)
repeated.  Filter: u32 bits, u8 hash functions, u64 seed, bit b in byte b/8 under mask 1 << b%8.  Footer, 28 bytes: u64 and u32
for the index, u64 and u32 for the filter, u32 magic.  Numbers are little-endian.  Tables hold the visible state only; the engine's
own runs are Parquet and keep all versions."""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidelog.functions import bloom
from tidelog.sources.wal import Corrupt, get_varint, put_varint

MAGIC = 0x5A494742  # fixed value
FOOTER = struct.Struct("<QIQII")
LEAST_BLOCK = 4096
ROWS = "file string, key binary, value binary"


def encode_block(entries: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join(put_varint(len(k)) + put_varint(len(v)) + k + v for k, v in entries)


def decode_block(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(data):
        k, at = get_varint(data, at)
        v, at = get_varint(data, at)
        if at + k + v > len(data):
            raise Corrupt("short block")
        yield data[at : at + k], data[at + k : at + k + v]
        at += k + v


def build(entries: Iterable[tuple[bytes, bytes]], block_size: int = 16 << 10) -> bytes:
    """A table of entries in strictly ascending key order; a block is cut before the entry that would make it too large."""
    limit, blocks, used, before = max(block_size, LEAST_BLOCK), [[]], 0, None
    keys = []
    for key, value in entries:
        if before is not None and key <= before:
            raise ValueError("keys must ascend strictly")
        before = key
        if blocks[-1] and used + len(key) + len(value) + 20 > limit:
            blocks.append([])
            used = 0
        blocks[-1].append((key, value))
        used += len(put_varint(len(key))) + len(put_varint(len(value))) + len(key) + len(value)
        keys.append(key)
    out, index = bytearray(), bytearray()
    for block in filter(None, blocks):
        data = encode_block(block)
        last = block[-1][0]
        index += put_varint(len(last)) + last + struct.pack("<QI", len(out), len(data))
        out += data
    index_at = len(out)
    out += index
    filter_at = filter_len = 0
    if keys:
        m, k = bloom.size(len(keys))
        bits = np.zeros(-(-m // 8) * 8, bool)
        bits[bloom.positions(keys, m, k).ravel().astype(np.int64)] = True
        data = struct.pack("<IBQ", m, k, bloom.SEED) + np.packbits(bits, bitorder="little").tobytes()
        filter_at, filter_len = len(out), len(data)
        out += data
    return bytes(out) + FOOTER.pack(index_at, len(index), filter_at, filter_len, MAGIC)


class Table:
    """Lookups in the bytes of a table."""

    def __init__(self, data: bytes):
        if len(data) < FOOTER.size:
            raise Corrupt("no footer")
        self.data = data
        index_at, index_len, self.filter_at, self.filter_len, magic = FOOTER.unpack_from(data, len(data) - FOOTER.size)
        if magic != MAGIC or index_at + index_len > len(data):
            raise Corrupt("bad footer")
        self.last_keys, self.blocks, at = [], [], index_at
        while at < index_at + index_len:
            n, at = get_varint(data, at)
            self.last_keys.append(data[at : at + n])
            self.blocks.append(struct.unpack_from("<QI", data, at + n))
            at += n + 12

    def find_block(self, key: bytes) -> int | None:
        """The first block whose last key is not below the key."""
        i = bisect_left(self.last_keys, key)
        return i if i < len(self.blocks) else None

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, n = self.blocks[i]
        return decode_block(self.data[at : at + n])

    def may_contain(self, key: bytes) -> bool:
        if not self.filter_len:
            return False
        m, k, seed = struct.unpack_from("<IBQ", self.data, self.filter_at)
        bits = self.data[self.filter_at + 13 : self.filter_at + self.filter_len]
        return all(bits[p // 8] >> (p % 8) & 1 for p in bloom.positions([key], m, k, seed)[0].tolist())

    def get(self, key: bytes) -> bytes | None:
        i = self.find_block(key) if self.may_contain(key) else None
        return next((v for k, v in self.block(i) if k == key), None) if i is not None else None

    def scan(self, start: bytes = b"", end: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
        """[start, end) in key order; an empty end is open."""
        first = self.find_block(start)
        for i in range(first if first is not None else len(self.blocks), len(self.blocks)):
            for k, v in self.block(i):
                if end and k >= end:
                    return
                if k >= start:
                    yield k, v


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, key, value) of table files, a task for each file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                table = Table(bytes(content))
                for i in range(len(table.blocks)):
                    rows = list(table.block(i))
                    yield pd.DataFrame({"file": path, "key": [k for k, _ in rows], "value": [v for _, v in rows]})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, ROWS)
