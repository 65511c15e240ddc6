"""Write-ahead segments: frames of write batches in numbered files.

Frame: u32 n (1 + payload bytes), u8 type 1, payload, u32 CRC-32C of type and payload.  Payload: u64 seq, u32 count, and for each
entry u8 kind, varint key length, varint value length, key, value.  Numbers are little-endian.  A reader takes the valid prefix of
each segment: it stops at a short tail, a zero length or a wrong checksum."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.codec import crc32c_bytes, varint_length
from tidelog.model import VERSIONS

BATCH_TYPE = 1
Entry = tuple[int, bytes, bytes]


class Corrupt(ValueError):
    pass


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes((*out, n))


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, place behind it)."""
    n = shift = 0
    while True:
        if at >= len(data):
            raise Corrupt("underflow")
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            if n >> 64:
                raise Corrupt("overflow")
            return n, at
        shift += 7
        if shift > 63:
            raise Corrupt("overflow")


def encode_batch(seq: int, entries: list[Entry]) -> bytes:
    parts = [struct.pack("<QI", seq, len(entries))]
    for kind, key, value in entries:
        parts += (bytes([kind]), put_varint(len(key)), put_varint(len(value)), key, value)
    return b"".join(parts)


def decode_batch(payload: bytes) -> tuple[int, list[Entry]]:
    if len(payload) < 12:
        raise Corrupt("short batch")
    seq, count = struct.unpack_from("<QI", payload)
    at, out = 12, []
    for _ in range(count):
        if at >= len(payload):
            raise Corrupt("short entry")
        kind = payload[at]
        k, at = get_varint(payload, at + 1)
        v, at = get_varint(payload, at)
        if kind not in (1, 2) or at + k + v > len(payload):
            raise Corrupt("bad entry")
        out.append((kind, payload[at : at + k], payload[at + k : at + k + v]))
        at += k + v
    return seq, out


def frame(payload: bytes, kind: int = BATCH_TYPE) -> bytes:
    body = bytes([kind]) + payload
    return struct.pack("<I", len(body)) + body + struct.pack("<I", crc32c_bytes(body))


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, type, payload) of the valid prefix."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<I", data, at)
        if n == 0 or at + 8 + n > len(data):
            return
        body = data[at + 4 : at + 4 + n]
        if struct.unpack_from("<I", data, at + 4 + n)[0] != crc32c_bytes(body):
            return
        yield at, body[0], body[1:]
        at += 8 + n


def segments_of(payloads: list[bytes], cap: int = 64 << 20) -> list[bytes]:
    """Frames in segments: a new one begins before the frame that would exceed the cap."""
    cap, out, used = max(cap, 1 << 20), [[]], 0
    for x in map(frame, payloads):
        if out[-1] and used + len(x) > cap:
            out.append([])
            used = 0
        out[-1].append(x)
        used += len(x)
    return [b"".join(x) for x in out if x]


def replay(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The versions in segment files, a task for each file; ord is the place in the batch.  Order needs no care, as the kernel
    orders by seq, and reading a segment twice changes nothing."""
    if not paths:
        return spark.createDataFrame([], VERSIONS)
    return replay_contents(spark.read.format("binaryFile").load(paths))


def versions_of(data: bytes) -> list[tuple]:
    """The versions in a segment's bytes.  A frame whose checksum holds but whose batch does not decode ends the segment, like a torn
    tail; the batches before it count."""
    rows = []
    for _, kind, payload in frames(data):
        if kind == BATCH_TYPE:
            try:
                seq, entries = decode_batch(payload)
            except Corrupt:
                break
            rows += [(k, seq, i, kind_, v) for i, (kind_, k, v) in enumerate(entries)]
    return rows


def replay_contents(segments: DataFrame, content: str = "content") -> DataFrame:
    """The versions in a column of segment bytes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for data in part["content"]:
                if rows := versions_of(bytes(data)):
                    yield pd.DataFrame(rows, columns=VERSIONS.fieldNames())

    return segments.select(F.col(content).alias("content")).mapInPandas(run, VERSIONS)


def encode_segments(versions: DataFrame, segment: str = "segment") -> DataFrame:
    """(segment, content): the log segment of each group of versions, its batches in order of seq.  A segment is one file, bounded by
    the segment size, so its versions meet in one task by nature."""
    key_type = dict(versions.dtypes)[segment]

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        batches: dict[int, list[Entry]] = {}
        for row in rows.sort_values(["seq", "ord"]).itertuples(index=False):
            batches.setdefault(row.seq, []).append((row.kind, bytes(row.key), bytes(row.value)))
        return pd.DataFrame({segment: [rows[segment].iloc[0]], "content": [b"".join(frame(encode_batch(s, e)) for s, e in batches.items())]})

    given = versions.select(segment, F.col("key").cast("binary"), F.col("seq").cast("long"), F.col("ord").cast("int"), F.col("kind").cast("int"), F.col("value").cast("binary"))
    return given.groupBy(segment).applyInPandas(encode, f"{segment} {key_type}, content binary")


def valid_prefix(records: DataFrame, segment: str = "segment", offset: str = "offset", bad: str = "bad", strict: bool = False) -> DataFrame:
    """The records before the first bad one of each segment; with strict, before the first bad one of all segments in order."""
    order = Window.partitionBy(segment).orderBy(offset).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = records.withColumn("_bad", F.sum(F.col(bad).cast("int")).over(order))
    if strict:
        first = records.filter(F.col(bad)).agg(F.min(segment).alias("_stop"))
        kept = kept.join(F.broadcast(first)).filter(F.col("_stop").isNull() | (F.col(segment) <= F.col("_stop"))).drop("_stop")
    return kept.filter("_bad = 0").drop("_bad")


def frame_length(key: Column, value: Column) -> Column:
    """Bytes of the frame of a batch with one entry."""
    k, v = F.octet_length(key), F.octet_length(value)
    return (F.lit(9 + 12 + 1) + varint_length(k.cast("long")) + varint_length(v.cast("long")) + k + v).cast("long")
