"""Bloom filters: sizing in closed form, building as distinct bit positions, probing as a join."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LN2 = 0.6931471805599453
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
# The 64-bit finaliser of the public MurmurHash3.
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
SEED = 0xB100B100B100B100


def size(n: int, p: float = 0.01) -> tuple[int, int]:
    """(bits, hash functions) for n keys and a rate p of false positives."""
    p = 0.01 if p <= 0 else min(p, 0.5)
    m = max(64, math.ceil(-n * math.log(p) / (LN2 * LN2)))
    return m, min(16, max(1, math.floor(m / max(n, 1) * LN2 + 0.5)))


def size_columns(n: Column, p: float = 0.01) -> tuple[Column, Column]:
    p = 0.01 if p <= 0 else min(p, 0.5)
    m = F.greatest(F.lit(64).cast("long"), F.ceil(-n * F.lit(math.log(p)) / F.lit(LN2 * LN2)))
    return m, F.least(F.lit(16).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(m / F.greatest(n, F.lit(1)) * F.lit(LN2) + F.lit(0.5))))


def mix64(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(33))) * MIX[0]
    v = (v ^ (v >> np.uint64(33))) * MIX[1]
    return v ^ (v >> np.uint64(33))


def fnv64(data: bytes, seed: int = 0) -> int:
    h = 0xCBF29CE484222325 ^ seed
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def positions(keys: list[bytes], m: int, k: int, seed: int = SEED, digest: bool = True) -> np.ndarray:
    """The bit positions of each key (rows).  With digest the filter holds the eight little-endian bytes of the key's plain FNV-1a,
    as run files do; arithmetic wraps at 2^64."""
    given = [fnv64(x).to_bytes(8, "little") if digest else x for x in keys]
    with np.errstate(over="ignore"):
        h1 = mix64(np.array([fnv64(x, seed) for x in given], np.uint64))
        h2 = mix64(h1 ^ np.uint64(seed * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        return (h1[:, None] + np.arange(k, dtype=np.uint64)[None, :] * h2[:, None]) % np.uint64(m)


def positions_column(key: Column, m: int, k: int, seed: int = SEED, digest: bool = True) -> Column:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(list(positions([bytes(x) for x in keys], m, k, seed, digest).astype(np.int64)))

    return of(key.cast("binary"))


def mixed_column(key: Column, seed: int = SEED) -> Column:
    """The mixed seeded hash of each key, as the bits of a long."""

    @F.pandas_udf(T.LongType())
    def of(keys: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series(mix64(np.array([fnv64(bytes(x), seed) for x in keys], np.uint64)).view(np.int64))

    return of(key.cast("binary"))


def build(keys: DataFrame, n: int, p: float = 0.01, seed: int = SEED) -> DataFrame:
    """(bit): the distinct set bits for a DataFrame with a column key; n is the number of keys to size for."""
    m, k = size(n, p)
    return keys.select(F.explode(positions_column(F.col("key"), m, k, seed)).alias("bit")).distinct()


def may_contain(probes: DataFrame, bits: DataFrame, n: int, p: float = 0.01, seed: int = SEED) -> DataFrame:
    """probes (key, ...) with may_contain: whether all bits of the key are set.  No key that was added gets false."""
    m, k = size(n, p)
    asked = probes.select("key").distinct().select("key", F.explode(positions_column(F.col("key"), m, k, seed)).alias("bit"))
    hits = asked.join(bits.withColumn("set", F.lit(1)), "bit", "left").groupBy("key").agg((F.min(F.coalesce("set", F.lit(0))) == 1).alias("may_contain"))
    return probes.join(hits, "key")
