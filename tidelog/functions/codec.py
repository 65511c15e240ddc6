"""Base-128 varints, CRC-32C and FNV-1a as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYNOMIAL = 0x82F63B78  # CRC-32C (Castagnoli), reflected
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def crc32c_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return out


_TABLE = crc32c_table()


def crc32c_bytes(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = _TABLE[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def byte_array(col: Column) -> Column:
    """The bytes of a string or binary column, as numbers."""
    each = F.split(F.decode(col.cast("binary"), "ISO-8859-1"), "")  # a character for each byte
    return F.when(F.octet_length(col) > 0, F.transform(each, lambda c: F.ascii(c).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def crc32c(col: Column) -> Column:
    """CRC-32C of the bytes, as a non-negative long."""
    table = F.array(*[F.lit(x).cast("long") for x in _TABLE])
    step = lambda c, b: F.get(table, c.bitwiseXOR(b).bitwiseAND(F.lit(0xFF)).cast("int")).bitwiseXOR(F.shiftright(c, 8))
    return F.aggregate(byte_array(col), F.lit(0xFFFFFFFF).cast("long"), step, lambda c: c.bitwiseXOR(F.lit(0xFFFFFFFF).cast("long")))


def fnv1a64(col: Column) -> Column:
    """FNV-1a, 64 bits, as a struct of two non-negative 32-bit halves (hi, lo).  The prime is 2^40 + 435, so that the product is a
    shift and a small multiplication of either half and nothing overflows a long."""
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        low = lo * 435
        high = h["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF).cast("long")), 8)
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("hi"), F.lit(FNV_OFFSET & 0xFFFFFFFF).cast("long").alias("lo"))
    return F.aggregate(byte_array(col), start, step)


def wrapping_product(*factors: Column) -> Column:
    """The product of longs modulo 2^64, as the bits of a long, where `*` raises an error in ANSI mode.  Numbers are halves of 32 bits,
    the upper one signed, and the product of the lower ones is taken by 16 bits, so that nothing overflows a long."""
    mask, small = F.lit(0xFFFFFFFF).cast("long"), F.lit(0xFFFF).cast("long")

    def times(a: Column, b: Column) -> Column:
        low_a, low_b = a.bitwiseAND(mask), b.bitwiseAND(mask)
        first = low_a * low_b.bitwiseAND(small)
        second = low_a * F.shiftright(low_b, 16) + F.shiftright(first, 16)
        high = F.shiftright(second, 16) + (F.shiftright(a, 32) * low_b).bitwiseAND(mask) + (low_a * F.shiftright(b, 32)).bitwiseAND(mask)
        return F.shiftleft(high, 32).bitwiseOR(F.shiftleft(second.bitwiseAND(small), 16)).bitwiseOR(first.bitwiseAND(small))

    return F.aggregate(F.array(*factors), F.lit(1).cast("long"), times)


def varint_length(n: Column) -> Column:
    """Bytes of the base-128 code of a 64-bit number; negative longs stand for numbers from 2^63 on."""
    out = F.when(n < 0, 10)
    for size in range(1, 9):
        out = out.when(n < F.lit(1 << (7 * size)).cast("long"), size)
    return out.otherwise(9)


def varint_encode(n: Column) -> Column:
    """The base-128 code, least group first, as binary."""
    size = varint_length(n)

    def group(i: Column) -> Column:
        bits = F.call_function("shiftrightunsigned", n.cast("long"), (i * 7).cast("int")).bitwiseAND(F.lit(0x7F).cast("long"))
        return F.lpad(F.hex(F.when(i < size - 1, bits + 128).otherwise(bits)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), group), ""))


def varint_decode(code: Column) -> Column:
    """The number of a base-128 code that fills the whole binary; null if it ends early (underflow), is longer than ten bytes or
    exceeds 64 bits (overflow)."""
    bits = byte_array(code)
    size = F.size(bits)
    last = F.get(bits, size - 1)
    step = lambda acc, b: F.struct((acc["at"] + 7).alias("at"), acc["n"].bitwiseOR(F.call_function("shiftleft", b.bitwiseAND(F.lit(0x7F).cast("long")), acc["at"])).alias("n"))
    number = F.aggregate(bits, F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n")), step)["n"]
    inner = F.forall(F.slice(bits, F.lit(1), F.greatest(F.lit(0), size - 1)), lambda b: b >= 128)
    return F.when((size > 0) & (size <= 10) & (last < 128) & inner & ((size < 10) | (last <= 1)), number)
