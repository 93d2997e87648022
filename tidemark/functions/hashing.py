"""Hash columns: seeded MD5, unsigned remainders, bit text. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_hex(i: int) -> str:
    """Seed i of the hash family: four bytes, big-endian, then 28 zero bytes."""
    return f"{i:08x}" + "00" * 28


def seeded_md5(data: Column, seed: Column) -> Column:
    """Hex MD5 of the data followed by the seed, which is hex text."""
    return F.md5(F.concat(data.cast("binary"), F.unhex(seed)))


def unsigned_mod(digest: Column, m: int | Column) -> Column:
    """The first 8 bytes of a hex digest as an unsigned number, modulo m (below 2**31), by 32-bit halves."""
    m = F.lit(m).cast("bigint")
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    return ((half(1) % m) * (F.lit(1 << 32) % m) + half(9) % m) % m


def bit_text(hex_text: Column) -> Column:
    """Eight bits for each character of a text, by its code."""
    return F.array_join(F.transform(F.filter(F.split(hex_text, ""), lambda c: c != ""), lambda c: F.lpad(F.bin(F.ascii(c).cast("bigint")), 8, "0")), "")


def seeds(k: int) -> Column:
    """array<struct<i, seed>> of the family's first k seeds."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(seed_hex(i)).alias("seed")) for i in range(k)])
