"""Bloom filter, count-min sketch and HyperLogLog as tables.

Sketches are long tables (a row for each cell that is not empty), so building is an aggregation with a partial step before the
shuffle, merging is another aggregation of the same kind, and probing is a join. Hash i of an element is the first 8 bytes
of MD5(element, seed i), unsigned, modulo the width; base seed 0 makes results repeatable.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import seeded_md5, seeds, unsigned_mod


def bloom_size(n: int, fpr: float) -> tuple[int, int]:
    """Width m and hashes k of a Bloom filter for n elements."""
    if n <= 0 or not 0 < fpr < 1:
        raise ValueError("a Bloom filter needs elements and a rate between 0 and 1")
    m = math.ceil(n * abs(math.log(fpr)) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def cms_size(epsilon: float, delta: float) -> tuple[int, int]:
    """Width m and rows k of a count-min sketch."""
    if epsilon <= 0 or not 0 < delta < 1:
        raise ValueError("a count-min sketch needs an error above 0 and a probability between 0 and 1")
    return math.ceil(math.e / epsilon), math.ceil(math.log(math.e / delta))


def cells(elements: DataFrame, element: Column, m: int, k: int, *keep: str) -> DataFrame:
    """keep, i, j for each element and hash function."""
    rows = elements.select(*keep, element.cast("string").alias("_e"), F.explode(seeds(k)).alias("_s"))
    return rows.select(*keep, F.col("_s.i").alias("i"), unsigned_mod(seeded_md5(F.col("_e"), F.col("_s.seed")), m).alias("j"))


def bloom(elements: DataFrame, element: Column, m: int, k: int) -> DataFrame:
    """The positions that are set."""
    return cells(elements, element, m, k).select(F.col("j").alias("position")).distinct()


def bloom_find(filter_: DataFrame, probes: DataFrame, probe: str, m: int, k: int) -> DataFrame:
    """probe, found: whether all its positions are set."""
    asked = cells(probes.select(probe).distinct(), F.col(probe), m, k, probe)
    hit = asked.join(filter_.withColumn("_set", F.lit(1)), on=F.col("j") == F.col("position"), how="left")
    return hit.groupBy(probe).agg((F.min(F.coalesce("_set", F.lit(0))) == 1).alias("found"))


def cms(elements: DataFrame, element: Column, m: int, k: int) -> DataFrame:
    """i, j, n of the cells that are not 0. Equal elements are counted before they are hashed."""
    counts = elements.groupBy(element.cast("string").alias("_e")).agg(F.count("*").alias("_n"))
    return cells(counts, F.col("_e"), m, k, "_n").groupBy("i", "j").agg(F.sum("_n").alias("n"))


def cms_count(sketch: DataFrame, probes: DataFrame, probe: str, m: int, k: int) -> DataFrame:
    """probe, estimate: the least of its cells."""
    asked = cells(probes.select(probe).distinct(), F.col(probe), m, k, probe)
    hit = asked.join(sketch, on=["i", "j"], how="left")
    return hit.groupBy(probe).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def hll_cell(element: Column, p: int) -> tuple[Column, Column]:
    """Bucket and value of an element: the first p bits, and the zero bits at the end, of the text of the MD5's characters."""
    if not 4 <= p <= 16:
        raise ValueError("precision is 4 to 16")
    h = F.md5(element.cast("string").cast("binary"))
    head = F.concat(*[F.lpad(F.bin(F.ascii(F.substring(h, c, 1)).cast("bigint")), 8, "0") for c in (1, 2)])
    bits = F.bin(F.ascii(F.substring(h, 32, 1)).cast("bigint"))
    return F.conv(F.substring(head, 1, p), 2, 10).cast("bigint"), (F.length(bits) - F.length(F.rtrim(bits, F.lit("0")))).cast("bigint")


def hll(elements: DataFrame, element: Column, p: int, *by: str) -> DataFrame:
    """by, bucket, value of the registers that are not 0."""
    bucket, value = hll_cell(element, p)
    rows = elements.select(*by, bucket.alias("bucket"), value.alias("value"))
    return rows.groupBy(*by, "bucket").agg(F.max("value").alias("value")).filter("value > 0")


def hll_estimate(registers: DataFrame, p: int, *by: str) -> DataFrame:
    """by, estimate. Of such registers the raw estimate never leaves the small range and some are always empty, so it is
    m ln(m / empty)."""
    m = 1 << p
    used = registers.groupBy(*by).agg(F.count("*").alias("_used"))
    return used.select(*by, F.round(m * F.log(F.lit(float(m)) / (m - F.col("_used"))), 6).alias("estimate"))
