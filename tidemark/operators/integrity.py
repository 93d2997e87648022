"""Record checksums and Merkle roots."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _little_endian(number: Column) -> Column:
    """A bigint as 8 bytes, lowest first."""
    text = F.lpad(F.hex(number), 16, "0")
    return F.unhex(F.concat(*[F.substring(text, at, 2) for at in range(15, 0, -2)]))


def encode(key: Column, value: Column, tombstone: Column, ts: Column) -> Column:
    """A record's bytes after its checksum: time, deletion flag, key and value with their lengths."""
    k, v = key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b""))
    flag = F.unhex(F.lpad(F.hex(tombstone.cast("bigint")), 2, "0"))
    return F.concat(_little_endian(ts), flag, _little_endian(F.octet_length(k).cast("bigint")), k, _little_endian(F.octet_length(v).cast("bigint")), v)


def record_crc(log: DataFrame) -> DataFrame:
    """seq, key, record_crc (of the encoded record) and value_crc (which the write-ahead log has)."""
    record = encode(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts"))
    return log.select("seq", "key", F.crc32(record).alias("record_crc"), F.crc32(F.coalesce(F.col("value").cast("binary"), F.lit(b""))).alias("value_crc"))


def bad_records(log: DataFrame, stored: DataFrame) -> DataFrame:
    """seq of the records whose stored checksum (seq, record_crc) is another."""
    return record_crc(log).join(stored.select("seq", F.col("record_crc").alias("_stored")), on="seq").filter("record_crc <> _stored").select("seq", "key")


def merkle_roots(leaves: DataFrame, by: list[str], order: str, data: Column) -> DataFrame:
    """by, root of each group: hex SHA-1 over its leaves in the order of a column, padded to a power of two with the empty text.
    Positions beyond the leaves hold the digest of nothing, and whole empty subtrees their known digest, so no padding rows are made.

    A group's leaves get their places from one sort. For a group too large for that, take the parts' roots as leaves.
    """
    place = Window.partitionBy(*by).orderBy(order)
    whole = Window.partitionBy(*by)
    nodes = leaves.select(*by, (F.row_number().over(place) - 1).cast("bigint").alias("p"), F.count(F.lit(1)).over(whole).alias("_n"), F.sha1(data.cast("binary")).alias("h"))
    nodes = nodes.withColumn("height", F.when(F.col("_n") > 1, F.length(F.bin(F.col("_n") - 1))).otherwise(0)).drop("_n")
    most = leaves.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    empty = hashlib.sha1(b"").hexdigest()
    for step in range((most - 1).bit_length() if most else 0):
        open_ = F.col("height") > step
        side = lambda s, p=F.col("p"): F.max(F.when(p % 2 == s, F.col("h")))
        pairs = nodes.groupBy(*by, "height", F.floor(F.col("p") / 2).cast("bigint").alias("q")).agg(side(0).alias("l"), side(1).alias("r"))
        both = F.sha1(F.concat(F.unhex("l"), F.unhex(F.coalesce("r", F.lit(empty)))))
        nodes = pairs.select(*by, "height", F.col("q").alias("p"), F.when(open_, both).otherwise(F.col("l")).alias("h"))
        empty = hashlib.sha1(bytes.fromhex(empty) * 2).hexdigest()
    return nodes.select(*by, F.col("h").alias("root"))


def merkle_root(leaves: DataFrame, order: str, data: Column) -> DataFrame:
    """One row, root, of a table's leaves; null of no leaf."""
    one = leaves.sparkSession.range(1).select(F.lit(0).alias("_all"))
    roots = merkle_roots(leaves.withColumn("_all", F.lit(0)), ["_all"], order, data)
    return one.join(roots, on="_all", how="left").select("root")
