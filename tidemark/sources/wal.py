"""The write-ahead log as views of the log: segments, replay, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.sources.log import latest


def with_segment(log: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Segments count from 1 and hold a fixed number of entries each."""
    return log.withColumn("segment", (F.floor(F.col("seq") / config.wal_segment_size) + 1).cast("bigint"))


def segments(log: DataFrame, config: Config = DEFAULT) -> DataFrame:
    out = with_segment(log, config).groupBy("segment")
    return out.agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum(F.col("tombstone").cast("bigint")).alias("deletes"))


def replay(log: DataFrame) -> DataFrame:
    """What a restart rebuilds: each key's newest version, deletes included."""
    return latest(log)


def after_truncate(log: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Emptying keeps the last segment with its entries, as segment 1."""
    cut = with_segment(log, config)
    last = cut.agg(F.max("segment").alias("last"))
    return cut.join(F.broadcast(last), on=F.col("segment") == F.col("last")).drop("last", "segment").withColumn("segment", F.lit(1).cast("bigint"))


def trim(log: DataFrame, low_water_mark: int, config: Config = DEFAULT) -> DataFrame:
    """Drop the segments up to the mark and number the others from 1."""
    return with_segment(log, config).filter(F.col("segment") > low_water_mark).withColumn("segment", F.col("segment") - low_water_mark)
