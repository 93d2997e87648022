"""The versioned key-value log: where it comes from, how it is written, and its views.

A log is a DataFrame (key string, value string, tombstone tinyint, ts bigint, seq bigint), append-only; (ts, seq) orders the
versions of a key. Nothing here collects the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, RESERVED, Config

COLUMNS = ("key", "value", "tombstone", "ts", "seq")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log: one key a user, an error deletes the key."""
    ts = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    key = F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(key.alias("key"), F.col("event_type").alias("value"), (F.col("event_type") == "error").cast("tinyint").alias("tombstone"), ts.alias("ts"), F.col("event_id").alias("seq"))


def put(key: Column, value: Column, ts: Column, seq: Column) -> list[Column]:
    """The columns of a put; delete() those of a delete."""
    return [key.alias("key"), value.alias("value"), F.lit(0).cast("tinyint").alias("tombstone"), ts.cast("bigint").alias("ts"), seq.cast("bigint").alias("seq")]


def delete(key: Column, ts: Column, seq: Column) -> list[Column]:
    return [key.alias("key"), F.lit(None).cast("string").alias("value"), F.lit(1).cast("tinyint").alias("tombstone"), ts.cast("bigint").alias("ts"), seq.cast("bigint").alias("seq")]


def reserved(key: Column) -> Column:
    """Keys that users may not write or see. Empty keys are reserved too."""
    return key.rlike("^(" + "|".join(RESERVED) + ")") | (key == "")


def run_of(seq: Column, config: Config = DEFAULT) -> Column:
    return F.floor(seq / config.run_size).cast("bigint")


def latest(log: DataFrame, *also_by: str) -> DataFrame:
    """The newest version of each key, deletes included. Spark keeps the first row of each key before the shuffle too, so a hot
    key costs one row for each task."""
    order = Window.partitionBy(*also_by, "key").orderBy(F.desc("ts"), F.desc("seq"))
    return log.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def live(log: DataFrame) -> DataFrame:
    """The newest version of each key that isn't deleted. Filters on key reach the scan."""
    return latest(log).filter("tombstone = 0")


def remove_keys(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The log without any version of the keys: unlike a delete, nothing is left to hide them."""
    return log.join(keys.select("key").distinct(), on="key", how="left_anti")


def append(log: DataFrame, path: str) -> None:
    """Append a batch of the log; the rows of a file are sorted by key."""
    log.select(*COLUMNS).sortWithinPartitions("key", "ts", "seq").write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A log or run that was written. A path without files is an empty log."""
    schema = "key string, value string, tombstone tinyint, ts bigint, seq bigint"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
