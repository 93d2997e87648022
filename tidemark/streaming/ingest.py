"""The log as a stream: an extension beyond the store's own operations, which are batches.

A stream of puts and deletes is folded into a table of each key's newest version; reads are those of tidemark.operators.scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.log import COLUMNS, latest, read

SCHEMA = "key string, value string, tombstone tinyint, ts bigint, seq bigint"


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The files of a log as they are appended."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def current(spark: SparkSession, table: str) -> DataFrame:
    """The newest versions that the stream has written, deletes included."""
    versions = read(spark, f"{table}/versions")
    return latest(versions)


def fold_into(stream: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch's newest versions to the table. A batch that is written again after a failure replaces its own
    folder, so every version is there once."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch.select(*COLUMNS)).write.mode("overwrite").parquet(f"{table}/versions/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(f"fold-{uuid.uuid4().hex[:8]}").trigger(**(trigger or {"availableNow": True})).start()
