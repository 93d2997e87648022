"""Point reads, prefix and range scans with pages.

Predicates on key stand on the live view; Catalyst moves them below its window and into the scan. Pages are cut in the order of
keys, of live keys only; a page size of 0 is an empty page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.log import live


def get(log: DataFrame, keys: list[str]) -> DataFrame:
    """key, value for each key that is asked for; value is null where there is none."""
    asked = log.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    found = live(log.filter(F.col("key").isin(*keys))).select("key", "value")
    return asked.join(found, on="key", how="left")


def multi_get(log: DataFrame, asked: DataFrame) -> DataFrame:
    """get() for a table of keys of any size."""
    wanted = asked.select("key").distinct()
    return wanted.join(live(log.join(wanted, on="key", how="left_semi")).select("key", "value"), on="key", how="left")


def page(rows: DataFrame, size: int, number: int) -> DataFrame:
    """Page `number` (from 0) of rows in the order of keys, with each row's place in the whole."""
    if size < 0 or number < 0:
        raise ValueError("page size and number must not be negative")
    return rows.orderBy("key").offset(size * number).limit(size)


def prefix_scan(log: DataFrame, prefix: str) -> DataFrame:
    return live(log).filter(F.col("key").startswith(prefix)).select("key", "value")


def range_scan(log: DataFrame, start: str, stop: str) -> DataFrame:
    """Both ends belong to the range; a stop before the start is empty."""
    return live(log).filter(F.col("key").between(start, stop)).select("key", "value")
