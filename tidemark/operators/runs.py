"""Sorted runs: flush, index and summary, pruning, merge and compaction.

Runs are rows (level, run, key, value, tombstone, ts, seq). Of the versions of a key, the one with the greatest (ts, seq) wins;
deletes are kept by every merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.sources.log import latest, run_of
from tidemark.sources.tables import written


def flush(log: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Level-0 runs: each batch of the log, with one version a key."""
    return latest(log.withColumn("run", run_of(F.col("seq"), config)), "run")


def index(runs: DataFrame) -> DataFrame:
    """Each key's place in its run."""
    order = Window.partitionBy("run").orderBy("key")
    return runs.select("run", "key", (F.row_number().over(order) - 1).cast("bigint").alias("position"))


def ranges(runs: DataFrame, *by: str) -> DataFrame:
    """Start, stop and number of keys of each run."""
    return runs.groupBy(*(by or ("run",))).agg(F.min("key").alias("start"), F.max("key").alias("stop"), F.count("*").alias("n"))


def summary(runs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The sparse index: the first and last key of a run and every (n div summary_count)-th, with the run's start and stop."""
    step = F.when(F.col("n") <= config.summary_count, F.lit(1)).otherwise(F.floor(F.col("n") / config.summary_count)).cast("bigint")
    rows = index(runs).join(ranges(runs), on="run")
    last = F.col("position") == F.col("n") - 1
    sampled = (F.col("position") == 0) | last | ((F.col("position") + 1) % step == 0)
    return rows.filter(sampled).select("run", "start", "stop", "key", "position")


def prune(runs: DataFrame, start: str, stop: str) -> DataFrame:
    """Runs that may hold a key between start and stop; a point is a range of one key."""
    return ranges(runs).filter((F.col("start") <= stop) & (F.col("stop") >= start))


def prune_prefix(runs: DataFrame, prefix: str) -> DataFrame:
    """Runs that may hold a key with the prefix: stop is not below it, and start is below all that follows it."""
    after = F.col("start") < prefix
    return ranges(runs).filter((F.col("stop") >= prefix) & (after | F.col("start").startswith(prefix)))


#: Tenths of the runs, by age, at which the levels after level 0 begin.
LEVEL_TENTHS = (1, 3, 6)


def with_level(runs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Deal runs to levels by age: the newest tenth to level 0, the next two to level 1, the next three to level 2, the others to level 3, as
    far as there are levels. This is for logs that carry no levels; those of a store are in its manifest."""
    newest = runs.agg(F.max("run").alias("newest"))
    tenth = F.floor((F.col("newest") - F.col("run")) * 10 / (F.col("newest") + 1))
    level = sum(((tenth >= x).cast("bigint") for x in LEVEL_TENTHS), F.lit(0).cast("bigint"))
    return runs.crossJoin(F.broadcast(newest)).withColumn("level", F.least(level, F.lit(config.lsm_levels - 1)).cast("bigint")).drop("newest")


def read_order(runs: DataFrame) -> DataFrame:
    """The order in which a read visits runs: levels up, newest run first. The ranks are taken in each level and follow on the sizes of
    the levels before it, which are few."""
    each = runs.select("level", "run").distinct()
    ahead = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    before = each.groupBy("level").agg(F.count("*").alias("_n")).select("level", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    visit = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("run"))) + F.col("_before")
    return each.join(F.broadcast(before), on="level").select("level", "run", visit.cast("bigint").alias("visit"))


def merge(*runs: DataFrame) -> DataFrame:
    """One run of several; deletes stay."""
    out = runs[0]
    for other in runs[1:]:
        out = out.unionByName(other)
    return latest(out)


def merge_neighbours(runs: DataFrame) -> DataFrame:
    """Every two neighbouring runs as one: pair, and the newest versions of its keys."""
    return latest(runs.withColumn("pair", F.floor(F.col("run") / 2).cast("bigint")), "pair")


def chunks(merged: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Cut a merged run into output runs of sstable_size keys.

    The rows are written once, by ranges of keys that Spark samples; ranks are taken inside the ranges, and the ranges' sizes, of which
    there are as many as partitions, are added up. No task sees more than a range, whatever the keys look like.
    """
    placed = written(merged.repartitionByRange("key").withColumn("_range", F.spark_partition_id()), "chunks")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    rank = F.col("_ahead") + F.row_number().over(Window.partitionBy("_range").orderBy("key")) - 1
    return placed.join(sizes, on="_range").withColumn("chunk", F.floor(rank / config.sstable_size).cast("bigint")).drop("_range", "_ahead")


def size_tiered(runs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The runs of each level but the last as one run of the next."""
    merged = latest(runs.filter(F.col("level") < config.lsm_levels - 1), "level")
    return merged.withColumn("level", (F.col("level") + 1).cast("bigint"))


def triggers(runs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Runs by level, and whether either strategy compacts the level: size-tiered from lsm_max_per_level runs on, leveled beyond
    the level's own limit."""
    limits = F.element_at(F.array(*[F.lit(x) for x in config.leveled_max_runs]), (F.col("level") + 1).cast("int"))
    counts = runs.select("level", "run").distinct().groupBy("level").agg(F.count("*").alias("runs"))
    return counts.select("level", "runs", (F.col("runs") >= config.lsm_max_per_level).alias("size_tiered_due"), (F.col("runs") > limits).alias("leveled_due"))


def overlap_of(ranges_: DataFrame) -> DataFrame:
    """Pairs of runs of neighbouring levels whose key ranges meet, from a row a run: level, run, start, stop. level is an equi-join key."""
    below = ranges_.select((F.col("level") - 1).alias("level"), F.col("run").alias("below"), F.col("start").alias("start_b"), F.col("stop").alias("stop_b"))
    return ranges_.join(below, on="level").filter((F.col("start") <= F.col("stop_b")) & (F.col("stop") >= F.col("start_b"))).select("level", "run", "below")


def overlap(runs: DataFrame) -> DataFrame:
    return overlap_of(ranges(runs, "level", "run"))


def leveled_zero(runs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """All runs of levels 0 and 1, merged and cut into runs of level 1."""
    return chunks(latest(runs.filter("level <= 1")).drop("level", "run"), config).withColumn("level", F.lit(1).cast("bigint"))


def leveled_down(runs: DataFrame, level: int, config: Config = DEFAULT, manifest: DataFrame | None = None) -> DataFrame:
    """The runs of a level, moved down: merged with those runs of the next level that overlap one of them, cut anew. manifest: level, run,
    start, stop of the runs, where they are known."""
    known = ranges(runs, "level", "run") if manifest is None else manifest
    hit = overlap_of(known.filter(F.col("level").between(level, level + 1))).select(F.col("below").alias("run")).distinct()
    hit = hit.select(F.lit(level + 1).cast("bigint").alias("level"), "run").unionByName(known.filter(F.col("level") == level).select("level", "run"))
    both = runs.filter(F.col("level").between(level, level + 1)).join(hit, on=["level", "run"], how="left_semi")
    return chunks(latest(both).drop("level", "run"), config).withColumn("level", F.lit(level + 1).cast("bigint"))


def memtable(log: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The newest batch, not yet flushed: one version a key, deletes included."""
    runs = log.withColumn("run", run_of(F.col("seq"), config))
    newest = runs.agg(F.max("run").alias("newest"))
    return latest(runs.join(F.broadcast(newest), on=F.col("run") == F.col("newest")).drop("newest", "run"))


def overlay(flushed: DataFrame, in_memory: DataFrame) -> DataFrame:
    """What a scan sees: the memtable over the runs, without deleted keys."""
    columns: list[str | Column] = ["key", "value", "tombstone", "ts", "seq"]
    return merge(flushed.select(*columns), in_memory.select(*columns)).filter("tombstone = 0")
