"""Sorted runs on disk: a manifest, flushes, compactions that write, number and retire runs, and reads that skip runs.

A store is a folder of runs, `level=L/run=N`, and of manifests, `manifest/v=K`; the manifest with the greatest number tells which
runs there are: level, run, start, stop, n (of keys) and root (its Merkle root). A flush or compaction writes its runs first, then the
next manifest, and removes the runs it has replaced last, so that a job that dies leaves a store as it was, with folders that no manifest
names. There is one writer at a time. Numbers of runs grow within a level and are not used again.

Runs are ranges of keys within a level of a leveled store, one run a batch in a size-tiered one. What a manifest has is a row for a
run, and only the rows of the runs that an operation is about come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, Config
from tidemark.operators import integrity, runs
from tidemark.sources.log import COLUMNS, latest
from tidemark.sources.tables import children, new_folder, remove, written

_MANIFEST = "level bigint, run bigint, start string, stop string, n bigint, root string"
_VERSIONS = "key string, value string, tombstone tinyint, ts bigint, seq bigint"


class RunStore:
    def __init__(self, spark: SparkSession, path: str, config: Config = DEFAULT):
        self.spark, self.path, self.config = spark, path, config

    def _version(self) -> int:
        return max((int(x[2:]) for x in children(self.spark, f"{self.path}/manifest") if x.startswith("v=")), default=0)

    def manifest(self) -> DataFrame:
        """level, run, start, stop, n, root of each run."""
        version = self._version()
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={version}")

    def _folder(self, level: int, run: int) -> str:
        return f"{self.path}/level={level}/run={run}"

    def rows(self, which: DataFrame | None = None) -> DataFrame:
        """level, run and the versions of all runs, or of those in a part of the manifest."""
        found = (self.manifest() if which is None else which).select("level", "run").collect()
        if not found:
            return self.spark.createDataFrame([], f"level bigint, run bigint, {_VERSIONS}")
        read = self.spark.read.schema(f"{_VERSIONS}, level bigint, run bigint").option("basePath", self.path)
        return read.parquet(*[self._folder(*x) for x in found]).select("level", "run", *COLUMNS)

    def next_run(self, level: int) -> int:
        last = self.manifest().filter(F.col("level") == level).agg(F.max("run")).first()[0]
        folders = [int(x[4:]) for x in children(self.spark, f"{self.path}/level={level}") if x.startswith("run=")]
        return max([last if last is not None else -1, *folders]) + 1

    def add(self, rows: DataFrame, retired: DataFrame | None = None) -> None:
        """Write rows (level, run, versions) as runs, sorted by key, and the manifest that has them and not the retired ones."""
        aside = new_folder(self.spark, "runs")
        ranged = rows.select("level", "run", *COLUMNS).repartitionByRange("level", "run", "key").sortWithinPartitions("level", "run", "key")
        ranged.write.partitionBy("level", "run").option("parquet.bloom.filter.enabled#key", "true").parquet(aside)
        new = self.spark.read.schema(f"{_VERSIONS}, level bigint, run bigint").parquet(aside)
        roots = integrity.merkle_roots(new, ["level", "run"], "key", integrity.encode(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts")))
        entries = runs.ranges(new, "level", "run").join(roots, on=["level", "run"]).select("level", "run", "start", "stop", "n", "root")
        gone = [] if retired is None else retired.select("level", "run").collect()
        kept = self.manifest() if retired is None else self.manifest().join(retired.select("level", "run"), on=["level", "run"], how="left_anti")
        version = self._version() + 1
        entries = written(entries, "manifest")
        self._move(aside)
        kept.unionByName(entries).coalesce(1).write.parquet(f"{self.path}/manifest/v={version}")
        for x in gone:
            remove(self.spark, self._folder(*x))

    def _move(self, aside: str) -> None:
        """The run folders that were written aside become the store's."""
        jvm, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration()
        files = jvm.Path(self.path).getFileSystem(conf)
        for level in (x for x in children(self.spark, aside) if x.startswith("level=")):
            files.mkdirs(jvm.Path(f"{self.path}/{level}"))
            for run in children(self.spark, f"{aside}/{level}"):
                files.rename(jvm.Path(f"{aside}/{level}/{run}"), jvm.Path(f"{self.path}/{level}/{run}"))
        remove(self.spark, aside)

    def flush(self, batch: DataFrame) -> None:
        """A batch of the log as a run of level 0: one version a key, deletes included."""
        self.add(latest(batch).select(F.lit(0).cast("bigint").alias("level"), F.lit(self.next_run(0)).cast("bigint").alias("run"), *COLUMNS))

    def due(self) -> DataFrame:
        """level, runs, size_tiered_due, leveled_due."""
        return runs.triggers(self.manifest(), self.config)

    def compact_size_tiered(self, level: int) -> None:
        """All runs of a level as one run of the next."""
        old = self.manifest().filter(F.col("level") == level)
        merged = latest(self.rows(old)).select(F.lit(level + 1).cast("bigint").alias("level"), F.lit(self.next_run(level + 1)).cast("bigint").alias("run"), *COLUMNS)
        self.add(merged, old)

    def compact_leveled(self, level: int) -> None:
        """The runs of a level, moved down: merged with those runs of the next level whose keys meet theirs (of level 0: with all),
        and cut into runs of sstable_size keys."""
        here = self.manifest().filter(F.col("level") == level)
        below = self.manifest().filter(F.col("level") == level + 1)
        if level:
            hit = runs.overlap_of(self.manifest()).filter(F.col("level") == level).select(F.col("below").alias("run")).distinct()
            below = below.join(hit, on="run", how="left_semi").select(*here.columns)
        old = here.unionByName(below)
        cut = runs.chunks(latest(self.rows(old)).drop("level", "run"), self.config)
        self.add(cut.select(F.lit(level + 1).cast("bigint").alias("level"), (F.col("chunk") + self.next_run(level + 1)).alias("run"), *COLUMNS), old)

    def compact(self, strategy: str = "size-tiered") -> None:
        """Every level in turn, from 0 to the last but one, where it is due."""
        if strategy not in ("size-tiered", "leveled"):
            raise ValueError("runs are compacted size-tiered or leveled")
        for level in range(self.config.lsm_levels - 1):
            due = self.due().filter(F.col("level") == level).first()
            if due and due["size_tiered_due" if strategy == "size-tiered" else "leveled_due"]:
                (self.compact_size_tiered if strategy == "size-tiered" else self.compact_leveled)(level)

    def get(self, keys: list[str]) -> DataFrame:
        """key, value of each key; reads only the runs that may have one of them."""
        asked = self.spark.createDataFrame([(k,) for k in keys], "key string")
        meets = (F.col("key") >= F.col("start")) & (F.col("key") <= F.col("stop"))
        which = self.manifest().join(F.broadcast(asked), on=meets, how="left_semi")
        found = latest(self.rows(which).filter(F.col("key").isin(*keys))).filter("tombstone = 0").select("key", "value")
        return asked.join(found, on="key", how="left")

    def range_scan(self, start: str, stop: str) -> DataFrame:
        which = self.manifest().filter((F.col("start") <= stop) & (F.col("stop") >= start))
        return latest(self.rows(which).filter(F.col("key").between(start, stop))).filter("tombstone = 0").select("key", "value")

    def prefix_scan(self, prefix: str) -> DataFrame:
        which = self.manifest().filter((F.col("stop") >= prefix) & ((F.col("start") < prefix) | F.col("start").startswith(prefix)))
        return latest(self.rows(which).filter(F.col("key").startswith(prefix))).filter("tombstone = 0").select("key", "value")

    def bad_runs(self) -> DataFrame:
        """level, run of the runs whose records no longer have the root that the manifest says."""
        roots = integrity.merkle_roots(self.rows(), ["level", "run"], "key", integrity.encode(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts")))
        now = self.manifest().join(roots.withColumnRenamed("root", "_now"), on=["level", "run"], how="left")
        return now.filter(~F.col("root").eqNullSafe(F.col("_now"))).select("level", "run")
