"""Named, stored sketches: Bloom filters, count-min sketches, HyperLogLogs and SimHash widths.

A store is a folder. `made` has a row for each sketch that was created: kind, name, version and its two parameters; creating a sketch anew
makes a later, empty version. `cells` has the cells of every batch that was added, by kind and version: an addition appends the
cells of its batch and reads nothing, and what a sketch holds is an aggregation of them (set, sum, maximum). compact() puts one row in
the place of each cell's rows. Additions name their sketch by a column, so one job adds to any number of sketches.

Names that were not created are not added to, and answers are null for them. A filter is sized for `n` elements; sized() takes the number
from the elements themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.hashing import seed_hex, seeded_md5, unsigned_mod
from tidemark.operators import sketch
from tidemark.sources.tables import children, remove

_MADE = "kind string, name string, version bigint, width bigint, depth bigint"
_CELLS = "name string, i int, j bigint, n bigint, kind string, version bigint"
KINDS = ("bf", "cms", "hll", "sh")


def bloom_parameters(n: int, fpr: float) -> tuple[int, int]:
    return sketch.bloom_size(n, fpr)


def cms_parameters(epsilon: float, delta: float) -> tuple[int, int]:
    return sketch.cms_size(epsilon, delta)


def hll_parameters(p: int) -> tuple[int, int]:
    if not 4 <= p <= 16:
        raise ValueError("precision is 4 to 16")
    return 1 << p, p


def simhash_parameters(bits: int) -> tuple[int, int]:
    if not 0 < bits <= 256:
        raise ValueError("a fingerprint has 1 to 256 bits")
    return bits, 0


def made(spark: SparkSession, path: str) -> DataFrame:
    """kind, name, version, width, depth of each sketch: its newest version."""
    if not children(spark, f"{path}/made"):
        return spark.createDataFrame([], _MADE)
    newest = Window.partitionBy("kind", "name").orderBy(F.desc("version"))
    rows = spark.read.schema(_MADE).parquet(f"{path}/made")
    return rows.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def create(spark: SparkSession, path: str, kind: str, names: list[str], width: int, depth: int) -> None:
    """Make empty sketches, in place of those that have the names."""
    if kind not in KINDS:
        raise ValueError(f"a sketch is one of {', '.join(KINDS)}")
    version = (made(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    spark.createDataFrame([(kind, x, version, width, depth) for x in names], _MADE).coalesce(1).write.mode("append").parquet(f"{path}/made")


def sized(elements: DataFrame, element: Column, fpr: float) -> tuple[int, int]:
    """Parameters of a Bloom filter for the different elements of a table; of an empty one, for one element."""
    return bloom_parameters(max(1, elements.select(element.cast("string")).distinct().count()), fpr)


def _hashed(rows: DataFrame) -> DataFrame:
    """name, version, width, depth, e and other columns -> a row for each hash function, with its cell i, j."""
    spread = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("depth").cast("int") - 1)))
    seed = F.concat(F.lpad(F.hex("i"), 8, "0"), F.lit(seed_hex(0)[8:]))
    digest = seeded_md5(F.col("e"), seed)
    return spread.withColumn("j", unsigned_mod(digest, F.col("width")))


def _cells_of(kind: str, known: DataFrame, counted: DataFrame) -> DataFrame | None:
    rows = counted.join(known, on="name")
    if kind != "hll":
        hashed = _hashed(rows)
        cells = (hashed.withColumn("i", F.lit(0)) if kind == "bf" else hashed).groupBy("name", "version", "i", "j")  # a filter's hashes share its bits
        return cells.agg((F.sum("c") if kind == "cms" else F.max(F.lit(1).cast("bigint"))).alias("n"))
    out = None
    for p in sorted(r[0] for r in known.select("depth").distinct().collect()):  # at most 13 precisions
        bucket, value = sketch.hll_cell(F.col("e"), p)
        part = rows.filter(F.col("depth") == p).select("name", "version", F.lit(0).alias("i"), bucket.alias("j"), value.alias("n"))
        out = part if out is None else out.unionByName(part)
    return out if out is None else out.groupBy("name", "version", "i", "j").agg(F.max("n").alias("n")).filter("n > 0")


def add(spark: SparkSession, path: str, kind: str, elements: DataFrame, name: Column, element: Column) -> None:
    """Add the elements of a table to the sketches that a column names. Equal elements are counted before they are hashed."""
    if kind not in KINDS[:3]:
        raise ValueError("nothing is added to such a sketch")
    known = made(spark, path).filter(F.col("kind") == kind).drop("kind")
    counted = elements.select(name.cast("string").alias("name"), element.cast("string").alias("e")).filter("e IS NOT NULL").groupBy("name", "e").agg(F.count("*").alias("c"))
    out = _cells_of(kind, known, counted)
    if out is not None:
        _append(out.withColumn("kind", F.lit(kind)), path)


def _append(cells: DataFrame, path: str) -> None:
    cells.select("name", "i", "j", "n", "kind", "version").write.partitionBy("kind", "version").parquet(f"{path}/cells/batch-{uuid.uuid4().hex}")


def cells(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """name, i, j, n of what the newest versions of a kind hold."""
    batches = [f"{path}/cells/{x}" for x in children(spark, f"{path}/cells")]
    if not batches:
        return spark.createDataFrame([], "name string, i int, j bigint, n bigint")
    rows = None
    for at in batches:
        part = spark.read.schema(_CELLS).parquet(at).filter(F.col("kind") == kind)
        rows = part if rows is None else rows.unionByName(part)
    known = made(spark, path).filter(F.col("kind") == kind).select("name", "version")
    how = {"bf": F.max, "hll": F.max, "cms": F.sum}[kind]
    return rows.join(known, on=["name", "version"]).groupBy("name", "i", "j").agg(how("n").alias("n"))


def compact(spark: SparkSession, path: str) -> None:
    """One batch in the place of all: the newest versions, each cell once. The old batches go once the new one is there; it is written
    aside and renamed, so that no reader sees both."""
    old = children(spark, f"{path}/cells")
    if not old:
        return
    whole = None
    for kind in KINDS[:3]:
        known = made(spark, path).filter(F.col("kind") == kind).select("name", "version")
        part = cells(spark, path, kind).join(known, on="name").withColumn("kind", F.lit(kind))
        whole = part if whole is None else whole.unionByName(part)
    aside = f"{path}/aside-{uuid.uuid4().hex}"
    whole.select("name", "i", "j", "n", "kind", "version").write.partitionBy("kind", "version").parquet(aside)
    for x in old:
        remove(spark, f"{path}/cells/{x}")
    jvm = spark._jvm.org.apache.hadoop.fs
    jvm.Path(aside).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(jvm.Path(aside), jvm.Path(f"{path}/cells/batch-{uuid.uuid4().hex}"))


def _asked(spark: SparkSession, path: str, kind: str, probes: DataFrame, name: Column, probe: Column) -> DataFrame:
    known = made(spark, path).filter(F.col("kind") == kind).drop("kind")
    asked = probes.select(name.cast("string").alias("name"), probe.cast("string").alias("e")).distinct()
    held, at = cells(spark, path, kind), ["name", "i", "j"]
    return _hashed(asked.join(known, on="name")).join(held.drop("i") if kind == "bf" else held, on=["name", "j"] if kind == "bf" else at, how="left")


def find(spark: SparkSession, path: str, probes: DataFrame, name: Column, probe: Column) -> DataFrame:
    """name, element, found: whether a Bloom filter may have it."""
    hit = _asked(spark, path, "bf", probes, name, probe).groupBy("name", "e")
    return hit.agg((F.min(F.coalesce("n", F.lit(0))) == 1).alias("found")).withColumnRenamed("e", "element")


def count(spark: SparkSession, path: str, probes: DataFrame, name: Column, probe: Column) -> DataFrame:
    """name, element, estimate: how often a count-min sketch has seen it, or more."""
    hit = _asked(spark, path, "cms", probes, name, probe).groupBy("name", "e")
    return hit.agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate")).withColumnRenamed("e", "element")


def estimate(spark: SparkSession, path: str) -> DataFrame:
    """name, estimate: how many different elements each HyperLogLog has seen."""
    used = cells(spark, path, "hll").groupBy("name").agg(F.count("*").alias("_used"))
    known = made(spark, path).filter("kind = 'hll'").select("name", F.col("width").cast("double").alias("_m"))
    out = known.join(used, on="name", how="left")
    return out.select("name", F.round(F.col("_m") * F.log(F.col("_m") / (F.col("_m") - F.coalesce("_used", F.lit(0)))), 6).alias("estimate"))


def compare(spark: SparkSession, path: str, name: str, pairs: DataFrame, id_col: str, first: str, second: str) -> DataFrame:
    """id, distance of the fingerprints of two text columns, as wide as the stored name says."""
    row = made(spark, path).filter((F.col("kind") == "sh") & (F.col("name") == name)).select("width").first()
    if row is None:
        return pairs.select(id_col, F.lit(None).cast("bigint").alias("distance"))
    return text.compare(pairs, id_col, first, second, row["width"])
