"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for the contracts that lower ASCII only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words between ASCII white space, as a Java regex and, with the same text, as RE2.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


#: Vectored reads keep a direct buffer of a whole column chunk in every thread of a growing pool; with long texts that is
#: more than the heap. Plain reads stream the chunk.
READ = {"parquet.hadoop.vectored.io.enabled": "false"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.options(**READ).parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def crc_bucket(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def md5_fraction(col: Column) -> Column:
    """The first 32 bits of the md5 of a string column, as a bigint below 2**32."""
    return F.conv(F.substring(F.md5(col.cast("binary")), 1, 8), 16, 10).cast("bigint")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset, one of our own on this machine, if Spark runs
    on no other."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir()
    return where.rstrip("/")


#: Paths of the tables of materialise() that are still there.
_written: dict[str, None] = {}


def written() -> list[str]:
    return list(_written)


def materialise(df: DataFrame, what: str, *, release: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage and computes it once.

    release: the plan behind it shuffled whole texts. Spark deletes shuffle files when the driver has collected the plan as garbage,
    which a large driver seldom does by itself; this asks for it.
    """
    path = f"{shared_dir(df.sparkSession)}/tidemark-{what}-{uuid.uuid4().hex}"
    _written[path] = None
    df.write.parquet(path)
    if release:
        gc.collect()
        df.sparkSession._jvm.System.gc()
    out = df.sparkSession.read.options(**READ).schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialise() that no later plan reads."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        discard_paths(df.sparkSession, [path])


def discard_paths(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        _written.pop(path, None)


def join_lookup(left: DataFrame, lookup: DataFrame, keys: list[str], rows: int, spread: Column, limit: int = 200_000, salts: int = 64) -> DataFrame:
    """Inner join with a lookup table of `rows` rows, one for each key. Up to `limit` rows it is broadcast; beyond, the
    lookup is repeated for each of `salts` salts and the left side spread over them, so that no hot key is one task.
    spread: a bigint column of left that differs between rows of one key. Null keys match null keys."""
    same = lambda a, b: [a[f"_k{i}"].eqNullSafe(b[f"_j{i}"]) for i in range(len(keys))]
    a = left.withColumns({f"_k{i}": F.col(k) for i, k in enumerate(keys)})
    b = lookup.withColumnsRenamed({k: f"_j{i}" for i, k in enumerate(keys)})
    if rows <= limit:
        out = a.join(F.broadcast(b), on=same(a, b), how="inner")
    else:
        a = a.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
        b = b.withColumn("_salt_j", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = a.join(b, on=[*same(a, b), a["_salt"] == b["_salt_j"]], how="inner").drop("_salt", "_salt_j")
    return out.drop(*[f"_k{i}" for i in range(len(keys))], *[f"_j{i}" for i in range(len(keys))])
