"""SimHash of texts.

Words are what stands between single spaces (empty ones count), after lowering and without , . ? !. A word that occurs c times
weighs c for each occurrence, so c * c. A word's bits are the bits of the characters of its hex MD5. Bit j of the fingerprint is
1 if the weights of words with the bit outweigh those without. A null text is an empty one.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Combinations of pieces that fingerprints are joined on, at most.
MAX_KEYS = 64
#: Fingerprints of a key up to which one task compares them all.
BLOCK = 4096
#: Keys with more fingerprints up to this number are broadcast.
BROADCAST_KEYS = 200_000


def tokens(text: Column) -> Column:
    return F.split(F.translate(F.lower(text), ",.?!", ""), " ", -1)


def token_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = texts.select(F.col(id_col), F.explode(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("token"))
    return words.groupBy(id_col, "token").agg(F.count("*").alias("n"))


def fingerprints(texts: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """id, fingerprint (text of 0 and 1). A word's MD5 is taken once for each text that has it."""
    if not 0 < bits <= 256:
        raise ValueError("a fingerprint has 1 to 256 bits")
    rows = token_counts(texts, id_col, text_col).select(id_col, (F.col("n") * F.col("n")).alias("w"), F.md5(F.col("token").cast("binary")).alias("h"))
    eight = lambda k: F.conv(F.hex(F.substring("h", 8 * k + 1, 8)), 16, 10).cast("bigint").alias(f"h{k}")
    rows = rows.select(id_col, "w", *[eight(k) for k in range(-(-bits // 64))]).repartition(id_col)  # partial sums would be longer than the words
    bit = lambda j: F.shiftright(f"h{j // 64}", 63 - j % 64).bitwiseAND(F.lit(1))
    sums = rows.groupBy(id_col).agg(*[F.sum(F.col("w") * (2 * bit(j) - 1)).alias(f"b{j}") for j in range(bits)])
    return sums.select(id_col, F.concat(*[F.when(F.col(f"b{j}") > 0, "1").otherwise("0") for j in range(bits)]).alias("fingerprint"))


def hamming(a: Column, b: Column) -> Column:
    """Differing characters of two bit texts of the same length."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def compare(pairs: DataFrame, id_col: str, first: str, second: str, bits: int = 64) -> DataFrame:
    """id, distance of the fingerprints of two text columns."""
    one = fingerprints(pairs, id_col, first, bits).withColumnRenamed("fingerprint", "f1")
    two = fingerprints(pairs, id_col, second, bits).withColumnRenamed("fingerprint", "f2")
    return one.join(two, on=id_col).select(id_col, hamming(F.col("f1"), F.col("f2")).cast("bigint").alias("distance"))


def near(prints: DataFrame, id_col: str, bits: int, radius: int) -> DataFrame:
    """first, second, distance: the pairs of different fingerprints (each by its smallest id) that differ in at most `radius` bits.

    The bits are cut into radius + 3 pieces, of which three are equal in such a pair (fewer where that makes too many combinations, none
    where the radius is so large that all are compared). Fingerprints are joined on each combination's pieces and verified; a pair is made by the
    first pieces that it has in common. Keys with many fingerprints are compared in blocks of about BLOCK against BLOCK. Equal fingerprints
    are one row before the join, so copies make no pairs.
    """
    if not 0 <= radius < bits:
        raise ValueError("the radius is less than the bits")
    extra = max((k for k in (1, 2, 3) if comb(radius + k, k) <= MAX_KEYS), default=0)
    n = min(bits, max(radius + extra if extra else 1, -(-bits // 62)))  # a piece is a bigint
    cuts = [bits * i // n for i in range(n + 1)]
    combos = list(combinations(range(n), n - radius)) if extra else [()]
    heads = prints.groupBy("fingerprint").agg(F.min(id_col).alias("id"))
    pieces = [F.conv(F.substring("fingerprint", a + 1, b - a), 2, 10).cast("bigint").alias(f"p{i}") for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows = heads.filter("fingerprint IS NOT NULL").select("id", *pieces)
    key = lambda at, c: F.xxhash64(F.lit(at), *[f"p{i}" for i in c]).alias("key")
    places = F.array(*[F.struct(key(at, c), F.lit(sum(1 << i for i in c)).cast("bigint").alias("shared"), F.lit((2 << max(c, default=-1)) - 1 if c else 0).cast("bigint").alias("upto")) for at, c in enumerate(combos)])
    keyed = rows.select("*", F.inline(places))

    many = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("of"))
    many = F.broadcast(many) if many.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else many
    dealt = keyed.join(many, on="key", how="left").withColumn("of", F.coalesce("of", F.lit(1)))
    block = F.pmod(F.xxhash64(*[f"p{i}" for i in range(n)]), F.col("of")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("of") - 1))
    one = dealt.withColumn("row", block).withColumn("column", every).drop("of")
    two = dealt.withColumn("column", block).withColumn("row", every).select("key", "row", "column", F.col("id").alias("id_b"), *[F.col(f"p{i}").alias(f"q{i}") for i in range(n)])

    distance = reduce(add, [F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(n)])
    same = reduce(add, [F.when(F.col(f"p{i}") == F.col(f"q{i}"), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(n)])
    pairs = one.join(two, on=["key", "row", "column"]).filter(F.col("id") < F.col("id_b")).filter(distance <= radius)
    pairs = pairs.filter(same.bitwiseAND(F.col("upto")) == F.col("shared"))
    return pairs.select(F.col("id").alias("first"), F.col("id_b").alias("second"), distance.cast("bigint").alias("distance"))
