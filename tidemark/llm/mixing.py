"""Mixing sources to target weights by systematic sampling.

A source's expected copies a document are target / source size. Documents of a source stand in one order; their expected
copies are summed up as a prefix, one random offset of the source is added, and a document is emitted once for each
integer that its stretch of the prefix sum crosses.

The order is by size class (the size's first CLASS_BITS bits), then by a hashed sub-block, then by size: nearly by size, so that the copies
are spread evenly over sizes, and a source's words miss its target by about its largest document at most. The prefix sum has two levels:
sizes of the blocks (source, class, sub-block), which are few, and the rank inside a block; no task holds a whole source.

Defined results: a null text has size 0; a null source is a source, the last one; an empty table gives no rows; repeated
rows are documents of their own; a null doc_id is ordered as the empty text. Columns of the input are kept apart in a
struct, so that none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACED_WORD, join_lookup, materialise, md5_fraction

#: Leading bits of a size that make its class.
CLASS_BITS = 5
#: Rows of the table for each sub-block of a size class, and the most sub-blocks.
BLOCK_ROWS = 16_000
MAX_SUB_BLOCKS = 20_000
#: Weights of the sources in order, repeating, and the most copies of a source that its target may ask for.
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3


def size_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, size -> source, source_size, target. Sources get weights in code point order (null last) and share the
    total; a target stops at max_copies times its source's size and the excess goes to the others by weight.

    In ascending order of cap / weight, a source is capped if its cap is below its share of what the ones before left.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sizes.select("source", F.col("size").alias("source_size"), w.cast("bigint").alias("_w"), (F.col("size") * max_copies).alias("_cap"))
    out = out.select("*", F.sum("source_size").over(everything).alias("_all"), F.sum("_w").over(everything).alias("_ws"), F.coalesce(F.sum("_cap").over(before), F.lit(0)).alias("_cap_b"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w_b"))
    out = out.withColumn("_full", F.col("_cap") / F.col("_w") < (F.col("_all") - F.col("_cap_b")) / (F.col("_ws") - F.col("_w_b")))
    out = out.select("*", F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0)).alias("_cap_f"), F.coalesce(F.sum(F.when(F.col("_full"), F.col("_w"))).over(everything), F.lit(0)).alias("_w_f"))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise((F.col("_all") - F.col("_cap_f")) / (F.col("_ws") - F.col("_w_f")) * F.col("_w"))
    return out.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, payload: list[str] | None = None) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, copies, taken, and a struct `row` of the payload
    columns if there are any."""
    rows = docs.count()
    subs = max(1, min(-(-rows // BLOCK_ROWS), MAX_SUB_BLOCKS))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), F.md5(name.cast("binary")).alias("_h"), *([F.struct(*payload).alias("row")] if payload else []))
    bits = F.length(F.bin("size"))
    sized = sized.withColumns({"_class": bits * (1 << CLASS_BITS) + F.expr(f"shiftright(size, greatest(0, length(bin(size)) - {CLASS_BITS}))"), "_sub": F.shiftright(md5_fraction(name) * subs, 32)})

    blocks = materialise(sized.groupBy("source", "_class", "_sub").agg(F.count("*").alias("_n"), F.sum("size").alias("size")), "mix-blocks")
    sources = materialise(source_targets(blocks.groupBy("source").agg(F.sum("size").alias("size")), weights, max_copies), "mix-sources")
    ahead = Window.partitionBy("source").orderBy("_class", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("source", "_class", "_sub", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    offsets = join_lookup(offsets, sources, ["source"], sources.count(), F.col("_sub"))

    inside = Window.partitionBy("_src", "_null", "_class", "_sub").orderBy("size", "_h", "doc_id")
    key = {"_src": F.coalesce(F.col("source"), F.lit("")), "_null": F.col("source").isNull()}
    ranked = sized.withColumns(key).withColumn("_rank", F.row_number().over(inside)).drop("source")
    out = ranked.join(offsets.withColumns(key), on=["_src", "_null", "_class", "_sub"], how="inner")

    offset = md5_fraction(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))) / F.lit(float(2**32))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col("_ahead") + F.col("_rank")
    out = out.withColumns({"_rate": rate, "_u": offset})
    copies = (F.floor(upto * F.col("_rate") + F.col("_u")) - F.floor((upto - 1) * F.col("_rate") + F.col("_u"))).cast("bigint")
    out = out.withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if payload else []))


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the documents' own columns, a row for each copy, and the copy's number (0, 1, ...) as `copy`, or where the
    documents have such a column, as `copy_` (and so on)."""
    name = "copy"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    mixed = mix(docs, payload=docs.columns, **how).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias(name)).select("row.*", name)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT greatest(1, least((count(*) + 15999) // 16000, 20000)) AS subs FROM d),
b AS (SELECT d.*, length(bin(size)) * 32 + (size >> greatest(0, length(bin(size)) - 5)) AS class, (CAST(('0x' || substr(h, 1, 8)) AS BIGINT) * subs) // 4294967296 AS sub FROM d, n),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS ws,
    coalesce(sum(cap) OVER o, 0)::BIGINT AS cap_b, coalesce(sum(w) OVER o, 0)::BIGINT AS w_b FROM w
    WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, cap / w < (total - cap_b) / (ws - w_b) AS filled FROM f),
t AS (SELECT source, source_size, CASE WHEN filled THEN CAST(cap AS DOUBLE) ELSE
    (total - coalesce(sum(CASE WHEN filled THEN cap END) OVER (), 0)::BIGINT) / (ws - coalesce(sum(CASE WHEN filled THEN w END) OVER (), 0)::BIGINT) * w END AS target FROM g),
r AS (SELECT b.doc_id, b.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    row_number() OVER (PARTITION BY b.source ORDER BY class, sub, size, h, doc_id) AS k,
    CAST(('0x' || substr(md5('7:' || coalesce('s' || b.source, 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CAST(floor(k * rate + u) AS BIGINT) - CAST(floor((k - 1) * rate + u) AS BIGINT)) * size AS taken FROM r
"""


def op10_mix(spark, sf_dir: str) -> DataFrame:
    """Systematic mix of all documents to the weights 1, 2, 3, ... of their sources."""
    from tidemark.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
