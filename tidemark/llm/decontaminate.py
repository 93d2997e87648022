"""Benchmark decontamination, in DataFrame functions only.

Benchmark items are cut into windows of ten consecutive normalised words (an item of fewer words is one window). The 64-bit
hashes of the distinct windows are a broadcast hash set; the windows of documents are hashed and looked up in it, a hit
counts once the words themselves are equal, and the words under any window that is equal are hit.

Few documents hold a window, so the scan has two steps. Any run of m words of a document holds one of the document's blocks of
b = (m + 1) // 2 words that are cut one after the other from its first word. Every document's blocks are looked up among all runs of b
words of the items; only documents of which a block is found are cut into windows, all of them. Words of blocks are folded more than the
contract says (all letters lowered, one sigma), which can add candidates and lose none; windows are compared under the contract's
lowering of A-Z alone.

Defined results: null and empty texts, and texts without a word, have no words and no hits; an item without words has no
window; the windows of an item without an id hit, and no id is listed for them; windows that several items share count for each; an empty
benchmark hits nothing; repeated rows give a row each; rows with one id but different texts are judged apart. Time and memory follow a
text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, materialise, table

WINDOW = 10
#: A word of a text whose A-Z are lowered, and what stands between words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to this number of distinct windows (about 0.5 KB each) and of blocks' hashes the sets are broadcast; beyond they are joined by shuffle.
BROADCAST_WINDOWS = 200_000
BROADCAST_BLOCKS = 2_000_000
#: Documents up to which the candidates' ids are broadcast, 16 bytes each.
BROADCAST_DOCS = 500_000
_ROW = ["doc_id", "_text"]


def words_of(text: Column) -> Column:
    """The words that are compared."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def folded(text: Column) -> Column:
    """As many words, folded, with a space between two. No other letter's lower case depends on its neighbours but sigma's."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ς"), F.lit("σ")), BETWEEN, " "))


def blocks(text: Column, n: int) -> Column:
    """Hashes of a folded text's blocks of n words, from the first word on (of fewer words at the end)."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?:[^ ]++ ){0,%d}[^ ]++" % (n - 1)), F.lit(0)), lambda x: F.xxhash64(x, F.lit(n)))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(text).alias("w"), F.split(folded(text), " ").alias("f")).filter("size(w) > 0")


def _runs(words: Column, n: Column) -> Column:
    """All runs of n words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n))


def benchmark_windows(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """key (hash of the words), words, length, items (ids as strings)."""
    length = F.least(F.size("w"), F.lit(window))
    cut = _items(benchmark, item_col, text_col).select("item", F.explode(_runs(F.col("w"), length)).alias("words"))
    cut = cut.groupBy("words").agg(F.collect_set("item").alias("items"))
    return cut.select(F.xxhash64("words").alias("key"), "words", F.size("words").alias("length"), "items")


def benchmark_blocks(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """key: hashes of what documents' blocks can be of the items; n, its words."""
    n = F.floor((F.least(F.size("f"), F.lit(window)) + 1) / 2).cast("int")
    cut = _items(benchmark, item_col, text_col).select(n.alias("n"), F.explode(_runs(F.col("f"), n)).alias("words"))
    return cut.select(F.xxhash64(F.array_join("words", " "), "n").alias("key"), "n").distinct()


def _counted(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """doc_id, _text, n_words, _rows (repeated rows), found (whether a block is one of the benchmark's)."""
    keys = materialise(benchmark_blocks(benchmark, window=window), "benchmark-blocks")
    sizes = sorted(r[0] for r in keys.select("n").distinct().collect())
    small = keys.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    keys = keys.select("key", F.lit(True).alias("found"))
    rows = docs.select(*_ROW, folded(F.col("text")).alias("f"))
    count = F.when(F.col("f") == "", F.lit(0)).otherwise(F.octet_length("f") - F.octet_length(F.replace("f", F.lit(" "), F.lit(""))) + 1)
    asked = F.concat(F.array().cast("array<bigint>"), *[blocks(F.col("f"), n) for n in sizes])
    rows = rows.select(*_ROW, count.cast("bigint").alias("n_words"), asked.alias("asked"))
    rows = rows.select(*_ROW, "n_words", F.posexplode_outer("asked").alias("at", "key"))
    hit = rows.join(F.broadcast(keys) if small else keys, on="key", how="left")
    each = hit.groupBy(*_ROW).agg(F.max("n_words").alias("n_words"), F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1)).cast("int").alias("_rows"), F.max("found").alias("found"))
    return materialise(each, "benchmark-counted")


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hits (sorted positions of hit words, from 0), items (sorted ids), a row for each document."""
    return _scan(docs, benchmark, id_col, text_col, window).drop("_text")


def _scan(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_text"), F.col(text_col).alias("text"))
    each = _counted(docs, benchmark, window)
    found = materialise(benchmark_windows(benchmark, window=window), "benchmark-windows")
    lengths = sorted(r[0] for r in found.select("length").distinct().collect())
    small = found.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS

    ids = each.filter("found").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of"))
    ids = F.broadcast(ids) if ids.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS else ids
    rows = docs.join(ids, on=docs["doc_id"].eqNullSafe(ids["_id"]) & (docs["_text"] == ids["_of"]), how="left_semi")
    rows = materialise(rows.select(*_ROW, words_of(F.col("text")).alias("w")), "benchmark-candidates")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.struct(F.xxhash64(F.slice("w", i, n)).alias("key"), (i - 1).alias("at"), F.lit(n).alias("length")))
    none = F.array().cast("array<struct<key:bigint,at:int,length:int>>")
    asked = F.concat(none, *[F.when(F.size("w") >= n, runs(n)).otherwise(none) for n in lengths])
    asked = rows.select(*_ROW, F.explode(asked).alias("a")).select(*_ROW, "a.*").distinct()  # without the words, which would go along with every window
    hit = asked.join(F.broadcast(found) if small else found, on=["key", "length"])
    hit = hit.groupBy(*_ROW).agg(F.collect_list(F.struct("at", "words", "items")).alias("spans"))
    here = F.filter("spans", lambda s: F.slice("w", s["at"] + 1, F.size(s["words"])) == s["words"])
    words = rows.dropDuplicates(_ROW).withColumnsRenamed({"doc_id": "_id", "_text": "_of"})
    hit = hit.join(words, on=hit["doc_id"].eqNullSafe(words["_id"]) & (hit["_text"] == words["_of"])).select(*_ROW, here.alias("spans"))
    positions = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + F.size(s["words"]) - 1)))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["items"]))))
    hit = hit.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of"), positions.alias("hits"), items.alias("items"))
    out = each.join(hit, on=each["doc_id"].eqNullSafe(hit["_id"]) & (each["_text"] == hit["_of"]), how="left")
    out = out.select(*_ROW, "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_row"))
    return out.drop("_row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a window of the benchmark."""
    hit = _scan(docs, benchmark, id_col, text_col, WINDOW).filter("size(hits) > 0").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("_text"))
    rows = rows.join(hit, on=rows["doc_id"].eqNullSafe(hit["_id"]) & (rows["_text"] == hit["_of"]), how="left_anti")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w[k:k + 9] AS words, len(w[k:k + 9]) AS m FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM i),
x AS (SELECT n, doc_id, m, k, w[k:k + m - 1] AS words FROM (SELECT n, doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, m WHERE len(w) >= m)),
h AS (SELECT x.n, x.k, x.m, i.item_id FROM x JOIN i ON x.words = i.words),
p AS (SELECT n, count(DISTINCT pos) AS hit FROM (SELECT n, unnest(range(k, k + m)) AS pos FROM h) GROUP BY n),
t AS (SELECT n, count(DISTINCT item_id) AS items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (n) LEFT JOIN t USING (n)
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find the windows of every benchmark item in every document."""
    out = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
