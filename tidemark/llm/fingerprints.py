"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame functions only.

Sections are what stands between blank lines, paragraphs the lines of a section, and a paragraph's leaves are runs of four
words with the white space around them; together the leaves are the whole text. Leaf = SHA-256 of its text, every node above =
SHA-256 of its level's letter and its children's digests. The root is the fingerprint: equal texts have equal roots, and
texts that differ have different ones. Where roots differ, the leaves (or, from the top, the branches) that are not in the
other tree locate the edit; likeness is the share of leaves that both trees have (twice the common ones over the sum).

The text after a document, in ascending order of ids, is found without sorting the table in one task: ids are cut into
blocks by quantiles and, within one, evenly; every block also gets the first document of the next block, and `lead` runs
inside blocks. The texts are shuffled once.

Defined results: a null text counts as empty; the empty text is one empty leaf; a table of one document follows itself; an
empty table gives no rows; null ids come first; rows with the same id are ordered by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table

LEAF_WORDS = 4
#: A leaf: up to four words, the white space before them, and at a paragraph's end the white space after them.
LEAF = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,%d}(?:[\x20\x09-\x0D]+\z)?|[\x20\x09-\x0D]+\z" % (LEAF_WORDS - 1)
#: Documents of a block that the following document is looked up in; the most blocks (their first rows are broadcast).
BLOCK_ROWS = 64
MAX_BLOCKS = 65_536
QUANTILES = 64


def leaf_tree(text: Column) -> Column:
    """array<section: array<paragraph: array<leaf digest>>>."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))


def root(tree: Column) -> Column:
    paragraph = lambda x: F.sha2(F.concat(F.lit("p"), F.array_join(x, "")), 256)
    section = lambda x: F.sha2(F.concat(F.lit("s"), F.array_join(F.transform(x, paragraph), "")), 256)
    return F.sha2(F.concat(F.lit("d"), F.array_join(F.transform(tree, section), "")), 256)


def leaves_of(tree: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(tree)))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    common = F.size(F.array_intersect(leaves_a, leaves_b))
    total = F.size(leaves_a) + F.size(leaves_b)
    return F.when(root_a == root_b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(2.0 * common / total)


def differing_leaves(tree_a: Column, tree_b: Column) -> Column:
    """Where a's tree differs from b's: array of (section, paragraph) indices whose digests are not in b's tree."""
    known = F.transform(F.flatten(tree_b), lambda p: F.sha2(F.array_join(p, ""), 256))
    at = F.transform(tree_a, lambda s, i: F.transform(s, lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), F.sha2(F.array_join(p, ""), 256).alias("digest"))))
    return F.filter(F.flatten(at), lambda x: ~F.array_contains(known, x["digest"]))


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (the root) and tree (leaf digests by section and paragraph) of each document."""
    tree = docs.select(F.col(id_col).alias("doc_id"), leaf_tree(F.coalesce(F.col(text_col), F.lit(""))).alias("tree"))
    return tree.select("doc_id", root(F.col("tree")).alias("fingerprint"), "tree")


def _block(doc_id: Column, cuts: list[int], per_cut: int) -> Column:
    """The number of doc_id's block, ascending with doc_id: a tree of comparisons over the cuts, then evenly between two."""

    def place(lo: int, hi: int) -> Column:
        if hi - lo > 1:
            mid = (lo + hi) // 2
            return F.when(doc_id < cuts[mid], place(lo, mid)).otherwise(place(mid, hi))
        width = max(1, cuts[hi] - cuts[lo] if hi < len(cuts) else 1)
        inside = F.floor((doc_id.cast("double") - F.lit(float(cuts[lo]))) * (per_cut / width)).cast("bigint")
        return F.lit(lo * per_cut) + F.greatest(F.lit(0), F.least(inside, F.lit(per_cut - 1)))

    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(place(0, len(cuts) - 1)).cast("bigint")


def with_next_text(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text: the text of the document that follows by id; after the last comes the first."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    points = [i / QUANTILES for i in range(QUANTILES + 1)]
    n, cuts = rows.agg(F.count("*"), F.percentile_approx("doc_id", points, 10_000)).first()
    cuts = sorted(set(cuts or [0]))
    cuts = cuts if len(cuts) > 1 else [cuts[0], cuts[0] + 1]
    per_cut = max(1, min(-(-n // BLOCK_ROWS), MAX_BLOCKS) // (len(cuts) - 1))
    rows = rows.withColumn("block", _block(F.col("doc_id"), cuts, per_cut))

    # at most MAX_BLOCKS + 1 rows: each block's first id and which block comes before it
    firsts = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    firsts = materialise(firsts, "fingerprint-blocks")
    order = Window.orderBy("block")
    last = firsts.agg(F.max("block")).first()[0]
    heads = firsts.select(F.coalesce(F.lag("block").over(order), F.lit(last)).cast("bigint").alias("goes_to"), F.col("block").alias("of_block"), "first")
    heads = rows.join(F.broadcast(heads), on=(rows["block"] == heads["of_block"]) & rows["doc_id"].eqNullSafe(heads["first"]), how="inner")
    heads = heads.select("doc_id", "text", F.col("goes_to").alias("block"), F.lit(1).alias("head"))
    both = rows.select("doc_id", "text", "block", F.lit(0).alias("head")).unionByName(heads)
    inside = Window.partitionBy("block").orderBy("head", "doc_id", "text")
    return both.withColumn("next_text", F.lead("text").over(inside)).filter("head = 0").select("doc_id", "text", "next_text")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and its edited text, and compare both and the next document."""
    pairs = with_next_text(table(spark, sf_dir, "documents"))
    n = F.char_length("text").cast("bigint")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next_text", F.lit(1), half))
    out = pairs.select("doc_id", n.alias("n_chars"), "text", "next_text", edited.alias("edited"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[leaf_tree(F.col(c)).alias(f"t_{c}") for c in ("text", "edited", "next_text")])
    names = ("text", "edited", "next_text")
    out = out.select("doc_id", "n_chars", "edited_sha256", *[root(F.col(f"t_{c}")).alias(f"r_{c}") for c in names], *[leaves_of(F.col(f"t_{c}")).alias(f"l_{c}") for c in names])
    like = lambda c: likeness(F.col("r_text"), F.col("l_text"), F.col(f"r_{c}"), F.col(f"l_{c}"))
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("r_text").alias("fingerprint"), F.col("r_edited").alias("edited_fingerprint"), like("edited").alias("near_edited"), like("next_text").alias("near_next"))


_TREE = "list_transform(string_split(TEXT, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '" + LEAF + "'), lambda x: sha256(x))))"
_ROOT = "sha256('d' || array_to_string(list_transform({0}, lambda s: sha256('s' || array_to_string(list_transform(s, lambda p: sha256('p' || array_to_string(p, ''))), ''))), ''))"
_LIKE = "CASE WHEN r_t = r_{0} THEN 1.0::DOUBLE WHEN len(l_t) + len(l_{0}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(l_t, l_{0})) / (len(l_t) + len(l_{0})) END"
SQL = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id NULLS FIRST, t), first_value(t) OVER (ORDER BY doc_id NULLS FIRST, t)) AS x FROM a),
c AS (SELECT *, length(t)::BIGINT AS n_chars, substr(t, 1, length(t) - length(t) // 2) || substr(x, 1, length(t) // 2) AS e FROM b),
d AS (SELECT doc_id, n_chars, sha256(e) AS edited_sha256, {", ".join(_TREE.replace("TEXT", c) + f" AS t_{c}" for c in "tex")} FROM c),
r AS (SELECT doc_id, n_chars, edited_sha256, {", ".join(f"{_ROOT.format(f't_{c}')} AS r_{c}, list_distinct(flatten(flatten(t_{c}))) AS l_{c}" for c in "tex")} FROM d)
SELECT doc_id, n_chars, edited_sha256, r_t AS fingerprint, r_e AS edited_fingerprint, {_LIKE.format("e")} AS near_edited, {_LIKE.format("x")} AS near_next FROM r
"""
