"""URL filters: host-suffix and path-prefix rules.

Each URL is expanded into expressions: a suffix of its host's labels and a prefix of its path, with a `?` between, which neither
can hold. Only the shapes (labels of the host, characters of the path) that occur among the rules are expanded, so a URL makes as
many expressions as there are shapes that it is long enough for. Expressions are joined to the rules on the first 32 bits of their
SHA-256; a hit counts once the whole digest is equal; of the rules that fit, the longest wins.

Defined results: a null URL, or one without `://`, has an empty host and path and fits no rule; a URL that no rule fits
gets `default`; an empty table gives no rows; repeated rows give a row each; of two rules with the same host and path, block
wins; of two of the same length, the one with the longer host; URLs of any length are read as a whole. Columns of pages other than id and URL
are left out, so none can clash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, table

#: The rules of the query (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"
#: Rules up to this number are broadcast (about 200 bytes each); more are joined by shuffle.
BROADCAST_RULES = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages. rules: verdict (allow or block), host, path."""
    keyed = rules.select("verdict", ascii_lower(F.col("host")).alias("host"), F.col("path")).filter("host IS NOT NULL AND path IS NOT NULL")
    keyed = keyed.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    both = lambda host, path: F.concat(host, F.lit("?"), path)
    short = keyed.select(F.concat("host", "path").alias("rule"), "verdict", (F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"), F.sha2(both(F.col("host"), F.col("path")), 256).alias("digest"))
    short = short.withColumn("short", F.substring("digest", 1, 8))
    small = keyed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    shapes = keyed.select(F.size(F.split("host", r"\.")).alias("k"), F.length("path").alias("n")).distinct().collect()
    shapes = F.from_json(F.lit(json.dumps(sorted([r["k"], r["n"]] for r in shapes))), "array<array<int>>")

    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    fits = F.filter(shapes, lambda s: (F.size(F.split("host", r"\.")) >= s[0]) & (F.length("path") >= s[1]))
    digests = F.transform(fits, lambda s: F.sha2(both(F.call_function("substring_index", F.col("host"), F.lit("."), -s[0]), F.substring(F.col("path"), F.lit(1), s[1])), 256))
    asked = urls.select("*", F.posexplode_outer(digests).alias("at", "asked"))
    hit = (F.substring(asked["asked"], 1, 8) == short["short"]) & (asked["asked"] == short["digest"])
    hits = asked.join(F.broadcast(short) if small else short, on=hit, how="left")
    best = hits.groupBy("page_id", "_url", "host", "path").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct("length", "host_length", "rule", "verdict"))).alias("best"),
        F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1)).alias("_rows"),
    )
    best = best.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
WITH r(rule, verdict, host_rule, path_rule) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
    ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.*, rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC) AS k FROM p
    LEFT JOIN r ON (host = host_rule OR ends_with(host, '.' || host_rule)) AND starts_with(path, path_rule))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the URL of every page by the fixed rules."""
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))
