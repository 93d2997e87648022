"""The queries of the store's operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.functions import hashing, text
from tidemark.operators import integrity, runs, scan, sketch, stateful
from tidemark.sources import sketches, tables, wal
from tidemark.sources.log import from_events, latest, live, remove_keys, reserved
from tidemark.sources.runstore import RunStore

KEYS = ["u000003", "u000007", "u000042", "u000111", "u999998", "u999999"]
ABSENT = ["u999997", "u999998", "x", "u"]
START, STOP, PREFIX = "u000010", "u000060", "u0000"
TOKENS, WINDOW = 3, 86_400
#: A fixed width for the hash family's own query; filters are sized by their elements.
HASH_M = sketch.bloom_size(1_500, DEFAULT.bloom_fpr)[0]
CMS_M, CMS_K = sketch.cms_size(0.1, 0.01)
HEAVY_M, HEAVY_K = sketch.cms_size(0.01, 0.01)
HLL_P = 8
RADIUS = 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(rows: DataFrame, first: int = 0) -> DataFrame:
    """Rows of a page with their place, so that their order is part of the result."""
    return rows.withColumn("place", (F.row_number().over(Window.orderBy("key")) - 1 + first).cast("bigint"))


def _flushed(s, d):
    return runs.flush(from_events(s, d))


def _leveled(s, d):
    return runs.with_level(_flushed(s, d))


def _versions(rows: DataFrame, *first: str) -> DataFrame:
    return rows.select(*first, "key", "value", F.col("tombstone").cast("int").alias("tombstone"), "ts", "seq")


def kv_reserved_filter(s, d):
    own = s.createDataFrame([("hll_x",), ("bf_y",), ("cms_z",), ("sh_w",), ("tb_user0",), ("",), ("table",)], "key string")
    return live(from_events(s, d)).select("key").unionByName(own).filter(~reserved(F.col("key")))


def memtable_overlay(s, d):
    log = from_events(s, d)
    return runs.overlay(runs.flush(log), runs.memtable(log)).select("key", "value", "ts", "seq")


def kv_multi_get(s, d):
    asked = _table(s, d, "customer").select(F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return scan.multi_get(from_events(s, d), asked)


def _names(s, d):
    return _table(s, d, "customer").select("c_name")


def _probes(s, d):
    """Names beyond the customers': none of them was added."""
    return _table(s, d, "customer").select(F.format_string("Customer#%09d", F.col("c_custkey") + 5_000_000).alias("name"))


def _bloom(s, d):
    """Width, hashes and the positions of a filter of the customers' names, sized by their number."""
    m, k = sketches.sized(_names(s, d), F.col("c_name"), DEFAULT.bloom_fpr)
    return m, k, sketch.bloom(_names(s, d), F.col("c_name"), m, k)


def bf_find(s, d):
    m, k, bits = _bloom(s, d)
    both = _names(s, d).select(F.col("c_name").alias("name")).unionByName(_probes(s, d))
    return sketch.bloom_find(bits, both, "name", m, k)


def bf_false_positives(s, d):
    m, k, bits = _bloom(s, d)
    return sketch.bloom_find(bits, _probes(s, d), "name", m, k).filter("found").select("name")


def cms_count(s, d):
    users = _table(s, d, "events").select(F.col("user_id").cast("string").alias("user"))
    return sketch.cms_count(sketch.cms(users, F.col("user"), CMS_M, CMS_K), users, "user", CMS_M, CMS_K)


def cms_heavy_hitters(s, d):
    parts = _table(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("part"))
    true = parts.groupBy("part").agg(F.count("*").alias("n"))
    estimates = sketch.cms_count(sketch.cms(parts, F.col("part"), HEAVY_M, HEAVY_K), parts, "part", HEAVY_M, HEAVY_K)
    total = parts.agg(F.count("*").alias("total"))
    heavy = estimates.crossJoin(F.broadcast(total)).filter(F.col("estimate") * 200 >= F.col("total")).select("part", "estimate")
    return heavy.join(true, on="part")


def approx_distinct_native(s, d):
    return _table(s, d, "customer").agg(F.approx_count_distinct("c_name").alias("approx"), F.hll_sketch_estimate(F.hll_sketch_agg("c_name")).alias("sketch"))


def simhash_compare(s, d):
    """Every benchmark item against the document whose id is the same."""
    docs = _table(s, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("other"))
    return text.compare(_table(s, d, "benchmark").join(docs, on="item_id"), "item_id", "text", "other", 64)


def simhash_near_dups(s, d):
    prints = text.fingerprints(_table(s, d, "documents"), "doc_id", "text", 64)
    return prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


def simhash_radius(s, d):
    return text.near(tables.written(text.fingerprints(_table(s, d, "documents"), "doc_id", "text", 64), "prints"), "doc_id", 64, RADIUS)


def _requests(s, d):
    return from_events(s, d).select("key", "ts", "seq")


def _parts(rows: DataFrame, by: str) -> list[DataFrame]:
    """A table in two batches."""
    return [rows.filter(F.pmod(F.col(by), F.lit(2)) == x) for x in (0, 1)]


def sketch_hll(s, d):
    """A stored HyperLogLog for each market segment, added to in two batches and compacted between."""
    at, customers = tables.new_folder(s, "sketches"), _table(s, d, "customer")
    segments = [r[0] for r in customers.select("c_mktsegment").distinct().collect()]
    sketches.create(s, at, "hll", [*segments, "empty"], *sketches.hll_parameters(HLL_P))
    for part in _parts(customers, "c_custkey"):
        sketches.add(s, at, "hll", part, F.col("c_mktsegment"), F.col("c_name"))
        sketches.compact(s, at)
    return sketches.estimate(s, at)


def sketch_cms(s, d):
    at, items = tables.new_folder(s, "sketches"), _table(s, d, "lineitem")
    sketches.create(s, at, "cms", ["parts"], *sketches.cms_parameters(0.01, 0.01))
    for part in _parts(items, "l_orderkey"):
        sketches.add(s, at, "cms", part, F.lit("parts"), F.col("l_partkey"))
    return sketches.count(s, at, items, F.lit("parts"), F.col("l_partkey"))


def sketch_bf(s, d):
    at, names = tables.new_folder(s, "sketches"), _table(s, d, "customer")
    sketches.create(s, at, "bf", ["names"], *sketches.sized(names, F.col("c_name"), DEFAULT.bloom_fpr))
    for part in _parts(names, "c_custkey"):
        sketches.add(s, at, "bf", part, F.lit("names"), F.col("c_name"))
    return sketches.find(s, at, names.select(F.col("c_name").alias("name")).unionByName(_probes(s, d)), F.lit("names"), F.col("name"))


def sketch_simhash(s, d):
    at = tables.new_folder(s, "sketches")
    sketches.create(s, at, "sh", ["wide"], *sketches.simhash_parameters(32))
    docs = _table(s, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("other"))
    return sketches.compare(s, at, "wide", _table(s, d, "benchmark").join(docs, on="item_id"), "item_id", "text", "other")


def _store(s, d) -> RunStore:
    """The log's runs with their levels, written as a store."""
    store = RunStore(s, tables.new_folder(s, "store"))
    store.add(_leveled(s, d))
    return store


def compact_leveled_ln(s, d):
    """Levels 1 and 2, each moved down, from a store that has all runs: written once, their ranges in the manifest."""
    store = _store(s, d)
    manifest, rows = store.manifest(), store.rows()
    return runs.leveled_down(rows, 1, manifest=manifest).unionByName(runs.leveled_down(rows, 2, manifest=manifest))


def store_manifest(s, d):
    return _store(s, d).manifest()


def store_compacted(s, d):
    """What a store holds after its levels were compacted, as reads see it, and in how many runs of which levels."""
    store = _store(s, d)
    store.compact("size-tiered")
    return _versions(store.rows(), "level", "run")


def store_leveled(s, d):
    store = _store(s, d)
    store.compact_leveled(0)
    return store.rows().groupBy("level", "run").agg(F.count("*").alias("n"), F.min("key").alias("start"), F.max("key").alias("stop"))


def store_reads(s, d):
    """A point read, a range and a prefix of a store, which read only the runs that may have them."""
    store = _store(s, d)
    found = [("get", store.get(KEYS)), ("range", store.range_scan(START, STOP)), ("prefix", store.prefix_scan(PREFIX))]
    out = [rows.select(F.lit(name).alias("read"), "key", "value") for name, rows in found]
    return out[0].unionByName(out[1]).unionByName(out[2])


def merkle_runs(s, d):
    record = integrity.encode(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts"))
    return integrity.merkle_roots(_flushed(s, d), ["run"], "key", record)


def bad_records(s, d):
    """Every hundredth record's checksum is stored wrong."""
    log = from_events(s, d)
    stored = integrity.record_crc(log).select("seq", F.when(F.pmod("seq", F.lit(100)) == 7, F.col("record_crc") + 1).otherwise(F.col("record_crc")).alias("record_crc"))
    return integrity.bad_records(log, stored)


def admission(s, d):
    """Writes of each user, of which some go to reserved keys, through the users' buckets: a first half, and the rest with the state it left."""
    log = from_events(s, d)
    name = F.when(F.pmod("seq", F.lit(10)) == 3, F.concat(F.lit("hll_"), "key")).otherwise(F.col("key"))
    asked = log.select(F.col("key").alias("user"), name.alias("key"), "ts", "seq")
    split = asked.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    one, two = asked.filter(F.col("ts") <= F.lit(split)), asked.filter(F.col("ts") > F.lit(split))
    state = tables.written(stateful.token_bucket_state(one.select(F.col("user").alias("key"), "ts", "seq"), TOKENS, WINDOW), "buckets")
    first = stateful.admit(one, reserved(F.col("key")), TOKENS, WINDOW)
    return first.unionByName(stateful.admit(two, reserved(F.col("key")), TOKENS, WINDOW, state))


def kv_remove(s, d):
    """The log without all versions of the keys that are deleted now."""
    log = from_events(s, d)
    return _versions(remove_keys(log, latest(log).filter("tombstone = 1")))


def lru_deletes(s, d):
    log = from_events(s, d)
    return stateful.lru(log.select("key", "seq", (F.col("tombstone") == 1).alias("deleted")), DEFAULT.cache_size)


def queries() -> dict:
    return {
        "kv_snapshot": lambda s, d: live(from_events(s, d)).select("key", "value", "ts"),
        "kv_deleted_keys": lambda s, d: latest(from_events(s, d)).filter("tombstone = 1").select("key", "ts"),
        "kv_get": lambda s, d: scan.get(from_events(s, d), KEYS),
        "kv_multi_get": kv_multi_get,
        "kv_get_missing": lambda s, d: scan.get(from_events(s, d), ABSENT),
        "kv_reserved_filter": kv_reserved_filter,
        "kv_range_scan": lambda s, d: scan.range_scan(from_events(s, d), START, STOP),
        "kv_range_page": lambda s, d: _placed(scan.page(scan.range_scan(from_events(s, d), START, STOP), 10, 2), 20),
        "kv_prefix_scan": lambda s, d: scan.prefix_scan(from_events(s, d), PREFIX),
        "kv_prefix_page": lambda s, d: _placed(scan.page(scan.prefix_scan(from_events(s, d), PREFIX), 5, 1), 5),
        "memtable_state": lambda s, d: _versions(runs.memtable(from_events(s, d))),
        "memtable_overlay": memtable_overlay,
        "sst_flush": lambda s, d: _versions(_flushed(s, d), "run"),
        "sst_index": lambda s, d: runs.index(_flushed(s, d)),
        "sst_summary": lambda s, d: runs.summary(_flushed(s, d)),
        "sst_prune_point": lambda s, d: runs.prune(_flushed(s, d), "u000001", "u000001"),
        "sst_prune_range": lambda s, d: runs.prune(_flushed(s, d), "u", "u000001"),
        "sst_prune_prefix": lambda s, d: runs.prune_prefix(_flushed(s, d), "u00000"),
        "read_order": lambda s, d: runs.read_order(_leveled(s, d)),
        "merge_two_runs": lambda s, d: _versions(runs.merge_neighbours(_flushed(s, d)), "pair"),
        "compact_size_tiered": lambda s, d: _versions(runs.size_tiered(_leveled(s, d)), "level"),
        "compact_leveled_l0": lambda s, d: _versions(runs.leveled_zero(_leveled(s, d)), "level", "chunk"),
        "compact_leveled_ln": lambda s, d: _versions(compact_leveled_ln(s, d), "level", "chunk"),
        "store_manifest": store_manifest,
        "store_compacted": store_compacted,
        "store_leveled": store_leveled,
        "store_reads": store_reads,
        "compact_chunks": lambda s, d: runs.chunks(latest(from_events(s, d))).groupBy("chunk").agg(F.count("*").alias("n"), F.min("key").alias("start"), F.max("key").alias("stop")),
        "compaction_trigger": lambda s, d: runs.triggers(_leveled(s, d)),
        "run_overlap": lambda s, d: runs.overlap(_leveled(s, d)),
        "wal_segments": lambda s, d: wal.segments(from_events(s, d)),
        "wal_replay": lambda s, d: _versions(wal.replay(from_events(s, d))),
        "wal_after_truncate": lambda s, d: _versions(wal.after_truncate(from_events(s, d)), "segment"),
        "wal_trim": lambda s, d: wal.trim(from_events(s, d), 10).groupBy("segment").agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq")),
        "record_crc": lambda s, d: integrity.record_crc(from_events(s, d)),
        "bad_records": bad_records,
        "kv_remove": kv_remove,
        "seeded_hash": lambda s, d: _names(s, d).select("c_name", *[hashing.unsigned_mod(hashing.seeded_md5(F.col("c_name"), F.lit(hashing.seed_hex(i))), HASH_M).alias(f"h{i}") for i in range(3)]),
        "md5_hex": lambda s, d: _names(s, d).select("c_name", F.md5(F.col("c_name").cast("binary")).alias("md5")),
        "simhash_bits": lambda s, d: _names(s, d).select("c_name", hashing.bit_text(F.md5(F.col("c_name").cast("binary"))).alias("bits")),
        "bf_bits": lambda s, d: _bloom(s, d)[2],
        "bf_find": bf_find,
        "bf_false_positives": bf_false_positives,
        "cms_matrix": lambda s, d: sketch.cms(_table(s, d, "events"), F.col("user_id"), CMS_M, CMS_K),
        "cms_count": cms_count,
        "cms_heavy_hitters": cms_heavy_hitters,
        "hll_registers": lambda s, d: sketch.hll(_names(s, d), F.col("c_name"), HLL_P),
        "hll_estimate": lambda s, d: sketch.hll_estimate(sketch.hll(_names(s, d), F.col("c_name"), HLL_P), HLL_P),
        "hll_by_group": lambda s, d: sketch.hll_estimate(sketch.hll(_table(s, d, "customer"), F.col("c_name"), 10, "c_mktsegment"), 10, "c_mktsegment"),
        "approx_distinct_native": approx_distinct_native,
        "simhash_tokens": lambda s, d: text.token_counts(_table(s, d, "documents"), "doc_id", "text"),
        "simhash_fingerprint": lambda s, d: text.fingerprints(_table(s, d, "documents"), "doc_id", "text", 64),
        "simhash_compare": simhash_compare,
        "simhash_near_dups": simhash_near_dups,
        "simhash_radius": simhash_radius,
        "sketch_hll": sketch_hll,
        "sketch_cms": sketch_cms,
        "sketch_bf": sketch_bf,
        "sketch_simhash": sketch_simhash,
        "merkle_runs": merkle_runs,
        "merkle_root": lambda s, d: integrity.merkle_root(_table(s, d, "nation"), "n_nationkey", F.col("n_name")),
        "token_bucket": lambda s, d: stateful.token_bucket(_requests(s, d), TOKENS, WINDOW),
        "token_bucket_summary": lambda s, d: stateful.token_bucket_summary(_requests(s, d), TOKENS, WINDOW),
        "token_bucket_state": lambda s, d: stateful.token_bucket_state(_requests(s, d), TOKENS, WINDOW),
        "admission": admission,
        "lru_deletes": lru_deletes,
        "lru_hits": lambda s, d: stateful.lru(_requests(s, d), DEFAULT.cache_size),
    }
