"""Properties of the store's operators, and hand vectors."""

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import hashing, text
from tidemark.operators import integrity, runs, scan, sketch, stateful
from tidemark.sources import log as logs
from tidemark.sources import sketches, tables, wal
from tidemark.sources.runstore import RunStore
from tidemark.streaming import ingest

SCHEMA = "key string, value string, tombstone tinyint, ts bigint, seq bigint"


def random_log(n=600, keys=40, seed=42):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys):03d}", f"v{i}", int(rng.random() < 0.25), i // 3, i) for i in range(n)]


def replay(rows):
    state = {}
    for key, value, tombstone, _, _ in rows:
        state[key] = None if tombstone else value
    return state


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(random_log(), SCHEMA).cache()


def pairs(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_live_view_is_a_replay(log):
    assert pairs(logs.live(log)) == {k: v for k, v in replay(random_log()).items() if v is not None}


def test_gets(log):
    want = replay(random_log())
    asked = ["k000", "k001", "nope", ""]
    assert pairs(scan.get(log, asked)) == {k: want.get(k) for k in asked}
    table = log.sparkSession.createDataFrame([(k,) for k in asked], "key string")
    assert pairs(scan.multi_get(log, table)) == {k: want.get(k) for k in asked}


def test_pages_make_up_the_scan(log):
    want = sorted(k for k, v in replay(random_log()).items() if v is not None and "k005" <= k <= "k030")
    rows = scan.range_scan(log, "k005", "k030")
    got = []
    for number in range(20):
        part = [r["key"] for r in scan.page(rows, 4, number).collect()]
        got += part
        if len(part) < 4:
            break
    assert got == want
    assert scan.page(rows, 0, 0).count() == 0
    assert scan.range_scan(log, "k030", "k005").count() == 0
    with pytest.raises(ValueError):
        scan.page(rows, -1, 0)


def test_empty_log(spark, tmp_path):
    empty = logs.read(spark, str(tmp_path / "none"))
    assert scan.prefix_scan(empty, "a").count() == 0
    assert runs.summary(runs.flush(empty)).count() == 0
    assert integrity.merkle_root(empty, "seq", F.col("key")).first()["root"] is None
    assert stateful.lru(empty, 3).count() == 0
    assert stateful.token_bucket(empty, 3, 10).count() == 0


def test_compaction_keeps_the_newest_version(log):
    config = Config(run_size=50, sstable_size=7)
    flushed = runs.with_level(runs.flush(log, config), config)
    want = {r["key"]: (r["ts"], r["seq"]) for r in logs.latest(log).collect()}
    merged = runs.merge(*[flushed.filter(F.col("run") == r).drop("level", "run") for r in range(12)])
    assert {r["key"]: (r["ts"], r["seq"]) for r in merged.collect()} == want
    cut = runs.chunks(merged, config).collect()
    order = sorted(r["key"] for r in cut)
    assert {r["key"]: r["chunk"] for r in cut} == {k: i // 7 for i, k in enumerate(order)}
    ends = {r["run"]: (r["start"], r["stop"]) for r in runs.ranges(flushed).collect()}
    assert {r["run"] for r in runs.prune(flushed, "k010", "k012").collect()} == {r for r, (a, b) in ends.items() if a <= "k012" and b >= "k010"}


def test_store_of_runs(spark, tmp_path):
    """Flushes, compactions by both strategies and reads, against a replay; runs are numbered, retired, and their roots hold."""
    config = Config(sstable_size=7, lsm_max_per_level=3, leveled_max_runs=(2, 3, 5, 100))
    rows, want = random_log(400, 30), {}
    for strategy in ("size-tiered", "leveled"):
        store = RunStore(spark, str(tmp_path / strategy), config)
        assert store.get(["k000"]).first()["value"] is None and store.range_scan("", "z").count() == 0
        for at in range(0, 400, 100):
            store.flush(spark.createDataFrame(rows[at : at + 100], SCHEMA))
            store.compact(strategy)
            want = {k: v for k, v in replay(rows[: at + 100]).items() if v is not None}
            assert pairs(store.range_scan("", "z")) == want
        known = {(r["level"], r["run"]): r for r in store.manifest().collect()}
        folders = {(int(x[6:]), int(y[4:])) for x in tables.children(spark, store.path) if x.startswith("level=") for y in tables.children(spark, f"{store.path}/{x}")}
        assert set(known) == folders and {x for x, _ in known} != {0}
        assert pairs(store.get(["k001", "k002", "nope"])) == {k: want.get(k) for k in ("k001", "k002", "nope")}
        assert pairs(store.prefix_scan("k01")) == {k: v for k, v in want.items() if k.startswith("k01")}
        assert store.bad_runs().count() == 0
        first = store.manifest().limit(1)
        assert store.rows(first).select("level", "run").distinct().count() == 1
    assert all(r["n"] <= 7 for (level, _), r in known.items() if level)
    with pytest.raises(ValueError):
        store.compact("none")


def test_merkle_roots_of_groups(spark):
    """Groups of every size up to nine leaves, against hashlib."""
    rows = [(n, i, f"{n}-{i}") for n in range(1, 10) for i in range(n)]
    want = {}
    for n in range(1, 10):
        level = [hashlib.sha1(f"{n}-{i}".encode()).digest() for i in range(n)]
        level += [hashlib.sha1(b"").digest()] * ((1 << (n - 1).bit_length()) - n)
        while len(level) > 1:
            level = [hashlib.sha1(a + b).digest() for a, b in zip(level[::2], level[1::2])]
        want[n] = level[0].hex()
    df = spark.createDataFrame(rows, "g int, i int, s string")
    assert {r["g"]: r["root"] for r in integrity.merkle_roots(df, ["g"], "i", F.col("s")).collect()} == want


def test_stored_sketches(spark, tmp_path):
    at = str(tmp_path / "sketches")
    words = spark.createDataFrame([("a" if i % 3 else "b", f"w{i % 50}") for i in range(300)] + [("nobody", "w"), (None, "w"), ("a", None)], "name string, w string")
    assert sketches.estimate(spark, at).count() == 0
    sketches.compact(spark, at)
    sketches.create(spark, at, "cms", ["a", "b"], *sketches.cms_parameters(0.1, 0.01))
    sketches.create(spark, at, "hll", ["a"], *sketches.hll_parameters(6))
    sketches.create(spark, at, "hll", ["b"], *sketches.hll_parameters(4))
    sketches.create(spark, at, "bf", ["a"], *sketches.sized(words, F.col("w"), 0.01))
    for kind in ("cms", "hll", "bf"):
        for part in (words.filter("w < 'w3'"), words.filter("w >= 'w3' OR w IS NULL")):
            sketches.add(spark, at, kind, part, F.col("name"), F.col("w"))

    def answers():
        counts = {(r["name"], r["element"]): r["estimate"] for r in sketches.count(spark, at, words, F.col("name"), F.col("w")).collect() if r["element"]}
        return counts, {r["name"]: r["estimate"] for r in sketches.estimate(spark, at).collect()}, [r["found"] for r in sketches.find(spark, at, words.filter("name = 'a' AND w IS NOT NULL"), F.col("name"), F.col("w")).collect()]

    counts, estimates, found = answers()
    for name in "ab":
        one = words.filter(f"name = '{name}' AND w IS NOT NULL")
        m, k = sketches.cms_parameters(0.1, 0.01)
        assert {e: n for (x, e), n in counts.items() if x == name} == {r["w"]: r["estimate"] for r in sketch.cms_count(sketch.cms(one, F.col("w"), m, k), one, "w", m, k).collect()}
        p = {"a": 6, "b": 4}[name]
        assert estimates[name] == pytest.approx(sketch.hll_estimate(sketch.hll(one, F.col("w"), p), p).first()["estimate"])
    assert all(found) and "nobody" not in estimates
    sketches.compact(spark, at)
    assert answers() == (counts, estimates, found)
    sketches.create(spark, at, "hll", ["a"], *sketches.hll_parameters(6))  # anew, and empty
    assert {r["name"]: r["estimate"] for r in sketches.estimate(spark, at).collect()} == {"a": 0.0, "b": estimates["b"]}
    sketches.create(spark, at, "sh", ["narrow"], *sketches.simhash_parameters(16))
    df = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs.")], "id int, a string, b string")
    assert sketches.compare(spark, at, "narrow", df, "id", "a", "b").first()["distance"] == 6
    assert sketches.compare(spark, at, "missing", df, "id", "a", "b").first()["distance"] is None
    for bad in (lambda: sketches.create(spark, at, "x", ["a"], 1, 1), lambda: sketches.add(spark, at, "sh", words, F.col("name"), F.col("w")), lambda: sketches.hll_parameters(3)):
        with pytest.raises(ValueError):
            bad()


def test_filters_have_their_rate(spark):
    """A filter that is sized by its elements lets about one in a hundred others through."""
    rows = spark.range(3000).select(F.concat(F.lit("n"), F.col("id")).alias("w"))
    m, k = sketches.sized(rows, F.col("w"), 0.01)
    others = spark.range(3000).select(F.concat(F.lit("x"), F.col("id")).alias("w"))
    assert sketch.bloom_find(sketch.bloom(rows, F.col("w"), m, k), others, "w", m, k).filter("found").count() < 75


def test_prefix_pruning_loses_no_run(log):
    flushed = runs.flush(log, Config(run_size=5))
    holds = {r["run"] for r in flushed.filter(F.col("key").startswith("k01")).select("run").distinct().collect()}
    assert holds <= {r["run"] for r in runs.prune_prefix(flushed, "k01").collect()}


def test_wal_views(log):
    segments = {r["segment"]: r["entries"] for r in wal.segments(log).collect()}
    assert segments == {i: 20 for i in range(1, 31)}
    assert wal.after_truncate(log).count() == 20
    trimmed = wal.trim(log, 28)
    assert sorted({r["segment"] for r in trimmed.collect()}) == [1, 2]


def test_reserved_keys(spark):
    rows = spark.createDataFrame([("hll_a",), ("tb_user0",), ("a_hll_",), ("",), ("tb",)], "key string")
    assert sorted(r["key"] for r in rows.filter(~logs.reserved(F.col("key"))).collect()) == ["a_hll_", "tb"]


def test_sizes():
    assert sketch.bloom_size(100, 0.01) == (959, 7)
    assert sketch.bloom_size(20, 0.01) == (192, 7)
    assert sketch.cms_size(0.1, 0.01) == (28, 6)
    assert sketch.cms_size(0.01, 0.01) == (272, 6)
    for bad in (lambda: sketch.bloom_size(0, 0.01), lambda: sketch.cms_size(0, 0.1), lambda: sketch.hll_cell(F.lit("a"), 3)):
        with pytest.raises(ValueError):
            bad()


def test_seeded_hash(spark):
    row = spark.range(1).select(F.substring(hashing.seeded_md5(F.lit("a"), F.lit(hashing.seed_hex(0))), 1, 16).alias("h")).first()
    assert int(row["h"], 16) == 2081424493750651138


def test_bloom_and_cms(spark):
    words = [(f"w{i % 70}",) for i in range(300)]
    df = spark.createDataFrame(words, "w string")
    m, k = sketch.bloom_size(70, 0.01)
    assert all(r["found"] for r in sketch.bloom_find(sketch.bloom(df, F.col("w"), m, k), df, "w", m, k).collect())
    m, k = sketch.cms_size(0.1, 0.01)
    truth = {r["w"]: r["count"] for r in df.groupBy("w").count().collect()}
    table = sketch.cms(df, F.col("w"), m, k)
    assert all(r["estimate"] >= truth[r["w"]] for r in sketch.cms_count(table, df, "w", m, k).collect())


def test_hll_vector(spark):
    df = spark.createDataFrame([("vlada",), ("balsa",), ("teodor",)], "w string")
    assert {r["bucket"]: r["value"] for r in sketch.hll(df, F.col("w"), 4).collect()} == {6: 2, 3: 2}
    assert sketch.hll_estimate(sketch.hll(df, F.col("w"), 4), 4).first()["estimate"] == pytest.approx(2.1365, abs=1e-4)


def test_simhash_vector(spark):
    df = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs.")], "id int, a string, b string")
    assert text.fingerprints(df, "id", "a", 16).first()["fingerprint"] == "0011000001100110"
    assert text.fingerprints(df, "id", "b", 16).first()["fingerprint"] == "0011001100110000"
    assert text.compare(df, "id", "a", "b", 16).first()["distance"] == 6
    with pytest.raises(ValueError):
        text.fingerprints(df, "id", "a", 257)


@pytest.mark.parametrize("n, root", [(8, "17ecba5e4f10615ac231c8e7c9a71b57b85cca0c"), (6, "92db34e7ffa92ac66be802c871850533f46e7f1e")])
def test_merkle_vectors(spark, n, root):
    df = spark.createDataFrame([(i, f"string{i}") for i in range(n)], "i int, s string")
    assert integrity.merkle_root(df, "i", F.col("s")).first()["root"] == root


def test_record_crc(spark):
    df = spark.createDataFrame([("k", "v", 1, 258, 0), ("k", None, 0, 1, 1)], SCHEMA)
    got = {r["seq"]: (r["record_crc"], r["value_crc"]) for r in integrity.record_crc(df).collect()}
    encode = lambda key, value, tomb, ts: ts.to_bytes(8, "little") + bytes([tomb]) + len(key).to_bytes(8, "little") + key + len(value).to_bytes(8, "little") + value
    assert got == {0: (zlib.crc32(encode(b"k", b"v", 1, 258)), zlib.crc32(b"v")), 1: (zlib.crc32(encode(b"k", b"", 0, 1)), 0)}
    stored = integrity.record_crc(df).select("seq", F.when(F.col("seq") == 1, 7).otherwise(F.col("record_crc")).alias("record_crc"))
    assert [r["seq"] for r in integrity.bad_records(df, stored).collect()] == [1]


def test_token_bucket(spark):
    rows = [("a", t, i) for i, t in enumerate([0, 1, 2, 3, 9, 10, 10, 10, 11, 25])] + [("b", 5, 100)]
    df = spark.createDataFrame(rows, "key string, ts long, seq long")
    got = [r["allowed"] for r in stateful.token_bucket(df, 3, 10).filter("key = 'a'").orderBy("seq").collect()]
    assert got == [True, True, True, False, False, True, True, True, False, True]
    assert {r["key"]: r["allowed"] for r in stateful.token_bucket_summary(df, 3, 10).collect()} == {"a": 7, "b": 1}


def test_token_bucket_goes_on(spark):
    """Requests in two parts, the second from the state that the first left, are decided as in one."""
    rng = random.Random(2)
    rows = sorted((rng.choice("abc"), rng.randrange(200), i) for i in range(150))
    df = spark.createDataFrame(rows, "key string, ts long, seq long")
    whole = sorted(map(tuple, stateful.token_bucket(df, 3, 10).collect()))
    one, two = df.filter("ts < 90"), df.filter("ts >= 90")
    state = stateful.token_bucket_state(one, 3, 10)
    parts = stateful.token_bucket(one, 3, 10).collect() + stateful.token_bucket(two, 3, 10, state).collect()
    assert sorted(map(tuple, parts)) == whole
    assert sorted(map(tuple, stateful.token_bucket_state(two, 3, 10, state).collect())) == sorted(map(tuple, stateful.token_bucket_state(df, 3, 10).collect()))
    asked = df.select(F.col("key").alias("user"), F.when(F.col("seq") % 4 == 0, "bf_x").otherwise("mine").alias("key"), "ts", "seq")
    got = {r["seq"]: (r["allowed"], r["admitted"]) for r in stateful.admit(asked, logs.reserved(F.col("key")), 3, 10).collect()}
    assert got == {seq: (ok, ok and seq % 4 != 0) for _, _, seq, ok in whole}


def test_lru_deletes_and_lost_places(spark, monkeypatch):
    monkeypatch.setattr(stateful, "CHUNK_ROWS", 5)
    rows = [("a", 0, False), ("b", 1, False), ("a", 2, True), ("a", 3, False), ("c", 30, True), ("c", 31, False), ("d", 32, False), ("a", 33, True), ("b", 34, True), ("d", 35, None), ("x", None, False)]
    got = stateful.lru(spark.createDataFrame(rows, "key string, seq long, deleted boolean"), 2).collect()
    want = [None, False, False, True, True, False, False, False, False, False, True]
    assert [r["hit"] for r in sorted(got, key=lambda r: -1 if r["seq"] is None else r["seq"])] == want


def test_simhash_radius(spark):
    rng = random.Random(1)
    prints = ["".join(rng.choice("01") for _ in range(64)) for _ in range(40)]
    for base in prints[:20]:
        flip = list(base)
        for at in rng.sample(range(64), rng.randrange(6)):
            flip[at] = "10"[int(flip[at])]
        prints.append("".join(flip))
    df = spark.createDataFrame(list(enumerate(prints)), "id long, fingerprint string")
    heads = {}
    for i, p in enumerate(prints):
        heads.setdefault(p, i)
    far = lambda a, b: sum(x != y for x, y in zip(a, b))
    want = sorted((min(i, j), max(i, j), far(p, q)) for p, i in heads.items() for q, j in heads.items() if i < j and far(p, q) <= 3)
    assert sorted(map(tuple, text.near(df, "id", 64, 3).collect())) == want and want
    null = spark.createDataFrame([(1, None), (2, "")], "id long, t string")
    assert len({r["fingerprint"] for r in text.fingerprints(null, "id", "t").collect()}) == 1


@pytest.mark.parametrize("bits, radius", [(64, 3), (64, 0), (8, 7), (8, 6), (100, 2), (256, 1), (256, 12), (70, 65)])
def test_simhash_radius_in_blocks(spark, monkeypatch, bits, radius):
    """Keys with more fingerprints than a block, at widths and radii that are cut differently."""
    monkeypatch.setattr(text, "BLOCK", 3)
    rng = random.Random(bits + radius)
    bases = [rng.getrandbits(bits) for _ in range(8)]
    values = [b ^ sum(1 << at for at in rng.sample(range(bits), rng.randrange(min(bits, radius + 3)))) for b in bases for _ in range(10)]
    prints = [f"{v:0{bits}b}" for v in values]
    heads = {}
    for i, p in enumerate(prints):
        heads.setdefault(p, i)
    far = lambda a, b: sum(x != y for x, y in zip(a, b))
    want = sorted((i, j, far(p, q)) for p, i in heads.items() for q, j in heads.items() if i < j and far(p, q) <= radius)
    rows = spark.createDataFrame(list(enumerate(prints)), "id long, fingerprint string")
    assert sorted(map(tuple, text.near(rows, "id", bits, radius).collect())) == want


def test_simhash_radius_of_a_shared_piece(spark):
    """All fingerprints have their first 16 bits in common: that makes no 16 million candidates."""
    rng = random.Random(2)
    values = [rng.getrandbits(48) for _ in range(3_990)]
    values += [v ^ 5 for v in values[:10]]
    rows = spark.createDataFrame([(i, f"{0x3636:016b}{v:048b}") for i, v in enumerate(values)], "id long, fingerprint string")
    began = time.time()
    got = sorted(map(tuple, text.near(rows, "id", 64, 3).collect()))
    assert got == [(i, 3_990 + i, 2) for i in range(10)]
    assert time.time() - began < 45


def test_lru_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(stateful, "CHUNK_ROWS", 37)
    rng = random.Random(3)
    trace = [(f"k{min(rng.randrange(30), rng.randrange(30))}", i) for i in range(500)]
    cache, want = {}, {}
    for key, i in trace:
        want[i] = key in cache
        cache.pop(key, None)
        if len(cache) >= 8:
            del cache[next(iter(cache))]
        cache[key] = None
    got = stateful.lru(spark.createDataFrame(trace, "key string, seq long"), 8)
    assert {r["seq"]: r["hit"] for r in got.collect()} == want


def test_stream_folds_the_log(spark, tmp_path):
    rows = random_log(200, 15)
    source, table = str(tmp_path / "log"), str(tmp_path / "table")
    for part in (rows[:120], rows[120:]):
        logs.append(spark.createDataFrame(part, SCHEMA), source)
        query = ingest.fold_into(ingest.log_stream(spark, source), table, str(tmp_path / "checkpoint"))
        query.awaitTermination()
    got = ingest.current(spark, table).filter("tombstone = 0")
    assert pairs(got) == {k: v for k, v in replay(rows).items() if v is not None}
