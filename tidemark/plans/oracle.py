"""The catalogue's queries in DuckDB SQL. record_crc (no crc32 there) and the native sketches have none."""

from __future__ import annotations

from tidemark.config import DEFAULT
from tidemark.plans.catalogue import ABSENT, CMS_K, CMS_M, HASH_M, HEAVY_K, HEAVY_M, KEYS, PREFIX, RADIUS, START, STOP, TOKENS, WINDOW

_LOG = """log AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_type AS value, CAST(event_type = 'error' AS INTEGER) AS tombstone,
  CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq, event_id // 500 AS run, event_id // 20 + 1 AS segment FROM events)"""
_LATEST = "latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1)"
_LIVE = "live AS (SELECT key, value, ts, seq FROM latest WHERE tombstone = 0)"
_RUNS = "runs AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY ts DESC, seq DESC) = 1)"
_RANGES = "ranges AS (SELECT run, min(key) AS start, max(key) AS stop, count(*) AS n FROM runs GROUP BY run)"
_AGE = "((SELECT max(run) FROM runs) - run) * 10 // ((SELECT max(run) FROM runs) + 1)"
_LEVELED = f"leveled AS (SELECT *, CAST(({_AGE} >= 1)::INT + ({_AGE} >= 3)::INT + ({_AGE} >= 6)::INT AS BIGINT) AS level FROM runs)"
_VERSION = "key, value, tombstone, ts, seq"
_L = f"WITH {_LOG}, {_LATEST}, {_LIVE}"
_R = f"WITH {_LOG}, {_RUNS}, {_RANGES}, {_LEVELED}"
_WIN = "QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1"
_CHUNK = f"(row_number() OVER (ORDER BY key) - 1) // {DEFAULT.sstable_size} AS chunk"


def _values(keys: list[str]) -> str:
    return ", ".join(f"('{k}')" for k in keys)


def _hash(element: str, i: str, m) -> str:
    seed = f"unhex(printf('%08x', {i}) || repeat('00', 28))"
    return f"CAST(('0x' || substr(md5(encode({element}) || {seed}), 1, 16))::UBIGINT % {m} AS BIGINT)"


def _cells(source: str, m, k: int) -> str:
    """source: a select of e and what is kept."""
    return f"SELECT x.*, i, {_hash('e', 'i', m)} AS j FROM ({source}) x, range({k}) r(i)"


_NAMES = "SELECT c_name AS e FROM customer"
_PROBES = "SELECT printf('Customer#%09d', c_custkey + 5000000) AS e FROM customer"
# the width for as many elements as there are; at this rate there are seven hashes for any number above two
_SIZE = "(SELECT CAST(ceil(count(DISTINCT c_name) * abs(ln(0.01)) / (ln(2) * ln(2))) AS UBIGINT) FROM customer)"
_BITS = f"bits AS (SELECT DISTINCT j AS position FROM ({_cells(_NAMES, _SIZE, 7)}))"


def _found(probes: str) -> str:
    return f"SELECT e AS name, bool_and(position IS NOT NULL) AS found FROM ({_cells(f'SELECT DISTINCT e FROM ({probes})', _SIZE, 7)}) LEFT JOIN bits ON j = position GROUP BY e"


_USERS = "SELECT CAST(user_id AS VARCHAR) AS e FROM events"
_PARTS = "SELECT CAST(l_partkey AS VARCHAR) AS e FROM lineitem"


def _cms(elements: str, m: int, k: int) -> str:
    return f"counts AS (SELECT e, count(*) AS c FROM ({elements}) GROUP BY e), cells AS ({_cells('SELECT e, c FROM counts', m, k)}), matrix AS (SELECT i, j, CAST(sum(c) AS BIGINT) AS n FROM cells GROUP BY i, j)"


def _bit8(character: str) -> str:
    return f"lpad(bin(ascii({character})), 8, '0')"


_TZ = "CASE WHEN right(md5({0}), 1) = '0' THEN 4 WHEN right(md5({0}), 1) = '8' THEN 3 WHEN right(md5({0}), 1) IN ('4', 'd') THEN 2 WHEN right(md5({0}), 1) IN ('2', '6', 'b', 'f') THEN 1 ELSE 0 END"


def _bucket(element: str, p: int) -> str:
    two = f"({_bit8(f'substr(md5({element}), 1, 1)')} || {_bit8(f'substr(md5({element}), 2, 1)')})"
    return f"list_sum(list_transform(range({p}), lambda b: CASE WHEN substr({two}, b + 1, 1) = '1' THEN 1 << ({p} - 1 - b)::INTEGER ELSE 0 END))::BIGINT"


def _hll(p: int, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"reg AS (SELECT {keys}{_bucket('c_name', p)} AS bucket, max({_TZ.format('c_name')})::BIGINT AS value FROM customer GROUP BY ALL)"


def _tokens(source: str, id_col: str, column: str) -> str:
    return f"SELECT {id_col}, token, count(*) AS n FROM (SELECT {id_col}, unnest(string_split(translate(lower(coalesce({column}, '')), ',.?!', ''), ' ')) AS token FROM {source}) GROUP BY ALL"


def _prints(source: str, id_col: str, column: str, bits: int = 64) -> str:
    weights = f"SELECT {id_col}, o, substr(md5(token), o + 1, 1) AS ch, sum(n * n) AS w FROM ({_tokens(source, id_col, column)}), range({bits // 8}) r(o) GROUP BY ALL"
    sums = f"SELECT {id_col}, o * 8 + b AS j, sum(CASE WHEN substr({_bit8('ch')}, b + 1, 1) = '1' THEN w ELSE -w END) AS s FROM ({weights}), range(8) q(b) GROUP BY ALL"
    return f"SELECT {id_col}, string_agg(CASE WHEN s > 0 THEN '1' ELSE '0' END, '' ORDER BY j) AS fingerprint FROM ({sums}) GROUP BY {id_col}"


_LEAVES = "n0 AS (SELECT p, coalesce(sha1(n_name), sha1('')) AS h FROM range(32) r(p) LEFT JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS q, n_name FROM nation) ON p = q)"
_MERKLE = ", ".join([_LEAVES] + [f"n{i + 1} AS (SELECT p // 2 AS p, sha1(unhex(max(CASE WHEN p % 2 = 0 THEN h END)) || unhex(max(CASE WHEN p % 2 = 1 THEN h END))) AS h FROM n{i} GROUP BY p // 2)" for i in range(5)])

_BUCKET = f"""WITH RECURSIVE {_LOG}, r AS (SELECT key, ts, seq, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS k FROM log),
f AS (SELECT key, ts, seq, k, {TOKENS - 1} AS tokens, ts AS reset, true AS allowed FROM r WHERE k = 1
  UNION ALL SELECT r.key, r.ts, r.seq, r.k,
    CASE WHEN f.tokens > 0 THEN f.tokens - 1 WHEN f.reset + {WINDOW} <= r.ts THEN {TOKENS - 1} ELSE 0 END,
    CASE WHEN f.tokens = 0 AND f.reset + {WINDOW} <= r.ts THEN r.ts ELSE f.reset END,
    f.tokens > 0 OR f.reset + {WINDOW} <= r.ts
  FROM f JOIN r ON r.key = f.key AND r.k = f.k + 1)"""


def _eight(number: str) -> str:
    """A number as eight bytes, lowest first."""
    return f"unhex(array_to_string(list_reverse(regexp_extract_all(printf('%016x', {number}), '..')), ''))"


_RECORD = f"{_eight('ts')} || unhex(printf('%02x', tombstone)) || {_eight('strlen(key)')} || encode(key) || {_eight('strlen(value)')} || encode(value)"
_EMPTY = ["sha1('')"]
for _ in range(9):
    _EMPTY.append(f"sha1(unhex({_EMPTY[-1]}) || unhex({_EMPTY[-1]}))")
# up to 512 leaves a run
_TREE = [f"m0 AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY key) - 1 AS p, CASE WHEN count(*) OVER (PARTITION BY run) > 1 THEN length(bin(count(*) OVER (PARTITION BY run) - 1)) ELSE 0 END AS height, sha1({_RECORD}) AS h FROM runs)"]
_TREE += [f"m{i + 1} AS (SELECT run, p // 2 AS p, height, CASE WHEN height > {i} THEN sha1(unhex(max(CASE WHEN p % 2 = 0 THEN h END)) || unhex(coalesce(max(CASE WHEN p % 2 = 1 THEN h END), {_EMPTY[i]}))) ELSE max(h) END AS h FROM m{i} GROUP BY run, p // 2, height)" for i in range(9)]
_ROOTS = ", ".join(_TREE)


def _tiered(level: int) -> str:
    """What one level's turn of a size-tiered compaction makes of s<level>."""
    due = f"(SELECT count(DISTINCT run) FROM s{level} WHERE level = {level}) >= {DEFAULT.lsm_max_per_level}"
    number = f"(SELECT coalesce(max(run), -1) + 1 FROM s{level} WHERE level = {level + 1})"
    return f"s{level + 1} AS (SELECT * FROM s{level} WHERE NOT (level = {level} AND {due}) UNION ALL SELECT {level + 1} AS level, {number} AS run, {_VERSION} FROM (SELECT * FROM s{level} WHERE level = {level} {_WIN}) WHERE {due})"


def oracle_sql() -> dict[str, str]:
    prune = "SELECT run, start, stop, n FROM ranges WHERE"
    ends = "SELECT level, run, min(key) AS start, max(key) AS stop FROM leveled GROUP BY level, run"
    overlap = f"SELECT a.level, a.run, b.run AS below FROM ({ends}) a JOIN ({ends}) b ON b.level = a.level + 1 AND a.start <= b.stop AND a.stop >= b.start"
    return {
        "kv_snapshot": f"{_L} SELECT key, value, ts FROM live",
        "kv_deleted_keys": f"{_L} SELECT key, ts FROM latest WHERE tombstone = 1",
        "kv_get": f"{_L} SELECT k.key, value FROM (VALUES {_values(KEYS)}) k(key) LEFT JOIN live USING (key)",
        "kv_multi_get": f"{_L} SELECT k.key, value FROM (SELECT DISTINCT 'u' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key FROM customer) k LEFT JOIN live USING (key)",
        "kv_get_missing": f"{_L} SELECT k.key, value FROM (VALUES {_values(ABSENT)}) k(key) LEFT JOIN live USING (key)",
        "kv_reserved_filter": f"{_L} SELECT key FROM (SELECT key FROM live UNION ALL VALUES ('hll_x'), ('bf_y'), ('cms_z'), ('sh_w'), ('tb_user0'), (''), ('table')) WHERE NOT regexp_matches(key, '^(tb|hll|cms|bf|sh)_') AND key <> ''",
        "kv_range_scan": f"{_L} SELECT key, value FROM live WHERE key BETWEEN '{START}' AND '{STOP}'",
        "kv_range_page": f"{_L} SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS place FROM live WHERE key BETWEEN '{START}' AND '{STOP}' ORDER BY key LIMIT 10 OFFSET 20",
        "kv_prefix_scan": f"{_L} SELECT key, value FROM live WHERE starts_with(key, '{PREFIX}')",
        "kv_prefix_page": f"{_L} SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS place FROM live WHERE starts_with(key, '{PREFIX}') ORDER BY key LIMIT 5 OFFSET 5",
        "memtable_state": f"{_R} SELECT {_VERSION} FROM runs WHERE run = (SELECT max(run) FROM runs)",
        "memtable_overlay": f"{_L} SELECT key, value, ts, seq FROM live",
        "sst_flush": f"{_R} SELECT run, {_VERSION} FROM runs",
        "sst_index": f"{_R} SELECT run, key, row_number() OVER (PARTITION BY run ORDER BY key) - 1 AS position FROM runs",
        "sst_summary": f"{_R}, x AS (SELECT run, key, row_number() OVER (PARTITION BY run ORDER BY key) - 1 AS position FROM runs) SELECT run, start, stop, key, position FROM x JOIN ranges USING (run) WHERE position = 0 OR position = n - 1 OR (position + 1) % (CASE WHEN n <= {DEFAULT.summary_count} THEN 1 ELSE n // {DEFAULT.summary_count} END) = 0",
        "sst_prune_point": f"{_R} {prune} start <= 'u000001' AND stop >= 'u000001'",
        "sst_prune_range": f"{_R} {prune} start <= 'u000001' AND stop >= 'u'",
        "sst_prune_prefix": f"{_R} {prune} stop >= 'u00000' AND (start < 'u00000' OR starts_with(start, 'u00000'))",
        "read_order": f"{_R} SELECT level, run, row_number() OVER (ORDER BY level, run DESC) AS visit FROM (SELECT DISTINCT level, run FROM leveled)",
        "merge_two_runs": f"{_R} SELECT run // 2 AS pair, {_VERSION} FROM runs QUALIFY row_number() OVER (PARTITION BY run // 2, key ORDER BY ts DESC, seq DESC) = 1",
        "compact_size_tiered": f"{_R} SELECT level + 1 AS level, {_VERSION} FROM leveled WHERE level < {DEFAULT.lsm_levels - 1} QUALIFY row_number() OVER (PARTITION BY level, key ORDER BY ts DESC, seq DESC) = 1",
        "compact_leveled_l0": f"{_R}, x AS (SELECT * FROM leveled WHERE level <= 1 {_WIN}) SELECT 1::BIGINT AS level, {_CHUNK}, {_VERSION} FROM x",
        "compact_leveled_ln": f"{_R}, o AS ({overlap}), " + ", ".join(f"x{n} AS (SELECT * FROM leveled WHERE level = {n} OR level = {n + 1} AND run IN (SELECT below FROM o WHERE level = {n}) {_WIN})" for n in (1, 2)) + " " + " UNION ALL ".join(f"SELECT {n + 1}::BIGINT AS level, {_CHUNK}, {_VERSION} FROM x{n}" for n in (1, 2)),
        "store_manifest": f"{_R}, {_ROOTS} SELECT level, run, start, stop, n, h AS root FROM (SELECT DISTINCT level, run FROM leveled) JOIN ranges USING (run) JOIN m9 USING (run)",
        "store_compacted": f"{_R}, s0 AS (SELECT level, run, {_VERSION} FROM leveled), {', '.join(map(_tiered, range(DEFAULT.lsm_levels - 1)))} SELECT * FROM s{DEFAULT.lsm_levels - 1}",
        "store_leveled": f"{_R}, x AS (SELECT * FROM leveled WHERE level <= 1 {_WIN}), y AS (SELECT 1::BIGINT AS level, {_CHUNK.removesuffix(' AS chunk')} + (SELECT coalesce(max(run), -1) + 1 FROM leveled WHERE level = 1) AS run, key FROM x) SELECT level, run, count(*) AS n, min(key) AS start, max(key) AS stop FROM (SELECT level, chunk AS run, key FROM (SELECT level, run AS chunk, key FROM y) UNION ALL SELECT level, run, key FROM leveled WHERE level > 1) GROUP BY level, run",
        "store_reads": f"{_L} SELECT 'get' AS read, k.key, value FROM (VALUES {_values(KEYS)}) k(key) LEFT JOIN live USING (key) UNION ALL SELECT 'range', key, value FROM live WHERE key BETWEEN '{START}' AND '{STOP}' UNION ALL SELECT 'prefix', key, value FROM live WHERE starts_with(key, '{PREFIX}')",
        "compact_chunks": f"{_L}, x AS (SELECT key, {_CHUNK} FROM latest) SELECT chunk, count(*) AS n, min(key) AS start, max(key) AS stop FROM x GROUP BY chunk",
        "compaction_trigger": f"{_R} SELECT level, count(DISTINCT run) AS runs, count(DISTINCT run) >= {DEFAULT.lsm_max_per_level} AS size_tiered_due, count(DISTINCT run) > [{', '.join(map(str, DEFAULT.leveled_max_runs))}][level + 1] AS leveled_due FROM leveled GROUP BY level",
        "run_overlap": f"{_R} {overlap}",
        "wal_segments": f"{_L} SELECT segment, count(*) AS entries, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(tombstone) AS BIGINT) AS deletes FROM log GROUP BY segment",
        "wal_replay": f"{_L} SELECT {_VERSION} FROM latest",
        "wal_after_truncate": f"{_L} SELECT 1::BIGINT AS segment, {_VERSION} FROM log WHERE segment = (SELECT max(segment) FROM log)",
        "wal_trim": f"{_L} SELECT segment - 10 AS segment, count(*) AS entries, min(seq) AS first_seq FROM log WHERE segment > 10 GROUP BY ALL",
        "seeded_hash": "SELECT c_name, " + ", ".join(f"{_hash('c_name', str(i), HASH_M)} AS h{i}" for i in range(3)) + " FROM customer",
        "md5_hex": "SELECT c_name, md5(c_name) AS md5 FROM customer",
        "simhash_bits": f"SELECT c_name, array_to_string(list_transform(string_split(md5(c_name), ''), lambda c: {_bit8('c')}), '') AS bits FROM customer",
        "merkle_runs": f"{_R}, {_ROOTS} SELECT run, h AS root FROM m9",
        "bad_records": f"{_L} SELECT seq, key FROM log WHERE seq % 100 = 7",
        "kv_remove": f"{_L} SELECT {_VERSION} FROM log WHERE key NOT IN (SELECT key FROM latest WHERE tombstone = 1)",
        "admission": f"{_BUCKET} SELECT key AS user, CASE WHEN seq % 10 = 3 THEN 'hll_' || key ELSE key END AS key, ts, seq, allowed, allowed AND seq % 10 <> 3 AS admitted FROM f",
        "token_bucket_state": f"{_BUCKET} SELECT key, tokens, reset FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1",
        "simhash_radius": f"WITH h AS (SELECT fingerprint, min(doc_id) AS id FROM ({_prints('documents', 'doc_id', 'text')}) GROUP BY fingerprint) SELECT a.id AS first, b.id AS second, CAST(hamming(a.fingerprint, b.fingerprint) AS BIGINT) AS distance FROM h a JOIN h b ON a.id < b.id WHERE hamming(a.fingerprint, b.fingerprint) <= {RADIUS}",
        "sketch_hll": f"WITH {_hll(8, 'c_mktsegment')} SELECT c_mktsegment AS name, round(256 * ln(256.0 / (256 - count(*) FILTER (WHERE value > 0))), 6) AS estimate FROM reg GROUP BY c_mktsegment UNION ALL SELECT 'empty', 0.0",
        "sketch_cms": f"WITH {_cms(_PARTS, HEAVY_M, HEAVY_K)} SELECT 'parts' AS name, e AS element, min(n) AS estimate FROM cells JOIN matrix USING (i, j) GROUP BY e",
        "sketch_bf": f"WITH {_BITS}, f AS ({_found(f'{_NAMES} UNION ALL {_PROBES}')}) SELECT 'names' AS name, name AS element, found FROM f",
        "sketch_simhash": f"WITH p AS (SELECT item_id, b.text AS t1, d.text AS t2 FROM benchmark b JOIN documents d ON d.doc_id = b.item_id), a AS ({_prints('p', 'item_id', 't1', 32)}), b AS ({_prints('p', 'item_id', 't2', 32)}) SELECT item_id, CAST(hamming(a.fingerprint, b.fingerprint) AS BIGINT) AS distance FROM a JOIN b USING (item_id)",
        "lru_deletes": f"WITH {_LOG}, t AS (SELECT key, seq, max(CASE WHEN tombstone = 0 THEN seq END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log), c AS (SELECT a.seq, count(DISTINCT b.key) AS between_ FROM t a LEFT JOIN (SELECT * FROM log WHERE tombstone = 0) b ON b.seq > a.before AND b.seq < a.seq WHERE a.before IS NOT NULL GROUP BY a.seq) SELECT key, t.seq, coalesce(between_ < {DEFAULT.cache_size}, false) AS hit FROM t LEFT JOIN c USING (seq)",
        "bf_bits": f"WITH {_BITS} SELECT position FROM bits",
        "bf_find": f"WITH {_BITS} {_found(f'{_NAMES} UNION ALL {_PROBES}')}",
        "bf_false_positives": f"WITH {_BITS} SELECT name FROM ({_found(_PROBES)}) WHERE found",
        "cms_matrix": f"WITH {_cms(_USERS, CMS_M, CMS_K)} SELECT CAST(i AS INTEGER) AS i, j, n FROM matrix",
        "cms_count": f"WITH {_cms(_USERS, CMS_M, CMS_K)} SELECT e AS user, min(n) AS estimate FROM cells JOIN matrix USING (i, j) GROUP BY e",
        "cms_heavy_hitters": f"WITH {_cms(_PARTS, HEAVY_M, HEAVY_K)} SELECT e AS part, min(n) AS estimate, any_value(c) AS n FROM cells JOIN matrix USING (i, j) GROUP BY e HAVING min(n) * 200 >= (SELECT count(*) FROM lineitem)",
        "hll_registers": f"WITH {_hll(8)} SELECT bucket, value FROM reg WHERE value > 0",
        "hll_estimate": f"WITH {_hll(8)} SELECT round(256 * ln(256.0 / (256 - count(*))), 6) AS estimate FROM reg WHERE value > 0",
        "hll_by_group": f"WITH {_hll(10, 'c_mktsegment')} SELECT c_mktsegment, round(1024 * ln(1024.0 / (1024 - count(*))), 6) AS estimate FROM reg WHERE value > 0 GROUP BY c_mktsegment",
        "simhash_tokens": _tokens("documents", "doc_id", "text"),
        "simhash_fingerprint": _prints("documents", "doc_id", "text"),
        "simhash_compare": f"WITH p AS (SELECT item_id, b.text AS t1, d.text AS t2 FROM benchmark b JOIN documents d ON d.doc_id = b.item_id), a AS ({_prints('p', 'item_id', 't1')}), b AS ({_prints('p', 'item_id', 't2')}) SELECT item_id, CAST(hamming(a.fingerprint, b.fingerprint) AS BIGINT) AS distance FROM a JOIN b USING (item_id)",
        "simhash_near_dups": f"SELECT fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM ({_prints('documents', 'doc_id', 'text')}) GROUP BY fingerprint HAVING count(*) > 1",
        "merkle_root": f"WITH {_MERKLE} SELECT h AS root FROM n5",
        "token_bucket": f"{_BUCKET} SELECT key, ts, seq, allowed FROM f",
        "token_bucket_summary": f"{_BUCKET} SELECT key, count(*) AS requests, CAST(sum(allowed::INT) AS BIGINT) AS allowed, CAST(sum((NOT allowed)::INT) AS BIGINT) AS rejected FROM f GROUP BY key",
        "lru_hits": f"WITH {_LOG}, t AS (SELECT key, seq, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS before FROM log), c AS (SELECT a.seq, count(DISTINCT b.key) AS between_ FROM t a LEFT JOIN t b ON b.seq > a.before AND b.seq < a.seq WHERE a.before IS NOT NULL GROUP BY a.seq) SELECT key, t.seq, coalesce(between_ < {DEFAULT.cache_size}, false) AS hit FROM t LEFT JOIN c USING (seq)",
    }
