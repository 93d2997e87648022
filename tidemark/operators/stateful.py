"""Ordered folds: token buckets and an LRU cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accesses of a chunk of the cache's trace, and the most chunks (their ends are collected: chunks times capacity rows).
CHUNK_ROWS = 50_000
MAX_CHUNKS = 2_000


def _fold(requests: DataFrame, max_tokens: int, window: int, state: DataFrame | None) -> DataFrame:
    """key, ts, seq, allowed, tokens and reset after the request; rows of the state before have a null seq and allowed."""
    if max_tokens < 1:
        raise ValueError("a bucket has at least one token")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, reset = None, 0, 0
        started = False
        for rows in batches:
            out = []
            for k, ts, known, left, since in zip(rows["key"], rows["ts"], rows["known"], rows["tokens"], rows["reset"]):
                if known:
                    started, key, tokens, reset, ok = True, k, int(left), int(since), None
                elif not started or k != key:
                    started, key, tokens, reset, ok = True, k, max_tokens - 1, ts, True
                elif tokens > 0:
                    tokens, ok = tokens - 1, True
                elif reset + window <= ts:
                    tokens, reset, ok = max_tokens - 1, ts, True
                else:
                    ok = False
                out.append((ok, tokens, reset))
            yield pd.DataFrame({"key": rows["key"], "ts": rows["ts"], "seq": rows["seq"], "allowed": [x[0] for x in out], "tokens": [x[1] for x in out], "reset": [x[2] for x in out]})

    none = F.lit(None).cast("long")
    rows = requests.select("key", "ts", "seq", F.lit(False).alias("known"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("reset"))
    if state is not None:
        rows = rows.unionByName(state.select("key", none.alias("ts"), none.alias("seq"), F.lit(True).alias("known"), "tokens", "reset"))
    rows = rows.repartition("key").sortWithinPartitions("key", F.desc("known"), "ts", "seq")
    return rows.mapInPandas(fold, "key string, ts long, seq long, allowed boolean, tokens long, reset long")


def token_bucket(requests: DataFrame, max_tokens: int, window: int, state: DataFrame | None = None) -> DataFrame:
    """key, ts, seq -> the same and `allowed`. A key's first request makes its bucket and takes a token. A token is taken while there
    is one; with none left, a request `window` seconds after the last reset fills the bucket anew and takes one; others are rejected.
    state: key, tokens, reset of buckets that there are already.

    Requests are dealt by key, sorted, and folded as they stream by: a task holds one key's state, not its requests. The fold of a key is
    one task's, as each decision needs the one before; requests that have no time come first.
    """
    return _fold(requests, max_tokens, window, state).filter("allowed IS NOT NULL").select("key", "ts", "seq", "allowed")


def token_bucket_state(requests: DataFrame, max_tokens: int, window: int, state: DataFrame | None = None) -> DataFrame:
    """key, tokens, reset of each bucket after the requests: the state to store, and to go on from."""
    after = F.struct(F.col("seq").isNotNull().alias("a"), "ts", "seq", "tokens", "reset")
    last = _fold(requests, max_tokens, window, state).groupBy("key").agg(F.max(after).alias("x"))
    return last.select("key", "x.tokens", "x.reset")


def admit(requests: DataFrame, reserved: Column, max_tokens: int, window: int, state: DataFrame | None = None) -> DataFrame:
    """user, key, ts, seq -> the same, allowed (a token was there) and admitted (and the key, by the condition `reserved`, is a user's own). A
    request for a reserved key takes its token too."""
    bucket = token_bucket(requests.select(F.col("user").alias("key"), "ts", "seq"), max_tokens, window, state).select(F.col("key").alias("user"), "seq", "allowed")
    return requests.join(bucket, on=["user", "seq"]).select("user", "key", "ts", "seq", "allowed", (F.col("allowed") & ~reserved).alias("admitted"))


def token_bucket_summary(requests: DataFrame, max_tokens: int, window: int) -> DataFrame:
    one = F.col("allowed").cast("bigint")
    return token_bucket(requests, max_tokens, window).groupBy("key").agg(F.count("*").alias("requests"), F.sum(one).alias("allowed"), F.sum(1 - one).alias("rejected"))


def lru(trace: DataFrame, capacity: int) -> DataFrame:
    """key, seq -> the same and `hit`: whether the key is in a cache of the last `capacity` different keys. Where trace has a boolean
    column `deleted`, such rows are deletions: one says whether it finds its key, whose entry stays where it is. Accesses without a
    place in the trace (a null seq) are not part of it: their hit is null.

    The trace is cut into chunks by its order. What a chunk leaves behind is its last `capacity` different keys; the state before a
    chunk is folded from those, which are few, and every chunk is then replayed on its own. Chunks are even in the values of seq, which
    are taken to be without large gaps.
    """
    if capacity < 1:
        raise ValueError("a cache holds at least one key")
    deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in trace.columns else F.lit(False)
    lost = trace.filter("seq IS NULL").select("key", "seq", F.lit(None).cast("boolean").alias("hit"))
    trace = trace.filter("seq IS NOT NULL").select("key", "seq", deleted.alias("deleted"))
    bounds = trace.agg(F.count("*"), F.min("seq"), F.max("seq")).first()
    n, low, high = bounds[0], bounds[1] or 0, bounds[2] or 0
    parts = max(1, min(MAX_CHUNKS, -(-n // CHUNK_ROWS)))
    width = (high - low) // parts + 1
    rows = trace.select("key", "seq", "deleted", F.floor((F.col("seq") - low) / width).cast("bigint").alias("chunk"))

    last = rows.filter("NOT deleted").groupBy("chunk", "key").agg(F.max("seq").alias("seq"))
    recent = last.withColumn("_rn", F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("seq")))).filter(F.col("_rn") <= capacity)
    ends: dict[int, list[str]] = {}
    for r in recent.orderBy("chunk", "_rn").collect():
        ends.setdefault(r["chunk"], []).append(r["key"])
    before: dict[int, list[str]] = {}
    state: list[str] = []
    for chunk in range(parts + 1):
        before[chunk] = state
        new = ends.get(chunk, [])
        state = (new + [k for k in state if k not in set(new)])[:capacity]

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, cache = None, {}
        for part in batches:
            hits = []
            for k, drop, c in zip(part["key"], part["deleted"], part["chunk"]):
                if c != chunk:
                    chunk, cache = c, dict.fromkeys(reversed(before[c]))
                hit = k in cache
                if not drop:
                    if hit:
                        del cache[k]
                    elif len(cache) >= capacity:
                        del cache[next(iter(cache))]
                    cache[k] = None
                hits.append(hit)
            yield part[["key", "seq"]].assign(hit=hits)

    replayed = rows.repartition("chunk").sortWithinPartitions("chunk", "seq").mapInPandas(replay, "key string, seq long, hit boolean")
    return replayed.unionByName(lost)
