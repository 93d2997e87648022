"""MinHash near-duplicates with sequential Bayesian verification.

A text's set is its distinct runs of `shingle` words (as 64-bit hashes). Texts with equal sets are one class, represented by
its smallest id. Representatives get MinHash signatures of BANDS x ROWS hashes; those that agree in a band are candidates.
A pair's signatures are compared batch by batch; after m agreements of n the similarity J has the posterior
Beta(m + 1, n - m + 1), and the pair is dropped once P(J >= threshold) falls under MISS; survivors are verified on
their full sets.

Pairs within a group are not all emitted. First, every candidate is paired with the smallest id of each of its buckets, and
the verified links are joined up into components. That leaves the clusters (candidates that hang together) that have more than
one component; in these, and only across components, all remaining pairs are compared in blocks of at most BLOCK members
against BLOCK, so no link between different texts is lost and no task holds a whole cluster.

A pair at a similarity of 0.8 misses all bands with probability (1 - 0.8**5)**28 = 1.5e-5, and less above.

Defined results: null and empty texts, and texts without a word, have no shingle, are linked with nothing and are kept; a text of
fewer words than a shingle has its whole sequence as one; rows with a null id are linked with nothing and are kept; rows with one
id are one document, which is near what any of their texts is near; an empty table gives no rows. A long text takes about 30 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialise, table
from tidemark.llm.graph import components
from tidemark.llm.packed import Hasher, lean, mix, pack_sorted, portions, unpack_sorted

BANDS, ROWS = 28, 5
HASHES = BANDS * ROWS
BATCH = 20
#: A pair is dropped once the probability that it is similar enough falls below this.
MISS = 1e-5
#: Percent of the union that the intersection must have.
PERCENT = 80
#: Members of a block, in the comparison of what is left of a cluster.
BLOCK = 1024
#: Ids up to this number are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_MULTIPLIERS = np.random.default_rng(20).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words, from the words' hashes."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    out = words[: len(words) - k + 1]
    for j in range(1, k):
        out = mix(out, words[j : len(words) - k + 1 + j])
    return np.unique(out + np.uint64(k))


def signature(keys: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(keys), 512):
        out = np.minimum(out, ((keys[at : at + 512, None] * _MULTIPLIERS) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def least_agreements(percent: int, miss: float) -> list[tuple[int, int]]:
    """After n hashes, the least number that must agree: P(J >= t | m of n) = P(Binomial(n + 1, t) <= m) >= miss."""
    t = percent / 100
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        p, m = 0.0, -1
        while p < miss:
            m += 1
            p += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    lo, hi = sorted((len(a), len(b)))
    if 100 * lo < percent * hi:
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


def _sets(hasher: Hasher, batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    texts = [t or b"" for t in batch.column("text").to_pylist()]
    hashes, starts = hasher(b" ".join(texts))
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
        yield shingles(hashes[start:end], k)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A signature's hash of each band."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = mix(out, rows[:, j])
    return out


def _sketch(k: int):
    """(doc_id, text) -> (doc_id, n, digest, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in portions(batches):
            sizes, digests, bands = [], [], []
            for keys in _sets(hasher, batch, k):
                sizes.append(len(keys))
                digests.append(xxhash.xxh3_128_digest(keys.tobytes()) if len(keys) else None)
                bands.append(band_keys(signature(keys)).tobytes() if len(keys) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.binary())], names=["doc_id", "n", "digest", "bands"])

    return lean(run)


def _full(k: int):
    """(doc_id, text) -> (doc_id, sig, keys), for candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in portions(batches):
            sets = list(_sets(hasher, batch, k))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([signature(x).tobytes() for x in sets], pa.binary()), pa.array([pack_sorted(x) for x in sets], pa.binary())], names=["doc_id", "sig", "keys"])

    return lean(run)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, bands) -> (key, doc_id): a row for each band."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("doc_id").to_numpy(), BANDS))], names=["key", "doc_id"])


def _verify(percent: int):
    """(a, b, sig_a, sig_b, keys_a, keys_b) -> (a, b) of the linked pairs."""
    steps = least_agreements(percent, MISS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            left, agree = np.arange(len(one)), np.zeros(len(one), np.int64)
            for n, least in steps:
                agree = agree + (one[left, n - BATCH : n] == two[left, n - BATCH : n]).sum(axis=1)
                left, agree = left[agree >= least], agree[agree >= least]
            ok = [i for i in left.tolist() if linked(unpack_sorted(batch.column("keys_a")[i].as_py()), unpack_sorted(batch.column("keys_b")[i].as_py()), percent)]
            yield batch.select(["a", "b"]).take(pa.array(ok, pa.int64()))

    return lean(run)


def _rest(percent: int):
    """A block of queries against a block of members of one cluster -> links across labels; one link for two labels of the
    block is enough."""
    steps = least_agreements(percent, MISS)

    def run(rows: pa.Table) -> pa.Table:
        ask = rows.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        ids, labels = rows.column("doc_id").to_numpy(), rows.column("label").to_numpy()
        keys = rows.column("keys").to_pylist()
        members = np.flatnonzero(~ask)
        sets: dict[int, np.ndarray] = {}
        parent: dict[int, int] = {}
        found: list[tuple[int, int]] = []

        def top(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                x = y
            return x

        def keys_of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = unpack_sorted(keys[i])
            return sets[i]

        for q in np.flatnonzero(ask).tolist():
            left = members[labels[members] != labels[q]]
            agree = np.zeros(len(left), np.int64)
            for n, least in steps:
                agree = agree + (sig[left, n - BATCH : n] == sig[q, n - BATCH : n]).sum(axis=1)
                left, agree = left[agree >= least], agree[agree >= least]
            for m in left[np.argsort(-agree, kind="stable")].tolist():
                x, y = top(int(labels[q])), top(int(labels[m]))
                if x != y and linked(keys_of(q), keys_of(m), percent):
                    parent[max(x, y)] = min(x, y)
                    found.append((int(ids[q]), int(ids[m])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row; ids are integers."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sketched = materialise(rows.mapInArrow(_sketch(shingle), "doc_id long, n long, digest binary, bands binary"), "near-sketches")
    classes = sketched.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    heads = sketched.filter("digest IS NOT NULL").join(classes.select("digest", F.col("rep").alias("doc_id")), on=["digest", "doc_id"], how="left_semi").select("doc_id", "bands")
    bands = heads.mapInArrow(lean(_bands), "key long, doc_id long")
    hubs = bands.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("top")).filter("b < top").select("key", "b")
    stars = materialise(bands.join(hubs, on="key").filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct(), "near-stars")

    clustered = components(stars, "near-clusters")
    clusters = clustered.select(F.col("node").alias("doc_id"), F.col("label").alias("cluster"))
    ids = clusters.select("doc_id")
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    full = rows.join(ids, on="doc_id", how="left_semi").mapInArrow(_full(shingle), "doc_id long, sig binary, keys binary")
    candidates = materialise(full, "near-candidates")
    full = candidates.dropDuplicates(["doc_id", "sig"])

    side = lambda c: full.select(F.col("doc_id").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("keys").alias(f"keys_{c}"))
    pairs = stars.join(side("a"), on="a").join(side("b"), on="b")
    links = materialise(pairs.mapInArrow(_verify(percent), "a long, b long"), "near-links")
    labelled = components(links, "near-labels")
    labels = labelled.select(F.col("node").alias("doc_id"), "label")

    members = clusters.join(labels, on="doc_id", how="left").select("doc_id", "cluster", F.coalesce("label", "doc_id").alias("label"))
    members = materialise(members, "near-members")
    sizes = members.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("cluster").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = open_.select("cluster", F.col("main.label").alias("main"), blocks(F.col("n")).alias("of"), blocks(F.col("n") - F.col("main.n")).alias("asks"))
    inside = members.join(open_, on="cluster")
    place = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    against = inside.select("doc_id", "label", "cluster", F.lit(False).alias("ask"), place(F.col("of")).alias("of"), every(F.col("asks")).alias("asks"))
    asking = inside.filter("label <> main").select("doc_id", "label", "cluster", F.lit(True).alias("ask"), every(F.col("of")).alias("of"), place(F.col("asks")).alias("asks"))
    grid = against.unionByName(asking).join(full, on="doc_id")
    more = grid.groupBy("cluster", "of", "asks").applyInArrow(_rest(percent), "a long, b long")
    more = materialise(more, "near-more-links")
    if more.limit(1).count():
        discard(labelled)
        labelled = components(links.unionByName(more), "near-labels")
        labels = labelled.select(F.col("node").alias("doc_id"), "label")

    classes = classes.join(labels.withColumnRenamed("doc_id", "rep"), on="rep", how="left").select("digest", F.coalesce("label", "rep").alias("component"))
    classes = materialise(classes, "near-classes")
    for x in (stars, clustered, candidates, labelled, links, members, more):
        discard(x)
    # a join of two plain shuffles, of which Spark can split a hot class
    out = sketched.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(classes, on="digest", how="left")
    component = F.coalesce(F.col("component"), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """docs with one document of each group of near duplicates: the one with the smallest id. Of rows with one id and text, one stays;
    rows without an id and rows with one id and different texts that no smaller id is near all stay."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    out = docs.join(gone, on=docs[id_col] == gone["_gone"], how="left_anti")
    again = docs.groupBy(docs[id_col].alias("_again")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _again IS NOT NULL").select("_again")
    if not again.limit(1).count():
        return out
    again = materialise(again, "near-again")
    repeated = out[id_col] == again["_again"]
    return out.join(again, on=repeated, how="left_anti").unionByName(out.join(again, on=repeated, how="left_semi").dropDuplicates([id_col, text_col]))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE t END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS reached FROM w UNION SELECT r.id, b FROM r JOIN both_ways ON a = reached),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c ON c.id = w.doc_id LEFT JOIN n USING (doc_id)
"""


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents by two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
