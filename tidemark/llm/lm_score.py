"""Language-model scoring by a weighted backoff automaton.

The model is a bigram model of all training texts, with no cut: p(w | h) = (c(h w) + MU p(w)) / (c(h) + MU), a Dirichlet prior
around p(w) = (c(w) - D) / N for known words; the D V / N that is taken off is the probability of an unknown word. As an
automaton: a state for every word as context and one for none; an arc for every bigram and, at the empty context, every word;
a failure arc from each context to the empty one, whose weight is MU / (c(h) + MU). A text is scored in one traversal from
left to right: as long as the state has no arc for the token, the failure arc's weight is added and followed.

The whole automaton is never in one place. Documents are dealt into blocks of some megabytes by a hash; a block asks for the
counts of exactly the words and bigrams that it has, shard by shard of a hash range, and builds the part of the automaton that
its texts can reach. The shards add up the training counts of all blocks. Everything sent is an array for each block and
shard, at most one entry for each different word or bigram of a block: a word that is in every text costs no more than
another, and no key is hot.

Defined results: a null or empty text has one token, its end; with no text to learn from, N = V = 0 and every token is
unknown with probability 1; repeated rows are texts of their own; a null id counts as the empty text where it picks a fold; columns but
id and text are left out. A very long text makes its block as large: about 100 times its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_bucket, table
from tidemark.llm.packed import Hasher, mix, pack, pack_sorted, portions, slices, unpack, unpack_sorted

#: Strength of the unigram distribution in a context, in tokens; discount of the unigrams.
MU = 200.0
DISCOUNT = 0.75
#: Bytes of text of a block (memory of a task: about 50 times as much).
BLOCK_BYTES = 4 << 20
_ASK = "block long, shard long, k1 binary, n1 binary, k2 binary, n2 binary"
_TELL = "block long, shard long, n1 binary, n2 binary"


#: The hash of a text's end, which is no word's.
_END = np.uint64(0xEF46DB3751D8E999)


class Block:
    """The tokens of a block's texts, their words and bigrams, each sorted by hash. Word 0 is a text's end."""

    def __init__(self, hasher: Hasher, texts: list[bytes | None]):
        hashes, starts = hasher(b" ".join(t or b"" for t in texts))
        ends = np.searchsorted(starts, np.cumsum([len(t or b"") + 1 for t in texts])) if texts else np.zeros(0, np.int64)
        self.lengths = np.diff(ends, prepend=0) + 1
        keys, ids = np.unique(hashes, return_inverse=True)
        h = np.concatenate([[_END], keys])
        # an end before each text is its first context, and the end of the text before it
        self.tokens = np.concatenate([[0], np.insert(ids + 1, ends, 0)])
        self.words = len(h)
        self.codes, self.pair_of = np.unique(self.tokens[:-1] * self.words + self.tokens[1:], return_inverse=True)
        pairs = mix(h[self.codes // self.words], h[self.codes % self.words])
        self.word_order, self.pair_order = np.argsort(h), np.argsort(pairs)
        self.word_keys, self.pair_keys = h[self.word_order], pairs[self.pair_order]

    def counts(self, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words and bigrams in hash order, in those texts that the model learns from."""
        weight = np.repeat(learn.astype(np.float64), self.lengths)
        words = np.bincount(self.tokens[1:], weight, self.words).astype(np.uint32)
        pairs = np.bincount(self.pair_of, weight, len(self.codes)).astype(np.uint32)
        return words[self.word_order], pairs[self.pair_order]


class Automaton:
    """The part of the backoff automaton that a block's texts reach. Known words are states; others lead to the empty context."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, n: int, v: int):
        count = np.empty(block.words)
        count[block.word_order] = words
        pair = np.empty(len(block.codes))
        pair[block.pair_order] = pairs
        self.count = count
        n, v = float(n), float(v)
        p = np.where(count > 0, (count - DISCOUNT) / max(n, 1.0), DISCOUNT * v / n if n else 1.0)
        h, w = np.divmod(block.codes, block.words)
        self.empty = np.log10(p)
        #: For each bigram of the block: its arc, or the failure arc's weight and the arc at the empty context; only the latter where the
        #: word before is no state.
        arc = np.log10((pair + MU * p[w]) / (count[h] + MU))
        self.step = np.where(count[h] == 0, self.empty[w], np.where(pair > 0, arc, np.log10(MU / (count[h] + MU)) + self.empty[w]))

    def scores(self, block: Block) -> np.ndarray:
        """The texts' traversals from left to right. A token's state is known by the token before it, so that the steps of all
        traversals are looked up at once and added up text by text."""
        return np.add.reduceat(self.step[block.pair_of], np.cumsum(block.lengths) - block.lengths)


def _count_words(shards: int):
    """(text) of training documents -> (shard, k1, n1): the different words of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in portions(batches):
            texts = batch.column(0).to_pylist()
            hashes, _ = hasher(b" ".join(t or b"" for t in texts))
            keys, count = np.unique(np.concatenate([hashes, np.full(len(texts), _END)]), return_counts=True)
            count = count.astype(np.uint32)
            rows = [(s, pack_sorted(keys[at]), pack(count[at])) for s, at in slices(keys, shards)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2))], names=["shard", "k1", "n1"])

    return run


def _count_shard(rows: pa.Table) -> pa.Table:
    """One shard's (k1, n1) -> its tokens n and its different words v."""
    keys = np.concatenate([unpack_sorted(x) for x in rows.column("k1").to_pylist()])
    n = sum(int(unpack(x, np.uint32).sum(dtype=np.uint64)) for x in rows.column("n1").to_pylist())
    return pa.table({"n": pa.array([n], pa.int64()), "v": pa.array([len(np.unique(keys))], pa.int64())})


def _ask(shards: int):
    def run(docs: pa.Table) -> pa.Table:
        block = Block(Hasher(), docs.column("text").to_pylist())
        words, pairs = block.counts(docs.column("learn").to_numpy())
        of: dict[int, list] = {}
        for c, keys, counts in ((0, block.word_keys, words), (2, block.pair_keys, pairs)):
            for shard, at in slices(keys, shards):
                of.setdefault(shard, [b""] * 4)[c : c + 2] = [pack_sorted(keys[at]), pack(counts[at])]
        key = docs.column("block")[0].as_py()
        return pa.table([pa.array([key] * len(of), pa.int64()), pa.array(list(of), pa.int64()), *(pa.array([x[c] for x in of.values()], pa.binary()) for c in range(4))], names=["block", "shard", "k1", "n1", "k2", "n2"])

    return run


def _tell(rows: pa.Table) -> pa.Table:
    """Add up a shard's counts over all blocks and give every block the totals of its keys, in its order."""
    out = []
    for k, n in (("k1", "n1"), ("k2", "n2")):
        keys = [unpack_sorted(x) for x in rows.column(k).to_pylist()]
        counts = np.concatenate([unpack(x, np.uint32) for x in rows.column(n).to_pylist()])
        _, of = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(of, counts).astype(np.uint64)[of] if len(of) else np.zeros(0, np.uint64)
        ends = np.cumsum([len(x) for x in keys])
        out.append(pa.array([pack(totals[e - len(x) : e]) for x, e in zip(keys, ends)], pa.binary()))
    return pa.table([rows.column("block"), rows.column("shard"), *out], names=["block", "shard", "n1", "n2"])


def _score(n: int, v: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(Hasher(), docs.column("text").to_pylist())
        told = told.sort_by("shard")
        totals = [np.concatenate([unpack(x) for x in told.column(c).to_pylist()]) for c in ("n1", "n2")]
        automaton = Automaton(block, *totals, n, v)
        ends = np.cumsum(block.lengths)
        count = automaton.count[block.tokens[1:]]
        known = np.add.reduceat((count > 0).astype(np.int64), ends - block.lengths)
        base = np.add.reduceat(np.log10(count + 1), ends - block.lengths) - block.lengths * math.log10(n + v + 1)
        score = automaton.scores(block)
        keep = [docs.column(c) for c in docs.schema.names if c not in ("text", "block")]
        return pa.table([*keep, pa.array(block.lengths), pa.array(known), pa.array([n] * len(score), pa.int64()), pa.array(base), pa.array(score)], names=[c for c in docs.schema.names if c not in ("text", "block")] + ["n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, learn, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score of each row; learn: a boolean column of docs, true
    where the model learns from the row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), learn.alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    # as many shards as blocks, and a shard to 1 GB of text where there is so much that a message would hold few entries
    shards = max(8, min(blocks, 4096 + (size >> 30)))
    words = rows.filter("learn").select("text").mapInArrow(_count_words(shards), "shard long, k1 binary, n1 binary")
    totals = words.groupBy("shard").applyInArrow(_count_shard, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n, v = totals[0] or 0, totals[1] or 0

    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    told = rows.groupBy("block").applyInArrow(_ask(shards), _ASK).groupBy("shard").applyInArrow(_tell, _TELL)
    out = rows.select("doc_id", "learn").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        out = out.add(name, kind)
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(n, v), out)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by a model of those whose crc32 modulo 7 is not 2."""
    out = score(table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

