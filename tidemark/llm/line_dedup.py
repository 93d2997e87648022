"""Line dedup by an exact set-similarity join.

A line's set is its distinct words (A-Z lowered, between ASCII white space), as 64-bit hashes; two lines match if the Jaccard
similarity of their sets is at least PERCENT. A line goes if a line before it, in the order of document ids and line numbers,
matches it. Every line that has a word is compared. Sets so small that a word more or less is no match (of 1 to 3 words at
80 percent) match equal sets only.

Lines of equal sets (128-bit digests) are one class, represented by its first line; the others of it go. Classes are compared by a
prefix join: words are ordered by rarity, and two sets that match share one of the first n - ceil(t n) + 1 words of each. Of two
entries of a word, the lengths, the positions and a parity bitmap (whose distance is at most that of the sets) must admit a
match. Of the earlier lines that a line may match, a list of entries hands on a few, which are verified on the words themselves; lines
that match none of these, though a list had more, are joined again, and then all that is admitted is verified.

Rarity is counted over all texts in 2**RARITY_BITS buckets of word hashes: the order needs to be the same everywhere, not to tell
every word from every other, and so the table that all tasks share has one size, whatever the vocabulary. A word that heads very
many lines would be one long list. How many is estimated beforehand from every SAMPLE-th line, and such a list is dealt out to
pairs of groups, so that each two lines still meet in one of them; this moves work, not results.

Defined results: null and empty texts have no word and lose nothing; rows with a null id are not compared; rows with the same id
and text are one document; rows with one id and different texts are documents of their own, in the order of the texts' hashes; the
order of lines is kept; an empty table gives no rows. A long text is one of its task's slices, whose memory is about 60 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialise, table
from tidemark.llm.packed import Hasher, give_back, lean, mix, pack, pack_sorted, portions, slices, unpack, unpack_sorted

PERCENT = 80
#: Buckets of word hashes that rarity is counted in; parts that their sums are shuffled in.
RARITY_BITS = 18
_PARTS = 16
#: One line of so many tells how long the lists will be; a list of more than LIST entries is dealt out to groups.
SAMPLE = 1024
LIST = 32_768
#: A partner less than so far away, of 15 parts of what a match may be, is verified first; of those farther away, a list hands on so
#: many for one line.
NEAR = 8
HANDED = 8
#: The entries that a task gathers before it sends them; entries up to which lists are compared step by step.
SEND = 400_000
SHORT_LIST = 512
#: Bytes of text whose words a task has in arrays at once, and entries of short lists that are compared at once.
SLICE = 1 << 20
STRIDE = 1 << 16
#: 64-bit words of an entry's bitmap, and in the second join, where lists have more that look alike.
NARROW = 2
WIDE = 4
#: Bits of word hashes that tell which lists a second join needs, and how many such words may be told (4 bytes each); beyond, all lists are joined.
HEARD_BITS = 24
HEARD = 1_000_000
BROADCAST_DOCS = 500_000
#: Removed lines' numbers (and 4 for each document) up to which they are broadcast, 4 bytes each; more are joined by shuffle.
BROADCAST_NUMBERS = 8_000_000
_KEY = ["doc_id", "tie"]
_PLACE = [*_KEY, "line"]
_PACKED = "kind int, shard long, k binary, digest binary, map binary, size binary, place binary, doc binary, tie binary, line binary, asks binary"
_SENT = [x.split()[0] for x in _PACKED.split(", ")]
_FOUND = "doc_id long, tie long, line int, of_doc long, of_tie long, of_line int, far int, more boolean"


class Lines:
    """The lines of texts: each line's distinct words in the order of rarity and hash; of lines that have no word heard, none."""

    def __init__(self, hasher: Hasher, texts: list[bytes | None], rarity: np.ndarray, heard: np.ndarray | None = None):
        data = b"\n".join(t or b"" for t in texts)
        hashes, starts = hasher(data)
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        self.count = len(breaks) + 1 if texts else 0
        # the line a text begins with, and each line's text and number in it
        first = np.searchsorted(breaks, np.concatenate([[0], ends[:-1]])) if texts else np.zeros(0, np.int64)
        lines_of = np.diff(first, append=self.count)
        self.doc = np.repeat(np.arange(len(texts)), lines_of)
        self.number = np.arange(self.count) - np.repeat(first, lines_of)
        line = np.repeat(np.arange(self.count), np.diff(np.searchsorted(starts, breaks), prepend=0, append=len(starts))) if texts else np.zeros(0, np.int64)
        if heard is not None:
            some = np.bincount(line, heard[hashes >> np.uint64(64 - HEARD_BITS)], self.count)[line] > 0
            line, hashes = line[some], hashes[some]
        self.line, self.word = _ordered(line, rarity[bucket(hashes)], hashes)
        self.sizes = np.bincount(self.line, minlength=self.count)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.full = np.flatnonzero(self.sizes)

    def fold(self, how: np.ufunc, values: np.ndarray) -> np.ndarray:
        """Values of words, folded over each line (modulo 2**64)."""
        out = np.zeros(self.count, np.uint64)
        if len(values):
            out[self.full] = how.reduceat(values, self.starts[self.full])
        return out


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _ordered(line: np.ndarray, rarity: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (line, hash) in the order of line, rarity (below 256) and hash. line ascends."""
    bits = max(1, int(line[-1]).bit_length()) if len(line) else 1
    code = line.astype(np.uint64) << np.uint64(64 - bits) | rarity.astype(np.uint64) << np.uint64(56 - bits) | hashes >> np.uint64(bits + 8)
    order = np.argsort(code)
    code, word = code[order], hashes[order]
    if ((code[1:] == code[:-1]) & (word[1:] != word[:-1])).any():  # the hashes' last bits decide
        order = np.lexsort((hashes, rarity, line))
        word = hashes[order]
    line = line[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (line[1:] != line[:-1])
    return line[new], word[new]


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of sizes a and b that match: ceil(t (a + b) / (1 + t))."""
    return -(-percent * (a + b) // (100 + percent))


def _prefix(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many words of a set another must share one of; none of sets that match equal ones only."""
    return np.where(100 * sizes >= percent * (sizes + 1), sizes - -(-percent * sizes // 100) + 1, 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (part, n): words by bucket, and (line, words): the buckets of every SAMPLE-th line's distinct words."""
    hasher, total = Hasher(), np.zeros(1 << RARITY_BITS, np.int64)
    for batch in portions(batches, limit=SLICE):
        data = b"\n".join(t or b"" for t in batch.column("text").to_pylist())
        hashes, starts = hasher(data)
        total += np.bincount(bucket(hashes), minlength=len(total))
        cuts = np.unique(np.concatenate([[0], np.searchsorted(starts, np.flatnonzero(np.frombuffer(data, np.uint8) == 10))]))
        cuts = cuts[cuts < len(hashes)]
        sums = np.add.reduceat(hashes, cuts) if len(cuts) else np.zeros(0, np.uint64)
        chosen = np.flatnonzero(mix(sums, sums) % np.uint64(SAMPLE) == 0)
        ends = np.append(cuts, len(hashes))
        words = [pack(bucket(np.unique(hashes[ends[i] : ends[i + 1]])).astype(np.uint32)) for i in chosen.tolist()]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(chosen), pa.int32()), pa.nulls(len(chosen), pa.binary()), pa.array(sums[chosen].view(np.int64)), pa.array(words, pa.binary())], names=["part", "n", "line", "words"])
    parts = [pack(x) for x in total.reshape(_PARTS, -1)]
    yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array(parts, pa.binary()), pa.nulls(_PARTS, pa.int64()), pa.nulls(_PARTS, pa.binary())], names=["part", "n", "line", "words"])


def _add_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << RARITY_BITS) // _PARTS, np.int64)
    for batch in batches:
        for x in batch.column("n").to_pylist():
            total += unpack(x, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([pack(total)], pa.binary())], names=["part", "n"])


def _heads(percent: int, rarity: np.ndarray):
    """(words) of sampled lines -> (bucket): one row for each word of their prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0, np.int64)]
            for x in batch.column("words").to_pylist():
                words = unpack(x, np.uint32).astype(np.int64)
                take = int(_prefix(np.array([len(words)]), percent)[0])
                out.append(words[np.lexsort((words, rarity[words]))][:take])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["bucket"])

    return run


def _rarity(rows: DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket: a rank by the number of its words (8 for each doubling), and the groups its lists are dealt out to."""
    counted = materialise(rows.select("text").mapInArrow(lean(_count), "part int, n binary, line long, words binary"), "line-counts")
    total = np.zeros((_PARTS, (1 << RARITY_BITS) // _PARTS), np.int64)
    for part, n in counted.filter("part IS NOT NULL").select("part", "n").groupBy("part").applyInArrow(_add_up, "part int, n binary").collect():
        total[part] = unpack(n, np.int64)
    rarity = np.minimum(255, np.round(8 * np.log2(total.reshape(-1) + 1))).astype(np.uint8)
    sample = counted.filter("part IS NULL").dropDuplicates(["line"]).select("words")
    heads = sample.mapInArrow(_heads(percent, rarity), "bucket long").groupBy("bucket").agg(F.count("*").alias("n"))
    groups = np.ones(1 << RARITY_BITS, np.uint32)
    for at, n in heads.filter(F.col("n") * SAMPLE > 2 * LIST).collect():
        groups[at] = -(-n * SAMPLE // LIST)
    discard(counted)
    return rarity, groups


def _deal(keys: np.ndarray, digests: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of words -> (entry, key): an entry of a word with g groups goes to the g pairs of groups that have its own."""
    many = groups[bucket(keys)].astype(np.int64)
    entry = np.repeat(np.arange(len(keys)), many)
    if len(entry) == len(keys):
        return entry, keys
    n = many[entry]
    other = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
    own = (digests[entry] % n.astype(np.uint64)).astype(np.int64)
    pair = (np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64)
    return entry, np.where(n > 1, mix(keys[entry], pair), keys[entry])


def _send(parts: list[tuple[np.ndarray, ...]], kind: int, shards: int, names: list[str]) -> pa.RecordBatch:
    """Arrays of entries, whose first is the key that decides the shard -> packed rows, one a shard. Empties parts, and packs one column
    after the other, so that one at a time is held several times over."""
    columns = [list(x) for x in zip(*parts)]
    parts.clear()
    take = lambda: np.concatenate(columns.pop(0))
    keys = take()
    order = np.argsort(keys)
    keys = keys[order]
    at = list(slices(keys, shards))
    out = {"kind": pa.array([kind] * len(at), pa.int32()), "shard": pa.array([s for s, _ in at], pa.int64()), "k": pa.array([pack_sorted(keys[x]) for _, x in at], pa.binary())}
    del keys
    for name in names:
        x = take()[order]
        out[name] = pa.array([x[i].tobytes() if x.dtype == np.uint64 else pack(x[i]) for _, i in at], pa.binary())  # hashes have no planes that are alike
    return pa.RecordBatch.from_arrays([out[c] if c in out else pa.nulls(len(at), pa.binary()) for c in _SENT], names=_SENT)


def _received(rows: pa.Table, column: str, dtype=np.uint64) -> np.ndarray:
    read = unpack_sorted if column == "k" else np.frombuffer if dtype == np.uint64 else unpack
    return np.concatenate([read(x) if column == "k" else read(x, dtype) for x in rows.column(column).to_pylist()])


def _prefixes(lines: Lines, of: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the lines in `of`: which words are in their prefixes, and every word's place in its line."""
    prefix = np.zeros(lines.count, np.int64)
    prefix[of] = _prefix(lines.sizes[of], percent)
    place = np.arange(len(lines.line)) - lines.starts[lines.line]
    return np.flatnonzero(place < prefix[lines.line]), place


def _asking(lines: Lines, wanted: list[list[int] | None]) -> np.ndarray:
    out = np.zeros(lines.count, np.uint8)
    start = np.searchsorted(lines.doc, np.arange(len(wanted)))
    for i, numbers in enumerate(wanted):
        if numbers:
            out[start[i] + np.array(numbers)] = 1
    return out


def _hear(percent: int, rarity: np.ndarray):
    """(text, asks) -> (word): the first bits of the words in the prefixes of lines that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in portions(batches, limit=SLICE):
            lines = Lines(hasher, batch.column("text").to_pylist(), rarity)
            take, _ = _prefixes(lines, np.flatnonzero(_asking(lines, batch.column("asks").to_pylist())), percent)
            words = np.unique(lines.word[take] >> np.uint64(64 - HEARD_BITS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(words)], names=["word"])

    return lean(run)


def _post(shards: int, percent: int, rarity: np.ndarray, groups: np.ndarray, again: bool, words: np.ndarray | None = None):
    """(doc_id, tie, text, asks) -> packed rows of two kinds: prefix entries of the classes (1), and all lines by digest (0).
    again: no lines, and entries that say whether their line asks, of `words` (or all)."""

    wide = WIDE if again else NARROW

    def entries_of(hasher: Hasher, batch: pa.RecordBatch, heard: np.ndarray | None) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """A slice's prefix entries, and its lines; a call of its own, so that its arrays are gone when entries are sent."""
        lines = Lines(hasher, batch.column("text").to_pylist(), rarity, heard)
        doc, tie = (batch.column(c).to_numpy(zero_copy_only=False)[lines.doc] for c in ("doc_id", "tie"))
        number = lines.number.astype(np.int32)
        stirred = mix(lines.word, lines.word)
        digest = lines.fold(np.add, stirred)
        bit, part = np.uint64(1) << (stirred >> np.uint64(58)), stirred >> np.uint64(32) & np.uint64(wide - 1)
        bitmap = np.stack([lines.fold(np.bitwise_xor, np.where(part == w, bit, np.uint64(0))) for w in range(wide)], axis=1)
        at = lines.full
        second = lines.fold(np.add, mix(stirred, lines.word))
        # the first line of each class
        order = at[np.lexsort((number[at], tie[at], doc[at], digest[at]))]
        new = np.ones(len(order), bool)
        new[1:] = digest[order[1:]] != digest[order[:-1]]
        take, place = _prefixes(lines, order[new], percent)
        if heard is not None:
            take = take[heard[lines.word[take] >> np.uint64(64 - HEARD_BITS)]]
        asks = _asking(lines, batch.column("asks").to_pylist()) if again else np.ones(lines.count, np.uint8)
        entry, keys = _deal(lines.word[take], digest[lines.line[take]], groups)
        of, place = lines.line[take][entry], place[take][entry]
        entries = keys, digest[of], bitmap[of], lines.sizes[of].astype(np.uint32), place.astype(np.uint32), doc[of], tie[of], number[of], asks[of]
        return entries, (digest[at], second[at], doc[at], tie[at], number[at])

    def flush(entries: list, every: list) -> Iterator[pa.RecordBatch]:
        if entries:
            yield _send(entries, 1, shards, ["digest", "map", "size", "place", "doc", "tie", "line", "asks"])
        if every:
            yield _send(every, 0, shards, ["digest", "doc", "tie", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, entries, every, held = Hasher(), [], [], 0
        heard = None if words is None else np.zeros(1 << HEARD_BITS, bool)
        if heard is not None:
            heard[words] = True
        for batch in portions(batches, limit=SLICE):
            prefixes, rows = entries_of(hasher, batch, heard)
            held += len(prefixes[0]) + len(rows[0])
            entries.append(prefixes)
            if not again:
                every.append(rows)
            del prefixes, rows
            if held >= SEND:
                yield from flush(entries, every)
                held = 0
        yield from flush(entries, every)

    return lean(run)


def _found(later: tuple, earlier: tuple | None = None, far: np.ndarray | None = None, more: np.ndarray | None = None) -> pa.Table:
    n, kinds = len(later[0]), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    rest = [pa.array(x, t) for x, t in zip((*earlier, far, more), kinds)] if earlier else [pa.nulls(n, t) for t in kinds]
    return pa.table([*map(pa.array, later), *rest], names=["doc_id", "tie", "line", "of_doc", "of_tie", "of_line", "far", "more"])


def _repeats(rows: pa.Table) -> pa.Table:
    """A shard's lines by digest -> those that are not the first of their class."""
    digest, second = _received(rows, "k"), _received(rows, "digest")
    doc, tie, line = _received(rows, "doc", np.int64), _received(rows, "tie", np.int64), _received(rows, "line", np.int32)
    order = np.lexsort((line, tie, doc, second, digest))
    digest, second, doc, tie, line = (x[order] for x in (digest, second, doc, tie, line))
    new = np.ones(len(digest), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (second[1:] != second[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    gone = (doc != doc[first]) | (tie != tie[first]) | (line != line[first])
    return _found((doc[gone], tie[gone], line[gone]))


def _when(doc: np.ndarray, tie: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The order of documents and lines, as one number for each place."""
    if len(doc) and not tie.any() and 0 <= doc.min() and int(doc.max() + 1) * int(line.max() + 1) < 1 << 62:
        return doc * int(line.max() + 1) + line
    by = np.lexsort((line, tie, doc))
    out = np.zeros(len(doc), np.int64)
    out[by[1:]] = np.cumsum((doc[by[1:]] != doc[by[:-1]]) | (tie[by[1:]] != tie[by[:-1]]) | (line[by[1:]] != line[by[:-1]]))
    return out


class _Entries:
    """A shard's prefix entries, one for each word and class, sorted by word and size."""

    def __init__(self, rows: pa.Table, percent: int):
        key, digest = _received(rows, "k"), _received(rows, "digest")
        size = _received(rows, "size", np.uint32)
        order = np.argsort(key)
        of = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0).astype(np.uint64)
        # word, size and a part of the digest in one number; classes that this part doesn't tell apart stand as they may
        order = order[np.argsort(of << np.uint64(36) | np.minimum(size, 65_535)[order].astype(np.uint64) << np.uint64(20) | digest[order] >> np.uint64(44))]
        del of
        bits = _received(rows, "map").reshape(len(key), -1)
        new = np.ones(len(order), bool)
        new[1:] = False
        for x in (key, size, digest, *bits.T):
            x = x[order]
            new[1:] |= x[1:] != x[:-1]
        del digest, x
        starts = np.flatnonzero(new)
        first = order[starts]
        doc, tie, line = _received(rows, "doc", np.int64), _received(rows, "tie", np.int64), _received(rows, "line", np.int32)
        every = _when(doc, tie, line)
        self.places, at = np.unique(every, return_index=True)
        self.doc, self.tie, self.line = doc[at], tie[at], line[at]
        del doc, tie, line, at
        when, asks = np.minimum.reduceat(every[order], starts), np.maximum.reduceat(_received(rows, "asks", np.uint8)[order], starts)
        del every, order, starts, new
        if not asks.all():  # lists that nobody asks are not compared
            _, of = np.unique(key[first], return_inverse=True)
            keep = np.bincount(of, asks)[of] > 0
            first, when, asks = first[keep], when[keep], asks[keep]
        self.key, self.bits, self.when, self.asks = key[first], bits[first], when, asks.astype(bool)
        self.size, self.place, self.percent = size[first].astype(np.int64), _received(rows, "place", np.uint32)[first].astype(np.int64), percent

    def admits(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether entries i and j of a word, of which j is not the shorter, may be of a match, and one of them asks for it; and how
        far apart they are at least, from 0 to 15 of 16 parts of what a match may be."""
        a, b = self.size[i], self.size[j]
        least = needed(a, b, self.percent)
        far, room = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=1, dtype=np.int64), a + b - 2 * least
        ok = (far <= room) & (a >= least) & (np.minimum(a - self.place[i], b - self.place[j]) >= least)
        before = self.when[i] < self.when[j]
        ok &= np.where(before, self.asks[j], self.asks[i]) & (before | (self.when[j] < self.when[i]))
        return ok, 15 * far // np.maximum(room, 1)

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]])) if len(self.key) else np.zeros(0, np.int64)
        return starts, np.diff([*starts, len(self.key)])

    def pairs(self, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Admissible (later, earlier) entries and how far they are apart; a portion has a later one once. most: as many, the nearest, of
        a long list's entry against those before it in size are enough."""
        starts, lengths = self.lists()
        short = np.flatnonzero(lengths <= SHORT_LIST)
        # whole lists of about STRIDE entries together
        for some in np.split(short, np.flatnonzero(np.diff(np.cumsum(lengths[short]) // STRIDE)) + 1):
            n = lengths[some]
            at, last = np.arange(n.sum()) + np.repeat(starts[some] - np.cumsum(n) + n, n), np.repeat((starts + lengths)[some], n)
            step = 0
            while len(at):
                step += 1
                go = at + step < last
                at, last = at[go], last[go]
                go = 100 * self.size[at] >= self.percent * self.size[at + step]  # sizes ascend: all that follow are longer still
                at, last = at[go], last[go]
                ok, far = self.admits(at, at + step)
                one, far = at[ok], far[ok]
                turn = self.when[one] < self.when[one + step]
                yield (one + step)[turn], one[turn], far[turn]
                yield one[~turn], (one + step)[~turn], far[~turn]
        for start, length in zip(starts[lengths > SHORT_LIST].tolist(), lengths[lengths > SHORT_LIST].tolist()):
            for i in range(start, start + length):
                j = np.arange(i + 1, i + 1 + int(np.searchsorted(self.size[i + 1 : start + length], 100 * self.size[i] // self.percent, side="right")))
                ok, far = self.admits(np.full(len(j), i), j)
                j, far = j[ok], far[ok]
                before = self.when[j] < self.when[i]
                yield j[~before], np.full(len(j) - int(before.sum()), i), far[~before]
                near = np.argsort(far[before], kind="stable")[:most]
                for x, f in zip(j[before][near].tolist(), far[before][near].tolist()):
                    yield np.array([i]), np.array([x]), np.array([f])


def _nearest(x: _Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, how far apart, whether there are others): the nearest partner in each list, if it is so near that most such
    match, else up to HANDED that may match."""
    n = len(x.key)
    best, who, count, loose = np.full(n, 16), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    kept = [(np.zeros(0, np.int64),) * 3]
    for a, b, far in x.pairs(HANDED + 1):
        count[a] += 1
        less = far < best[a]
        best[a[less]], who[a[less]] = far[less], b[less]
        loose[a[far >= NEAR]] += 1
        some = (far >= NEAR) & (loose[a] <= HANDED)
        kept.append((a[some], b[some], far[some]))
    near = np.flatnonzero(best < NEAR)
    a, b, far = (np.concatenate(y) for y in zip(*kept))
    open_ = best[a] >= NEAR
    a, b, far = (np.concatenate(y) for y in zip((near, who[near], best[near]), (a[open_], b[open_], far[open_])))
    return a, b, far, count[a] > np.where(best[a] < NEAR, 1, HANDED)


def _join(percent: int, again: bool):
    """A shard's rows -> lines that repeat one of their class, without a partner; or lines with an earlier line that they may match,
    and whether a list has more of them. again: all that they may match."""

    def joined(rows: pa.Table) -> pa.Table:
        x = _Entries(rows, percent)
        if again:
            a, b, far = (np.concatenate(y) for y in zip((np.zeros(0, np.int64),) * 3, *x.pairs(None)))
            more = np.zeros(len(a), bool)
        else:
            a, b, far, more = _nearest(x)
        # each two lines once, by the places of the classes' first lines
        n = len(x.places)
        a, b = np.searchsorted(x.places, x.when[a]), np.searchsorted(x.places, x.when[b])
        flagged = np.zeros(n, bool)
        flagged[a[more]] = True
        both, at = np.unique(a * n + b, return_index=True)
        a, b = np.divmod(both, max(1, n))
        return _found((x.doc[a], x.tie[a], x.line[a]), (x.doc[b], x.tie[b], x.line[b]), far[at], flagged[a])

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        give_back()
        out = _repeats(rows) if key[0].as_py() == 0 else joined(rows)
        give_back()
        return out

    return run


def _wanted(keys: bool):
    """(doc_id, tie, text, wanted lines) -> (doc_id, tie, line, size, wide, keys): the sizes of their sets and parity bitmaps of them, or
    the sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            out = []
            for doc, tie, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "text", "wanted"))):
                lines = (text or b"").split(b"\n")
                for k in wanted:
                    words = set(lines[k].lower().split())
                    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                    if keys:
                        out.append((doc, tie, k, None, None, pack_sorted(np.sort(hashes))))
                    else:
                        odd = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=512) & 1
                        out.append((doc, tie, k, len(words), np.packbits(odd.astype(np.uint8)).view(np.int64).tolist(), None))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], names=["doc_id", "tie", "line", "size", "wide", "keys"])

    return lean(run)


def match(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    lo, hi = sorted((len(a), len(b)))
    if 100 * lo < percent * hi:
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


def _verify(percent: int):
    """(doc_id, tie, line, keys, of_keys) -> (doc_id, tie, line) of the lines that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [i for i, (x, y) in enumerate(zip(batch.column("keys").to_pylist(), batch.column("of_keys").to_pylist())) if match(unpack_sorted(x), unpack_sorted(y), percent)]
            yield batch.select(_PLACE).take(pa.array(ok, pa.int64()))

    return lean(run)


_PARTNER = dict(zip(_PLACE, ("of_doc", "of_tie", "of_line")))


def _sets(rows: DataFrame, pairs: DataFrame, keys: bool, repeated: bool) -> DataFrame:
    """doc_id, tie, line of all lines in pairs, and keys, or size and wide."""
    partners = pairs.select(*[F.col(o).alias(c) for c, o in _PARTNER.items()])
    wanted = pairs.select(*_PLACE).union(partners).groupBy(*_KEY).agg(F.collect_set("line").alias("wanted"))
    wanted = materialise(wanted, "line-wanted")
    ids = F.broadcast(wanted) if wanted.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS else wanted
    sets = rows.join(ids, on=_KEY).select(*_KEY, "text", "wanted")
    sets = sets.mapInArrow(_wanted(keys), "doc_id long, tie long, line int, size int, wide array<long>, keys binary")
    out = materialise(sets.dropDuplicates(_PLACE) if repeated else sets, "line-sets", release=True)
    discard(wanted)
    return out


def _likely(rows: DataFrame, pairs: DataFrame, percent: int, repeated: bool) -> DataFrame:
    """The pairs that wide bitmaps admit, whose distance is at most that of the sets, and `far`, that distance."""
    lean = _sets(rows, pairs, False, repeated)
    other = lean.select(*[F.col(c).alias(o) for c, o in _PARTNER.items()], F.col("size").alias("of_size"), F.col("wide").alias("of_wide"))
    both = pairs.select(*_PLACE, *_PARTNER.values(), "more").join(lean.select(*_PLACE, "size", "wide"), on=_PLACE).join(other, on=list(_PARTNER.values()))
    far = sum((F.bit_count(F.col("wide")[i].bitwiseXOR(F.col("of_wide")[i])) for i in range(8)), F.lit(0))
    least = F.ceil(percent * (F.col("size") + F.col("of_size")) / F.lit(100 + percent))
    both = both.filter(F.col("size") + F.col("of_size") - far >= 2 * least)
    out = materialise(both.groupBy(*_PLACE, *_PARTNER.values()).agg(F.min(far).alias("far"), F.max("more").alias("more")), "line-likely", release=True)
    discard(lean)
    return out


def _matched(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """doc_id, tie, line of the lines of pairs that match a partner, on the words themselves."""
    other = sets.select(*[F.col(c).alias(o) for c, o in _PARTNER.items()], F.col("keys").alias("of_keys"))
    both = pairs.join(sets.select(*_PLACE, "keys"), on=_PLACE).join(other, on=list(_PARTNER.values()))
    return materialise(both.select(*_PLACE, "keys", "of_keys").mapInArrow(_verify(percent), "doc_id long, tie long, line int").distinct(), "line-matched", release=True)


def _open(pairs: DataFrame, matched: DataFrame) -> DataFrame:
    return pairs.join(matched, on=_PLACE, how="left_anti")


def _tie(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, bool]:
    """What tells rows apart that have one id and different texts (0 where no id repeats), and whether any id repeats."""
    repeated = docs.select(F.col(id_col).cast("bigint").alias("i")).filter("i IS NOT NULL").groupBy("i").count().filter("count > 1").limit(1).count() > 0
    return (F.xxhash64(text_col) if repeated else F.lit(0)).cast("bigint"), repeated


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines, removed: of each row, the numbers (from 0, ascending) of the lines that go."""
    tie, gone = _gone(docs, id_col, text_col, percent)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), tie.alias("tie"), (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"))
    none = F.array().cast("array<int>")
    return rows.join(gone, on=_KEY, how="left").select("doc_id", "n_lines", F.coalesce("removed", none).alias("removed"))


def _gone(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[Column, DataFrame]:
    """What tells rows of one id apart, and doc_id, tie, removed of the documents that lose lines."""
    tie, repeated = _tie(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), tie.alias("tie"), F.col(text_col).cast("binary").alias("text")).filter("doc_id IS NOT NULL")
    rarity, groups = _rarity(rows, percent)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # 16 MB of text to a shard, and 1 GB where there is so much that packed rows would hold few entries
    shards = max(8, min(size >> 24, 4096 + (size >> 30)))

    def candidates(rows: DataFrame, again: bool, words: np.ndarray | None = None) -> DataFrame:
        posted = rows.mapInArrow(_post(shards, percent, rarity, groups, again, words), _PACKED)
        return materialise(posted.groupBy("kind", "shard").applyInArrow(_join(percent, again), _FOUND), "line-pairs", release=True)

    found = candidates(rows.withColumn("asks", F.lit(None).cast("array<int>")), False)
    pairs = found.filter("of_doc IS NOT NULL")
    likely = _likely(rows, pairs, percent, repeated)
    sets = _sets(rows, likely, True, repeated)
    # one partner of each line first, then all that were handed on, then, of lines that are still open, all that lists have
    nearest = likely.groupBy(*_PLACE).agg(F.min(F.struct("far", *_PARTNER.values())).alias("x")).select(*_PLACE, *[f"x.{c}" for c in _PARTNER.values()])
    matched = _matched(sets, nearest, percent)
    more = _matched(sets, _open(likely, matched).select(*_PLACE, *_PARTNER.values()), percent)
    gone = found.filter("of_doc IS NULL").select(*_PLACE).union(matched).union(more)
    last = materialise(_open(pairs.filter("more").select(*_PLACE).distinct(), matched.union(more)), "line-open")
    used = [found, likely, sets, matched, more, last]
    if last.limit(1).count():
        asks = last.groupBy(*_KEY).agg(F.collect_set("line").alias("asks"))
        asks = F.broadcast(asks) if last.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS else asks
        words = rows.join(asks, on=_KEY).select("text", "asks").mapInArrow(_hear(percent, rarity), "word int").distinct().limit(HEARD + 1)
        words = words.toArrow().column("word").to_numpy()
        again = candidates(rows.join(asks, on=_KEY, how="left"), True, words if len(words) <= HEARD else None)
        likely = _likely(rows, again, percent, repeated)
        sets = _sets(rows, likely, True, repeated)
        used += [again, likely, sets, _matched(sets, likely, percent)]
        gone = gone.union(used[-1])
    out = materialise(gone.groupBy(*_KEY).agg(F.array_sort(F.collect_set("line")).alias("removed")), "line-gone", release=True)
    for x in used:
        discard(x)
    return tie, out


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs without the lines that match a line before them; documents of which no word is left go as a whole."""
    tie, gone = _gone(docs, id_col, text_col, percent)
    if (gone.agg(F.sum(F.size("removed") + 4)).first()[0] or 0) <= BROADCAST_NUMBERS:
        gone = F.broadcast(gone)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("bigint").alias("doc_id"), tie.alias("tie"), docs[text_col].alias("text"))
    out = rows.join(gone, on=_KEY, how="left")
    # the lines between two that go, for each that goes and the end; in lambdas, so that the text is split once
    split = F.array(F.struct(F.split("text", "\n", -1).alias("lines"), F.concat(F.array(F.lit(-1)), "removed").alias("cuts")))
    kept = lambda x: F.array_join(
        F.flatten(F.transform(x["cuts"], lambda cut, i: F.slice(x["lines"], cut + 2, F.coalesce(F.try_element_at(x["cuts"], i + 2), F.size(x["lines"])) - cut - 1))), "\n"
    )
    left = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.element_at(F.transform(split, kept), 1))
    out = out.select("row", "removed", left.alias("left")).filter(F.col("removed").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("left").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS l FROM documents),
l AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS k FROM d),
s AS (SELECT doc_id, k, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS words FROM l),
c AS (SELECT row_number() OVER (ORDER BY min((doc_id, k))) AS c, words, len(words) AS n, min((doc_id, k)) AS first FROM s WHERE len(words) > 0 GROUP BY words),
t AS (SELECT c, n, unnest(words) AS word FROM c),
g AS (SELECT DISTINCT c FROM (SELECT y.c, x.n + y.n AS both, count(*) AS same FROM t x JOIN t y ON x.word = y.word AND x.c < y.c AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n GROUP BY y.c, x.c, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*)))),
o AS (SELECT doc_id, list(k ORDER BY k) AS gone FROM s JOIN c USING (words) WHERE (doc_id, k) <> first OR c IN (FROM g) GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed_lines FROM d LEFT JOIN o USING (doc_id)
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated lines of all documents."""
    out = repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed_lines"))
