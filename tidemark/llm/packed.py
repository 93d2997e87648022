"""Arrays of tokens and hashes, packed for shuffles.

A block of documents exchanges hashes with the rest of the table as arrays, one for each block and shard (a range of
hashes), not as rows. Keys are sorted, so that neighbours differ little, and stored byte plane by byte plane, which the
shuffle's compression makes use of.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Batches are taken in slices of about this many bytes of text; a longer text is a slice of its own.
PIECE = 1 << 22
_SPACE = tuple(b" \t\n\r\x0b\x0c")
#: Bytes that Hasher takes at once; a word of as many or more is hashed alone.
CHUNK = 1 << 16
#: An odd base of the words' polynomials.
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out, done, step = np.ones(n, np.uint64), 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % (1 << 64)
    return out


class Hasher:
    """64-bit hashes of the words between ASCII white space, with A-Z lowered, all words of a chunk at once.

    A word's hash is the polynomial of its bytes at an odd base modulo 2**64, stirred. Prefix sums of byte x power give every
    word's polynomial as a difference, which the inverse power of its start brings to the same scale.
    """

    def __init__(self):
        self.up, self.down = _powers(_BASE, CHUNK), _powers(pow(_BASE, -1, 1 << 64), CHUNK)

    def _chunk(self, data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = np.zeros(len(data) + 2, bool)
        np.logical_not(blank, out=word[1:-1])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        value = (data | (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))).astype(np.uint64)
        value += np.uint64(1)
        value *= self.up[: len(data)]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32)), starts

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes, and where in data they start."""
        whole, at, hashes, starts = np.frombuffer(data, np.uint8), 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        while at < len(whole):
            part = whole[at : at + CHUNK]
            blank = (part == 32) | ((part - np.uint8(9)) < 5)
            if len(part) == CHUNK:
                back = int(blank[::-1].argmax())
                if not blank[len(part) - 1 - back]:
                    end = at + CHUNK
                    while end < len(data) and data[end] not in _SPACE:
                        end += 1
                    hashes.append(np.array([xxhash.xxh64_intdigest(data[at:end].lower())], np.uint64))
                    starts.append(np.array([at]))
                    at = end
                    continue
                part, blank = part[: len(part) - back], blank[: len(part) - back]
            h, s = self._chunk(part, blank)
            hashes.append(h)
            starts.append(s + at)
            at += len(part)
        return np.concatenate(hashes), np.concatenate(starts)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key: even ranges, ascending with the key."""
    return ((keys >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes."""
    v = np.ascontiguousarray(values)
    return v.view(np.uint8).reshape(-1, v.dtype.itemsize).T.tobytes()


def unpack(data: bytes, dtype=np.uint64) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def slices(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Of sorted keys: each shard that has some, and where they are."""
    if len(keys):
        of = shard_of(keys, shards)
        starts = np.flatnonzero(np.diff(of, prepend=of[0] + np.uint64(1)))
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            yield int(of[a]), slice(int(a), int(b))


def portions(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `limit` bytes of a binary column, so that a task's memory doesn't follow the batch size."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Return to the system what is free: the allocators keep it, and a worker that Spark reuses holds it beside all that runs later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, on memory that the worker's last task and this one give back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return wrapped
