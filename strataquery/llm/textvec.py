"""Words of whole batches of texts as arrays: borders, owners and 64-bit hashes, byte by byte in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import _ODD, _POWERS

#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20
#: Bytes that part words.
BLANKS = [0x20, *range(0x09, 0x0E)]
_BLANK = np.isin(np.arange(256), BLANKS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts in one array, and where each begins (one more: the end). Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about most bytes of text each; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


@dataclass
class Words:
    """All words of a batch of texts, in order."""

    starts: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray
    hashes: np.ndarray
    #: Words before each text; one more: all.
    edges: np.ndarray


def words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Runs of bytes other than space and \\t-\\r. lower: A-Z count as a-z in the hashes."""
    n = len(raw)
    blank = _BLANK[raw]
    begin = np.zeros(n, bool)
    begin[offsets[:-1][offsets[:-1] < n]] = True
    if n:
        begin[1:] |= blank[:-1]
        begin &= ~blank
    starts = np.flatnonzero(begin)
    edges = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(edges))
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, owner, np.zeros(0, np.uint64), edges)
    base = starts[0]
    live = ~blank[base:]
    # A word ends at a blank or where the next text begins, so what lies between two starts is one word and its blanks.
    sizes = np.add.reduceat(live.astype(np.int64), starts - base)
    values = (_LOWER[raw[base:]] if lower else raw[base:]).astype(np.uint64)
    place = np.arange(len(values)) - np.repeat(starts - base, np.diff(starts, append=n))
    mixed = (values + np.uint64(0x51)) * _ODD[1]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _POWERS.upto(int(place.max()) + 1)[place]
    mixed[~live] = 0
    h = np.add.reduceat(mixed, starts - base)
    return Words(starts, sizes, owner, finish(h, sizes), edges)


def finish(h: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Spread a hash over its 64 bits."""
    h = (h ^ (h >> np.uint64(29))) * _ODD[2] + np.asarray(salt).astype(np.uint64) * _ODD[1]
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    return h ^ (h >> np.uint64(29))


class Counter:
    """Sums of counts by key, merged now and then and given out in pieces, so that memory stays bounded."""

    def __init__(self, most: int = 3_000_000):
        self.most, self.keys, self.counts, self.held = most, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.most:
            merged = self.take()
            if len(merged[0]) > self.most // 2:
                return merged
            self.add(*merged)
        return None

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(back, np.concatenate(self.counts), len(keys)).astype(np.int64)
        self.keys, self.counts, self.held = [], [], 0
        return keys, counts


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in sorted_keys; -1 where missing."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)
