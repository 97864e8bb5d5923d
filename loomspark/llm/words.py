"""Words of a text and stable 64-bit word hashes, for Arrow batches.

A word is a longest run of letters or digits (Unicode), lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORD = re.compile(r"[^\W_]+")
BATCH_BYTES = 4 << 20  # texts worked on at once
CACHE_WORDS = 300_000  # a worker forgets its word hashes beyond so many, for memory's sake only
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    if "İ" in text:  # the one letter whose lower case holds a non-letter
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that the texts of a part take about ``size`` bytes at most, or are one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


HASHES = WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values without visible structure."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def hashed_batch(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, and where each text begins (len + 1 offsets); null has no words."""
    lists = [words(t) if t else [] for t in texts]
    offsets = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter(map(HASHES.__getitem__, chain.from_iterable(lists)), dtype=np.uint64, count=int(offsets[-1]))
    return flat, offsets


def window_hashes(flat: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words, end to end, with offsets.

    A text of fewer words, but at least one, has one element: all its words.
    """
    n = np.diff(offsets)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(count, out=out[1:])
    padded = np.concatenate([flat, np.zeros(width, dtype=np.uint64)])
    rolled = np.zeros(len(flat), dtype=np.uint64)
    for j in range(width):
        rolled *= BASE
        rolled += padded[j : j + len(flat)]
    owner = np.repeat(np.arange(len(n)), count)
    place = np.arange(out[-1]) - out[owner] + offsets[owner]
    result = rolled[place]
    for d in np.flatnonzero((n > 0) & (n < width)):
        h = np.uint64(n[d])
        for w in flat[offsets[d] : offsets[d + 1]]:
            h = np.uint64((int(h) * int(BASE) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        result[out[d]] = h
    return mix(result), out
