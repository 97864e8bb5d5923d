"""Splitting long texts at natural boundaries.

Method: lexical cohesion. A text is cut into units at its paragraph, line and
sentence ends; blocks of units before and after each gap are compared by the
cosine of their word counts; the depth of each valley of that curve marks a
topic boundary. From a piece's start the deepest valley inside the size window
is its end (a stronger boundary wins among equals, then the later one); where
the window has no such gap the last word end is taken, and without one the cut
is hard. The next piece begins up to ``overlap`` characters earlier, at a word,
or just so many where no word begins there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import arrow_map
from .words import HASHES, slices, words

SIZE, OVERLAP, BLOCK = 1000, 100, 3
GAP = re.compile(r"(\s*\n\s*\n\s*)|(\s*\n\s*)|([.!?…]+[\"”»’)\]]*\s+)")
SPACE = re.compile(r"\s+")


def cohesion(texts: list[list[str]]) -> list[np.ndarray]:
    """For each text's units the cosine of the word counts of the BLOCK units before and after each gap.

    The cosines follow from the products of units less than 2 * BLOCK apart,
    which are found for all texts at once by searching each (unit, word) count
    among those of the units that follow.
    """
    sizes = [len(u) for u in texts]
    lists = [words(x) for units in texts for x in units]
    near = 2 * BLOCK
    # texts are so far apart that no unit is near one of another text
    places = np.concatenate([np.arange(n) + at for n, at in zip(sizes, np.cumsum([0, *[n + near for n in sizes]]))]) if sizes else np.zeros(0, dtype=np.int64)
    span = int(sum(sizes) + near * (len(sizes) + 1))
    flat = np.fromiter(map(HASHES.__getitem__, chain.from_iterable(lists)), dtype=np.uint64, count=sum(map(len, lists)))
    _, word = np.unique(flat, return_inverse=True)
    of = np.repeat(places, [len(x) for x in lists]).astype(np.int64)
    keys, counts = np.unique(word.astype(np.int64) * span + of, return_counts=True)
    unit, dots = keys % span, []
    for d in range(near):  # dots[d][u]: product of the units u and u + d
        at = np.minimum(np.searchsorted(keys, keys + d), max(len(keys) - 1, 0))
        met = (keys[at] == keys + d) & (unit + d < span)
        dots.append(np.bincount(unit[met], weights=counts[met] * counts[at[met]], minlength=span + near))

    def block(d: int, first: np.ndarray, n: int) -> np.ndarray:
        return sum(dots[d][np.maximum(first + i, 0)] * (first + i >= 0) for i in range(n))

    gap = np.arange(span)  # a gap is named by the unit after it
    cross = sum(dots[d][np.maximum(gap + i - d, 0)] * (gap + i - d >= 0) for i in range(BLOCK) for d in range(i + 1, i + 1 + BLOCK))
    own = block(0, gap, BLOCK) + 2 * sum(block(d, gap, BLOCK - d) for d in range(1, BLOCK))  # norm of the block that begins there
    before = np.where(gap >= BLOCK, own[np.maximum(gap - BLOCK, 0)], 0.0)
    for g in range(min(BLOCK, span)):
        before[g] = sum(dots[0][:g]) + 2 * sum(dots[d][u] for d in range(1, BLOCK) for u in range(max(g - d, 0)))
    norm = np.sqrt(before * own)
    sims = np.where(norm > 0, cross / np.maximum(norm, 1e-9), 0.0)
    out, at = [], 0
    for n in sizes:
        out.append(sims[at + 1 : at + n])
        at += n + near
    return out


def depths(similarities: np.ndarray) -> np.ndarray:
    """Valley depth of each gap."""
    sims = similarities.tolist()
    result = np.zeros(len(sims))
    # the peak on either side is the end of the climb away from the gap
    peak = 0.0
    climb = [0.0] * len(sims)
    for order in (range(len(sims)), range(len(sims) - 1, -1, -1)):
        before = None
        for i in order:
            peak = sims[i] if before is None or sims[before] < sims[i] else max(peak, sims[before])
            climb[i] += peak - sims[i]
            before = i
    result[:] = climb
    return result


def _gaps(text: str) -> tuple[list[int], list[int]]:
    """Ends of the units of a text but the last, and how strong a boundary each is."""
    ends, level = [], []
    for m in GAP.finditer(text):
        if 0 < m.end() < len(text):
            ends.append(m.end())
            level.append(3 - (m.lastindex or 3))
    return ends, level


def _placed(text: str, ends: list[int], level: list[int], sims: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    n, depth, cuts = len(text), depths(sims), np.array(ends, dtype=np.int64)
    out, start = [], 0
    while n - start > size:
        lo, hi = np.searchsorted(cuts, start + max(overlap + 1, size // 4)), np.searchsorted(cuts, start + size, side="right")
        if lo < hi:
            end = max((round(float(depth[i]), 6), level[i], ends[i]) for i in range(lo, hi))[2]
        else:
            spaces = [m.end() for m in SPACE.finditer(text, start + overlap + 1, start + size)]
            end = spaces[-1] if spaces else start + size
        out.append((start, end))
        # the overlap begins at a word if one begins in it, else it is cut hard
        back = SPACE.search(text, end - overlap, end) if overlap else None
        start = back.end() if back and back.end() < end else end - overlap
    out.append((start, n))
    return out


def pieces_of(texts: list[str | None], size: int = SIZE, overlap: int = OVERLAP) -> list[list[tuple[int, int]]]:
    """(start, end) of the pieces of each text; they cover it, one (or none, for null and empty) if it fits ``size``."""
    long = [(i, t, *_gaps(t)) for i, t in enumerate(texts) if t and len(t) > size]
    sims = cohesion([[t[a:b] for a, b in zip([0, *ends], [*ends, len(t)])] for _, t, ends, _ in long])
    out = [[(0, len(t))] if t else [] for t in texts]
    for (i, t, ends, level), x in zip(long, sims):
        out[i] = _placed(t, ends, level, x, size, overlap)
    return out


def pieces(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    return pieces_of([text], size, overlap)[0]


def _cut(size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, numbers, begins, stops, parts = [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for doc, text, cut in zip(batch.column(0).to_pylist(), texts, pieces_of(texts, size, overlap)):
                for number, (a, b) in enumerate(cut, 1):
                    ids.append(doc)
                    numbers.append(number)
                    begins.append(a)
                    stops.append(b)
                    parts.append(text[a:b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(begins, pa.int32()), pa.array(stops, pa.int32()), pa.array(parts, pa.string())],
                ["doc_id", "piece_no", "begins", "stops", "piece"],
            )

    return run


def split_texts(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, piece_no from 1, begins, stops, piece): pieces of at most ``size`` code points.

    A text that fits is its own only piece; null and empty texts have none.
    Consecutive pieces share at least one and at most ``overlap`` characters
    (none if it is 0), and each piece is text[begins:stops], so that nothing is
    lost. ``size`` must be greater than ``overlap`` + 1. Map-only, no shuffle.
    """
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return arrow_map(rows, _cut(size, overlap), "doc_id bigint, piece_no int, begins int, stops int, piece string")
