"""Evaluation texts leaking into training text.

Method: greedy string tiling. Runs of ``min_words`` words of the items are
seeds; documents are rolled over with a Karp-Rabin hash and joined to the
seeds; for each document and item passage that share a seed the longest
matches that do not overlap are marked again and again, each found by
extending the rolling-hash seeds, until none of ``min_words`` is left.
Coverage of the passage by its tiles finds reordered copies too.

Items whose texts have at most BROADCAST_CHARS characters, which are counted,
go to the workers, and one map-only pass over the documents does everything.
More items are joined: a bitmap of their seeds, of fixed size, thins out the
documents' seeds in one pass, equal seeds are joined, and only the texts that
share one with a passage are fetched and tiled. Documents are read once for
their seeds however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..session import arrow_map, materialize
from .words import HASHES, hashed_batch, slices, words

BROADCAST_CHARS, BITS = 8_000_000, 27
COVERAGE, LEAK_WORDS = 0.5, 5  # a leaked passage: half of it, in tiles of five words or more
TILE_NAMES = ["doc_id", "item_id", "passage", "passage_words", "matched_words", "tiles", "longest"]
TILE_SCHEMA = "doc_id bigint, item_id bigint, passage int, passage_words int, matched_words int, tiles int, longest int"
RADIX = np.uint64(0x9E3779B97F4A7C15)
ZERO, ONE = np.uint64(0), np.ones(1, dtype=np.uint64)
INVERSE = np.uint64(pow(int(RADIX), -1, 1 << 64))


def rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash (mod 2^64) of each run of ``width`` ids."""
    n = len(ids) - width + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        h *= RADIX
        h += ids[j : j + n]
    return h


class _Runs:
    """Hashes of the runs of any width of a sequence of ids, less what is marked."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.ids, self.free = ids, np.ones(n, dtype=bool)
        self.back = np.cumprod(np.concatenate([ONE, np.full(n, INVERSE)]), dtype=np.uint64)
        powers = np.cumprod(np.concatenate([ONE, np.full(n, RADIX)]), dtype=np.uint64)[:n]
        self.sums = np.concatenate([ONE * ZERO, np.cumsum(ids * powers, dtype=np.uint64)])

    def of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the free runs of the width."""
        free = np.concatenate([[0], np.cumsum(self.free)])
        starts = np.flatnonzero(free[width:] - free[:-width] == width)
        return starts, (self.sums[starts + width] - self.sums[starts]) * self.back[starts]


def tile(text: np.ndarray, passage: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """Tiles (start in text, start in passage, length), longest first; of equal ones the first in text, then in passage.

    The greatest length at which free runs of both have an equal hash is found
    by halving, the runs of it are compared and marked, and so on downwards: no
    list of all matches is made, however often a phrase repeats.
    """
    t, p = _Runs(np.asarray(text, dtype=np.uint64)), _Runs(np.asarray(passage, dtype=np.uint64))
    tiles, most = [], min(len(t.ids), len(p.ids))

    def meet(width: int) -> bool:
        return bool(np.isin(p.of(width)[1], t.of(width)[1]).any())

    while most >= min_words and meet(min_words):
        low, high = min_words, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if meet(middle) else (low, middle - 1)
        starts, hashes = t.of(low)
        places: dict[int, list[int]] = {}
        for j, h in zip(*(x.tolist() for x in p.of(low))):
            places.setdefault(h, []).append(j)
        hit = np.isin(hashes, p.of(low)[1])
        taken = 0
        for i, h in zip(starts[hit].tolist(), hashes[hit].tolist()):
            if i < taken:
                continue
            j = next((j for j in places[h] if p.free[j : j + low].all() and np.array_equal(t.ids[i : i + low], p.ids[j : j + low])), None)
            if j is None:
                continue
            tiles.append((i, j, low))
            taken = i + low
            t.free[i:taken] = p.free[j : j + low] = False
            if not len(p.of(low)[0]):
                break
        most = low - 1
    return tiles


def _codes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, ws), dtype=np.uint64, count=len(ws))


def _tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(TILE_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.int32()] * 5))], TILE_NAMES)


def _tiled(doc: int, item: int, number: int, text: np.ndarray, passage: np.ndarray, min_words: int) -> list[tuple]:
    found = tile(text, passage, min_words)
    return [(doc, item, number, len(passage), sum(x[2] for x in found), len(found), found[0][2])] if found else []


def _reachable(owner: np.ndarray, place: np.ndarray, width: int, passages: int) -> np.ndarray:
    """Words of each passage that lie in a seed of it at one of the places: no tiling covers more."""
    by = np.lexsort((place, owner))
    owner, place = owner[by], place[by]
    step = np.full(len(owner), width)
    same = owner[1:] == owner[:-1]
    step[:-1][same] = np.minimum(np.diff(place)[same], width)
    return np.bincount(owner, weights=step, minlength=passages)


def _tiler(passages: list[tuple[int, int, list[str]]], min_words: int, coverage: float):
    """Tiles of every text with the passages, which are all here; only where they can cover so much of a passage."""
    coded = [(item, number, _codes(ws)) for item, number, ws in passages]
    seeds = [rolled(ids, min_words) for _, _, ids in coded]
    owner = np.repeat(np.arange(len(coded)), [len(x) for x in seeds])
    place = np.concatenate([*(np.arange(len(x)) for x in seeds), np.empty(0, dtype=np.int64)])
    enough = np.maximum(np.array([len(ids) for _, _, ids in coded]) * coverage - 1e-9, 1)
    seeds = np.concatenate([*seeds, np.empty(0, dtype=np.uint64)])
    order = np.argsort(seeds, kind="stable")
    seeds, owner, place = seeds[order], owner[order], place[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            flat, offsets = hashed_batch(batch.column(1).to_pylist())
            h = rolled(flat, min_words)
            spot = np.searchsorted(seeds, h)
            hit = np.flatnonzero(seeds[np.minimum(spot, max(len(seeds) - 1, 0))] == h) if len(seeds) else np.empty(0, dtype=np.int64)
            doc = np.searchsorted(offsets, hit, side="right") - 1
            inside = hit + min_words <= offsets[doc + 1]  # runs over the end of a text are none
            hit, doc, out = hit[inside], doc[inside], []
            ends = np.searchsorted(seeds, h[hit], side="right")
            for d in np.unique(doc).tolist():
                own = doc == d
                spots = np.unique(np.concatenate([np.arange(a, b) for a, b in {*zip(spot[hit[own]].tolist(), ends[own].tolist())}]))
                for k in np.flatnonzero(_reachable(owner[spots], place[spots], min_words, len(coded)) >= enough).tolist():
                    item, number, passage = coded[k]
                    out += _tiled(batch.column(0)[d].as_py(), item, number, flat[offsets[d] : offsets[d + 1]], passage, min_words)
            yield _tile_batch(out)

    return run


def _seeds(min_words: int, bitmap: Broadcast | None):
    """(key..., text) -> (key..., h): the different seeds of each text, those in the bitmap if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, dtype=np.uint8)
        for batch in slices(batches, -1):
            flat, offsets = hashed_batch(batch.column(batch.num_columns - 1).to_pylist())
            lists = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                h = np.unique(rolled(flat[a:b], min_words))
                if bits is not None:
                    place = h >> np.uint64(64 - BITS)
                    h = h[(bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                lists.append(h)
            owner = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            keys = [batch.column(i).take(owner) for i in range(batch.num_columns - 1)]
            values = pa.array(np.concatenate([*lists, np.empty(0, dtype=np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([*keys, values], [*batch.schema.names[:-1], "h"])

    return run


def _tiles_of(min_words: int):
    """(doc_id, item_id, passage, ptext, text) -> tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            out = []
            for doc, item, number, passage, text in zip(*(c.to_pylist() for c in batch.columns)):
                out += _tiled(doc, item, number, _codes(words(text)), _codes(words(passage)), min_words)
            yield _tile_batch(out)

    return run


def _joined_tiles(corpus: DataFrame, passages: DataFrame, min_words: int, coverage: float) -> DataFrame:
    seeds = materialize(arrow_map(passages, _seeds(min_words, None), "item_id bigint, passage int, h bigint"), "seeds")
    place = F.shiftrightunsigned("h", 64 - BITS)
    parts = seeds.groupBy(F.floor(place / 32768).alias("part")).agg(F.bitmap_construct_agg((place % 32768)).alias("bits"))
    bitmap = bytearray((1 << BITS) // 8)
    for r in parts.toLocalIterator():  # at most 2^BITS bits, whatever the items
        bitmap[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    shared = corpus.sparkSession.sparkContext.broadcast(bytes(bitmap))
    met = arrow_map(corpus, _seeds(min_words, shared), "doc_id bigint, h bigint").join(seeds, "h").groupBy("doc_id", "item_id", "passage").agg(F.count("*").alias("n"))
    if coverage:  # so many different seeds cover n * min_words words at most; a passage has about its distinct seeds in words
        sizes = seeds.groupBy("item_id", "passage").agg(F.count("*").alias("size"))
        met = met.join(sizes, ["item_id", "passage"]).where(F.col("n") * min_words >= F.col("size") * coverage)
    met = materialize(met.select("doc_id", "item_id", "passage"), "met")
    texts = corpus.join(met.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = met.join(passages.withColumnRenamed("text", "ptext"), ["item_id", "passage"]).join(texts, "doc_id")
    return arrow_map(rows.select("doc_id", "item_id", "passage", "ptext", "text"), _tiles_of(min_words), TILE_SCHEMA)


def tiles(docs: DataFrame, key: str, text: str, items: DataFrame, min_words: int = 13, most_chars: int = BROADCAST_CHARS, coverage: float = 0.0) -> DataFrame:
    """One row of TILE_SCHEMA per document and item passage with a tile of at least min_words words.

    items(item_id, passages array<string>). Null and empty texts and passages
    match nothing; passages of fewer than min_words words neither; an item or
    passage given twice yields a row each time it is given under another id
    or number. Empty tables give no rows. Pairs of which the seeds show that
    no tiling reaches ``coverage`` are not tiled.
    """
    corpus = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    passages = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.posexplode("passages").alias("passage", "text")).where("text <> ''")
    if (passages.agg(F.sum(F.length("text"))).first()[0] or 0) > most_chars:
        return _joined_tiles(corpus, passages, min_words, coverage)
    here = [(r["item_id"], r["passage"], w) for r in passages.collect() if len(w := words(r["text"])) >= min_words]
    return arrow_map(corpus, _tiler(here, min_words, coverage), TILE_SCHEMA)


def leaks(tiled: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest): best covered passage of each pair, of those covered by ``coverage`` at least.

    With tiles of few words a passage whose sentences come in another order, or
    with others in between, is covered as well as one copied whole.
    """
    share = F.col("matched_words") / F.col("passage_words")
    return tiled.groupBy("doc_id", "item_id").agg(F.max(share).alias("coverage"), F.sum("tiles").alias("tiles"), F.max("longest").alias("longest")).where(F.col("coverage") >= coverage)
