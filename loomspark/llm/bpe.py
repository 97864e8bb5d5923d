"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: each pre-token's bytes are merged through a segment tree over the
ranks of adjacent pairs. The root holds the leftmost of the lowest ranks; a
merge updates at most three leaves and their paths, so a run of n bytes takes
O(n log n) however long it is. Ids of short pre-tokens are remembered per
worker; the memory is bounded and only saves time.

The vocabulary file's path is a parameter; the driver sends the file to the
executors, which read it once per worker.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from ..session import arrow_map
from .words import slices

# fixed value: the pattern that splits text before the merges of byte_bpe_50k
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_TOKENS, CACHE_CHARS = 250_000, 48
NO_RANK = 1 << 60


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    if n == 2:
        return [ranks[p] for p in parts]
    get = ranks.get
    size = 1 << (n - 2).bit_length()
    # a node holds rank * span + position: its minimum is the leftmost lowest rank
    span = size
    top = NO_RANK * span
    tree = [top] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * span + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while (best := tree[1]) < top:
        i = best % span
        j = after[i]
        k = after[j]
        parts[i] += parts[j]
        after[i] = k
        changed = [(j, top)]
        if k < n:
            before[k] = i
            r = get(parts[i] + parts[k])
            changed.append((i, top if r is None else r * span + i))
        else:
            changed.append((i, top))
        if (h := before[i]) >= 0:
            r = get(parts[h] + parts[i])
            changed.append((h, top if r is None else r * span + h))
        for leaf, value in changed:
            node = size + leaf
            if leaf >= size or tree[node] == value:
                continue
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class _Memory(dict):
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = tuple(merge(token.encode("utf-8", "surrogatepass"), self.ranks))
        if len(token) <= CACHE_CHARS:
            if len(self) >= CACHE_TOKENS:
                self.clear()
            self[token] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function text -> list of ids."""
    memory, split = _Memory(load_ranks(path)), regex.compile(PATTERN).findall

    def encode(text: str | None) -> list[int]:
        return list(chain.from_iterable(map(memory.__getitem__, split(text)))) if text else []

    return encode


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = SparkFiles.get(os.path.basename(path))
        encode = encoder(sent if os.path.exists(sent) else path)
        for batch in slices(batches, 1):
            lists = [np.array(encode(t), dtype=np.int32) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return run


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>) per row, without special tokens; null and empty texts have an empty list.

    The string of a special token is ordinary text. Rows repeated stay repeated; map-only, no shuffle.
    """
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    if os.path.exists(vocabulary):  # else it has to be on the executors
        df.sparkSession.sparkContext.addFile(vocabulary)
    return arrow_map(rows, _encoded(vocabulary), "doc_id bigint, ids array<int>")
