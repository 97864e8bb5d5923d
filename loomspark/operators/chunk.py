"""Chunks by recursive separators: paragraph, line, word, character."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.fields import chunk_id
from ..session import arrow_map

SEPARATORS = ("\n\n", "\n", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    """Parts of text, each but the first beginning with the separator; empty ones left out."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *(separator + r for r in rest)] if p]


def _packed(parts: list[str], size: int, overlap: int) -> list[str]:
    """Parts joined to chunks of at most size; a chunk begins with the last parts, up to overlap, of the one before."""
    out, held, length = [], [], 0
    for p in parts:
        if held and length + len(p) > size:
            out.append("".join(held).strip())
            while length > overlap or (length and length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    if held:
        out.append("".join(held).strip())
    return [c for c in out if c]


def chunks(text: str, size: int = 1000, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    use = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    out, small = [], []
    for part in _cut(text, separators[use]):
        if len(part) < size:
            small.append(part)
            continue
        out += _packed(small, size, overlap)
        small = []
        out += chunks(part, size, overlap, separators[use + 1 :]) if use + 1 < len(separators) else [part]
    return out + _packed(small, size, overlap)


def chunk_texts(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """(key, chunk_number from 0, chunk_text, chunk_id); null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([chunks(t, size, overlap) if t else [] for t in b.column(1).to_pylist()], pa.list_(pa.string()))], ["k", "c"])

    kind = dict(df.dtypes)[key]
    out = arrow_map(df.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, c array<string>")
    out = out.select(F.col("k").alias(key), F.posexplode("c").alias("chunk_number", "chunk_text"))
    return out.withColumn("chunk_id", chunk_id(F.col(key), F.col("chunk_number")))
