"""Lexical and dense retrieval, candidate fusion and the adaptive cut."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.fields import sigmoid
from ..session import arrow_map, materialize

K1, B = 1.2, 0.75
WORD = r"[\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def _count(items: str, word: str) -> Column:
    return F.size(F.filter(items, lambda x: x == word))


def bm25(df: DataFrame, key: str, text: str, query: list[str], k: int = 100) -> DataFrame:
    """(key, score) of the k best texts for the query words (any of them).

    Term counts of the few query words are taken inside each text, so nothing
    is exploded and only the k best rows are moved; the statistics cover all
    texts and come back as one row. Texts are read once: the counts are kept.
    """
    words = sorted(set(w.lower() for w in query))
    t = df.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("t"))
    counted = materialize(t.select(key, F.size("t").alias("dl"), *[_count("t", w).alias(f"tf{i}") for i, w in enumerate(words)]), "terms")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))]).first()
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log(F.lit(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
        tf = F.col(f"tf{i}")
        score = score + idf * tf / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(stats["avgdl"] or 1.0)))
    hit = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(words))])
    return counted.where(hit).select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def cosine(v: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(v.cast("array<double>"), q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(F.transform(v.cast("array<double>"), lambda a: a * a), F.lit(0.0), lambda a, x: a + x))
    return F.try_divide(dot, norm * F.lit(sum(x * x for x in query) ** 0.5))


def dense(df: DataFrame, key: str, vector: str, query: list[float], k: int = 100) -> DataFrame:
    """(key, score) of the k nearest vectors by cosine, exact."""
    return df.where(F.col(vector).isNotNull()).select(key, F.round(cosine(F.col(vector), query), 6).alias("score")).where("score is not null").orderBy(F.desc("score"), key).limit(k)


def fuse(ranked: dict[str, DataFrame], key: str, k: int = 60) -> DataFrame:
    """Candidates of several rankings (key, score), once each, with a reciprocal-rank score; lists are top-k and small."""
    parts = [d.select(key, F.lit(n).alias("via"), F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("r")) for n, d in ranked.items()]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("via")), "+").alias("via"), F.round(F.sum(1 / (k + F.col("r"))), 8).alias("score"))


def adaptive_cut(df: DataFrame, group: str, rank: str, score: str, limit: int = 10) -> DataFrame:
    """The prefix of each ranked list that is worth showing, with p = sigmoid(score).

    It stops before the first p < 0.25; at ranks 2 and 3 before a drop over
    0.45, later before one over 0.20; from rank 4 on it holds at most ``limit``
    rows (a limit below 4 still shows up to 4, as in the pipeline this follows).
    """
    w = Window.partitionBy(group).orderBy(rank)
    first = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(limit, 4))  # no more can be left
    p = first.withColumn("p", sigmoid(F.col(score))).withColumn("drop", F.lag("p").over(w) - F.col("p"))
    stop = (F.col("p") < 0.25) | F.when(F.col("place").isin(2, 3), F.col("drop") > 0.45).when(F.col("place") >= 4, F.col("drop") > 0.20).otherwise(False)
    cut = p.withColumn("stopped", F.max(stop.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.where("stopped = 0").select(*df.columns, F.round("p", 6).alias("p"))


def text_index(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(postings(term, key, tf), lengths(key, dl)): the tables of a lexical index; df and average length follow from them.

    A posting list of a common term is as long as the corpus; queries filter
    terms before they join.
    """
    t = df.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("t"))
    postings = t.select(key, F.explode("t").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return postings, t.select(key, F.size("t").alias("dl"))


def save_text_index(df: DataFrame, key: str, text: str, path: str, buckets: int = 64) -> None:
    """The index as tables under path: postings in directories by term hash, with the texts' lengths, and the statistics."""
    t = df.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    rows = t.select(key, "dl", F.explode("t").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/statistics")


def search_text_index(spark: SparkSession, path: str, key: str, query: list[str], k: int = 100) -> DataFrame:
    """(key, score) of the k best texts by BM25, from the postings of the query words alone: other buckets are not read."""
    words = sorted(set(w.lower() for w in query))
    stats = spark.read.parquet(f"{path}/statistics").first()
    places = [r["b"] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.pmod(F.xxhash64("w"), F.lit(stats["buckets"])).cast("int").alias("b")).collect()]
    rows = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(places) & F.col("term").isin(words))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))  # a row per query word
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(stats["avgdl"] or 1.0)))
    return rows.join(F.broadcast(df), "term").groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def scan_text_index(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """All postings of a stored index, only the columns asked for."""
    return spark.read.parquet(f"{path}/postings").select(*columns)


def collection(points: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Points that a vector collection of the dimension takes: with a key and a vector of that size, the first by content per key."""
    fit = points.where(F.col(key).isNotNull() & (F.size(vector) == dim))
    others = [c for c in fit.columns if c != key]
    return fit.groupBy(key).agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("_p")).select(key, *[F.col(f"_p.{c}").alias(c) for c in others])


def hashing_encoder(dim: int = 64) -> Callable[[list[str | None]], np.ndarray]:
    """A deterministic stand-in for an embedding model: signed hashed words, unit length."""

    def encode(texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                out[i, h % dim] += 1.0 if h & 0x10000 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return encode


def embed(df: DataFrame, key: str, text: str, encode: Callable[[list[str | None]], np.ndarray] | None = None, at_once: int = 64) -> DataFrame:
    """(key, vector array<float>) by any encoder of lists of texts, ``at_once`` texts a call; null and empty texts are left out."""
    encode = encode or hashing_encoder()
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, at_once):
                part = b.slice(at, at_once)
                v = encode(part.column(1).to_pylist()).astype(np.float32)
                flat = pa.array(v.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), flat)], [key, "vector"])

    return arrow_map(df.where(F.coalesce(F.col(text), F.lit("")) != "").select(key, text), run, f"{key} {kind}, vector array<float>")


def rerank(candidates: DataFrame, group: str, key: str, score: Column | None = None, limit: int = 10) -> DataFrame:
    """Candidates of each group by a scorer's column, best first, cut adaptively; without a scorer the first ``limit`` by their own score."""
    w = Window.partitionBy(group).orderBy(F.desc("s"), key)
    ranked = candidates.withColumn("s", F.col("score") if score is None else score).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= limit).drop("s") if score is None else adaptive_cut(ranked, group, "rank", "s", limit).drop("s")
