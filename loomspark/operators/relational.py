"""Key joins, set operations, upserts and subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_both_parents(child: DataFrame, a: DataFrame, ka: str, b: DataFrame, kb: str) -> DataFrame:
    """Rows of child whose keys are in both parents (two left-semi joins)."""
    return child.join(a.select(ka).distinct(), ka, "left_semi").join(b.select(kb).distinct(), kb, "left_semi")


def insert_absent(target: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of batch to append: keys new to target, the first of each by order; null keys are dropped."""
    fresh = batch.where(F.col(key).isNotNull()).join(target.select(key), key, "left_anti")
    others = [c for c in batch.columns if c != key]
    picked = fresh.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r"))
    return picked.select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in batch.columns])


def filled(left: DataFrame, right: DataFrame, key: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """left outer join with coalesced columns: name -> (first choice, second choice)."""
    return left.join(right, key, "left").select(key, *[F.coalesce(a, b).alias(n) for n, (a, b) in columns.items()])


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in the order of a seeded hash of the key: the same on every run and partitioning."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def seeded_part(df: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """Adds ``part``: 'train' for about ``share`` of the keys, 'test' for the others."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("part", F.when(h < F.lit(int(share * 2**32)), "train").otherwise("test"))


def merged(*results: DataFrame) -> DataFrame:
    """Distinct rows of several result sets, as of a question and its translation."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.distinct()


def closure(events: DataFrame, mentions: DataFrame, articles: DataFrame, event_key: str, article_key: str) -> tuple[DataFrame, DataFrame]:
    """(mentions of the events, articles of those mentions)."""
    m = mentions.join(events.select(event_key), event_key, "left_semi")
    return m, articles.join(m.select(article_key).distinct(), article_key, "left_semi")
