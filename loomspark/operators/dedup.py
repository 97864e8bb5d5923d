"""Duplicates by key, with an explicit total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in order. A combinable aggregate, so copies of a hot key shrink before the shuffle.

    order must be total for a defined result; rows with a null key form a group.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys]), rank).alias("_r"))
    return picked.select(*[F.col(k) if k in keys else F.col(f"_r.`{k}`").alias(k) for k in df.columns])


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    return keep_one(df, [key], [F.col(c) for c in order])


def keep_last(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The row with the greatest ``at`` (micros), then the greatest ``tie``; both descending."""
    rank = F.struct(F.col(at).alias("a"), F.col(tie).alias("b"))
    picked = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns if c != key]), rank).alias("_r"))
    return picked.select(*[F.col(k) if k == key else F.col(f"_r.`{k}`").alias(k) for k in df.columns])


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key repeats: counted first, joined back by key."""
    twice = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")
    return df.join(twice, key)


def first_n(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """At most n rows per key by order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def collapse_lines(c: Column) -> Column:
    """Runs of an equal, non-empty line become one line: a line goes where the one before is equal."""
    lines = F.split(c, "\n", -1)
    before = F.concat(F.array(F.lit(None).cast("string")), lines)
    kept = F.zip_with(lines, before, lambda x, b: F.when((x == "") | ~x.eqNullSafe(b), x))
    return F.array_join(F.array_compact(kept), "\n")
