"""Profiles, coverage and row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def profile(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """Per column: rows, nulls, the number of distinct values and the percentages of both, in one pass (HLL) unless exact."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_z") for c in columns], *[distinct(F.col(c)).alias(f"{c}_d") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"{c}_z").alias("n_null"), F.col(f"{c}_d").alias("n_distinct")) for c in columns])
    out = row.select(F.explode(cells).alias("c")).select("c.*")
    share = lambda c: F.when(F.col("n_rows") > 0, F.round(100.0 * F.col(c) / F.col("n_rows"), 4))
    return out.withColumn("pct_null", share("n_null")).withColumn("pct_unique", share("n_distinct"))


def has_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def long_enough(c: Column, least: int) -> Column:
    return F.length(c) >= least


def coverage(expected: DataFrame, got: DataFrame, usable: DataFrame, key: str) -> DataFrame:
    """One row: expected, seen, usable and missing keys and their percentages; one shuffle of distinct keys."""
    tagged = [d.select(key, *[F.lit(int(i == j)).alias(n) for j, n in enumerate("egu")]) for i, d in enumerate((expected, got, usable))]
    flags = reduce(DataFrame.unionByName, tagged).where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(x).alias(x) for x in "egu"]).where("e = 1")
    sums = flags.agg(F.count("*").alias("n_expected"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_seen"), F.coalesce(F.sum("u"), F.lit(0)).alias("n_usable"))
    pct = lambda a, b: F.when(F.col(b) > 0, F.round(100.0 * F.col(a) / F.col(b), 4))
    return sums.select("*", (F.col("n_expected") - F.col("n_seen")).alias("n_missing"), pct("n_seen", "n_expected").alias("pct_seen"), pct("n_usable", "n_seen").alias("pct_usable"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Quartiles and range of a column, what a violin plot would show."""
    q = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    row = df.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), q.alias("q"))
    return row.select("n", "least", "most", F.round(F.col("q")[0], 6).alias("q1"), F.round(F.col("q")[1], 6).alias("median"), F.round(F.col("q")[2], 6).alias("q3"))


def density(df: DataFrame, group: str, value: str, bins: int = 20) -> DataFrame:
    """(group, bin from 0, low, n, share): the outline of each group's violin, in bins of equal width over the whole range."""
    rows = df.where(F.col(value).isNotNull())
    low, high = rows.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    low, width = low or 0.0, ((high or 0.0) - (low or 0.0)) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)) if width else F.lit(0).cast("bigint")
    counted = rows.groupBy(group, at.alias("bin")).agg(F.count("*").alias("n")).withColumn("low", F.round(F.lit(low) + F.col("bin") * width, 6))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(group)), 6))


def existing(df: DataFrame, *names: str) -> DataFrame:
    """Those of the named columns that df has."""
    return df.select(*[n for n in names if n in df.columns])
