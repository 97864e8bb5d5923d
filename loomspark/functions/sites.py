"""The site of a URL: the longest listed domain that its host is, or ends with after a dot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .urls import host, host_suffixes

INLINE_DOMAINS = 2_000  # up to so many distinct domains are a literal of the plan; more are joined


def with_site(df: DataFrame, url: Column, domains: DataFrame, domain: str = "domain", name: str = "site") -> DataFrame:
    """df with a column ``name``: the site, null where none fits or the URL is null."""
    known = [r[0].lower() for r in domains.select(domain).where(F.col(domain).isNotNull()).distinct().limit(INLINE_DOMAINS + 1).collect()]
    if len(known) <= INLINE_DOMAINS:
        listed = F.array(*[F.lit(d) for d in sorted(known)]).cast("array<string>")
        rows = df.withColumn("_host", host(url))
        return rows.withColumn(name, F.get(F.filter(host_suffixes(F.col("_host")), lambda s: F.array_contains(listed, s)), F.lit(0))).drop("_host")
    hosts = df.select(host(url).alias("_host")).where("_host is not null").distinct()
    parts = hosts.select("_host", F.posexplode(host_suffixes(F.col("_host"))).alias("_place", "_suffix"))
    found = parts.join(domains.select(F.lower(domain).alias("_suffix")).distinct(), "_suffix")
    found = found.groupBy("_host").agg(F.min_by("_suffix", "_place").alias(name))
    return df.withColumn("_host", host(url)).join(found, "_host", "left").drop("_host")
