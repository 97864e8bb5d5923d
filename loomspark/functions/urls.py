"""URL keys, hosts and domain predicates, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normal_key(c: Column) -> Column:
    """Article key: lower case, outer spaces removed, then one leading http(s):// and one trailing slash."""
    bare = F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(bare, "^https?://", ""), "/$", "")


def scheme_stripped(c: Column) -> Column:
    """The weaker key: every lower-case scheme text removed, nothing else."""
    return F.replace(F.replace(c, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))


def netloc(c: Column) -> Column:
    """Authority part of an absolute URL ('' when there is none); null stays null."""
    return F.regexp_extract(c, r"^[^:/?#]+://([^/?#]*)", 1)


def host(c: Column) -> Column:
    """Host of a URL in lower case, without user, port and a final dot; works without a scheme too."""
    authority = F.regexp_extract(F.trim(c), r"^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//)?([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:\d*)?$", ""))


def host_suffixes(h: Column) -> Column:
    """The host and each of its parents after a dot, longest first."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def in_domains(h: Column, domains: list[str]) -> Column:
    """Host equals a domain or ends with it after a dot."""
    hit = F.lit(False)
    for d in domains:
        hit = hit | (h == d) | h.endswith("." + d)
    return hit


def in_domains_naive(h: Column, domains: list[str]) -> Column:
    """The flawed rule kept for comparison: every 'www.' removed, then equality."""
    return F.replace(h, F.lit("www."), F.lit("")).isin(domains)
