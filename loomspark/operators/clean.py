"""Boilerplate removal by a table of rules per site, and main text of HTML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import html_text, nfkc
from .dedup import collapse_lines


@dataclass(frozen=True)
class SiteRules:
    """patterns: removed in order, or replaced where given as (pattern, replacement), each with its inline flags; one_pass: the
    removed ones as one alternation; collapse: equal neighbouring lines become one; entities, nfkc: character references decoded
    and characters composed before."""

    patterns: tuple[str | tuple[str, str], ...]
    one_pass: bool = False
    collapse: bool = False
    entities: bool = False
    nfkc: bool = False


def cleaned(text: Column, rules: SiteRules) -> Column:
    out = html_text(text) if rules.entities else text
    out = nfkc(out) if rules.nfkc else out
    steps = [p if isinstance(p, tuple) else (p, "") for p in rules.patterns]
    if rules.one_pass:
        removed = [p for p, to in steps if not to]
        steps = [("|".join(f"(?:{p})" for p in removed), "")] * bool(removed) + [s for s in steps if s[1]]
    for p, to in steps:
        out = F.regexp_replace(out, p, to)
    if rules.collapse:
        out = collapse_lines(out)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def clean_texts(df: DataFrame, text: str, site: Column, rules: dict[str, SiteRules]) -> DataFrame:
    """df with ``text`` cleaned by its site's rules; texts of other sites unchanged; null, empty and emptied ones dropped."""
    out = F.lit(None).cast("string")
    for domain, r in rules.items():
        out = F.when(site == domain, cleaned(F.col(text), r)).otherwise(out)
    unknown = ~F.coalesce(site.isin(*rules), F.lit(False)) if rules else F.lit(True)
    return df.withColumn(text, F.when(unknown, F.col(text)).otherwise(out)).where(F.coalesce(F.col(text), F.lit("")) != "")


def pages_text(pages: DataFrame, key: str, html: str, fallback: Column | None = None, least: int = 150) -> DataFrame:
    """(key, title, text) of pages; where the text is not longer than ``least``, that of the fallback page, if any; shorter ones are dropped."""
    text, title = html_main_text(F.col(html)), html_title(F.col(html))
    if fallback is not None:
        short = F.coalesce(F.length(text), F.lit(0)) <= least
        text, title = F.when(short, html_main_text(fallback)).otherwise(text), F.when(short, html_title(fallback)).otherwise(title)
    return pages.select(key, title.alias("title"), text.alias("text")).where(F.length("text") >= least)


def html_title(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_main_text(c: Column) -> Column:
    """Text of the page without scripts, styles, navigation and tags."""
    body = F.regexp_replace(c, r"(?is)<(script|style|nav|header|footer|aside|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))
