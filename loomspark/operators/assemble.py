"""Article text from overlapping n-gram fragments.

Fragments of one URL (of one file, where files are the unit of delivery) are
collected in order of position, then joined greedily by longest overlap. The
joining depends on its own result, so it runs in Python over Arrow batches of
whole articles; everything before and after is built-in.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import arrow_map


_BASE, _PRIME = 1_000_003, (1 << 61) - 1


@dataclass(frozen=True)
class Assembly:
    """Variants of the joining. window: a fragment is appended only if its position is at least that of the first less so
    many, prepended only if at most that and so many; once_per_position drops fragments whose position was used."""

    by_word: bool = True
    longest_overlap: int | None = None
    window: int | None = 10
    once_per_position: bool = False
    least_chars: int = 0
    self_overlap: str = "half"  # half | words | border


CANONICAL = Assembly()
BY_WORD_15 = Assembly(longest_overlap=15, window=None, least_chars=100, self_overlap="words")
BY_CHAR_POSITIONS = Assembly(by_word=False, longest_overlap=30, window=None, once_per_position=True, least_chars=150, self_overlap="border")
BY_CHAR = Assembly(by_word=False, longest_overlap=30, window=None, least_chars=150, self_overlap="border")


def fragment(pre: Column, gram: Column, post: Column, pos: Column) -> Column:
    """One fragment's text; near the start of an article a breadcrumb before ' / ' is cut off."""
    s = F.concat(F.coalesce(pre, F.lit("")), F.lit(" "), F.coalesce(gram, F.lit("")), F.lit(" "), F.coalesce(post, F.lit("")))
    at = F.instr(s, F.lit(" / "))
    return F.when((pos < 20) & (at > 0), F.substr(s, at + 3)).otherwise(s)


def join_fragments(texts: list[str], positions: list[int], how: Assembly = CANONICAL) -> str:
    """Texts in order of position -> one text; what never overlaps is left out.

    The longest overlap wins, of equal ones the fragment that comes first, and
    its appending over its prepending. Open fragments are indexed by their
    starts and ends, so a step looks only at those that fit.
    """
    if how.by_word:
        units = [t.split() for t in texts]
        glue = " ".join
    else:
        kept = [(p, t) for p, t in zip(positions, texts) if t]
        positions, units, glue = [p for p, _ in kept], [t for _, t in kept], str
    if len(units) < 2:
        return glue(units[0]) if units and not how.by_word else (texts[0] if texts else "")
    whole, start = units[0], positions[0]
    open_ = {i for i in range(1, len(units)) if units[i] and not (how.once_per_position and positions[i] == start)}
    longest = min(how.longest_overlap or 1 << 60, max((len(units[i]) for i in open_), default=0))
    starts, ends = defaultdict(list), defaultdict(list)  # hashes of every start and end of a fragment up to that length
    for i in sorted(open_):
        u = units[i]
        if how.window is None or positions[i] + how.window >= start:
            for at in enumerate(_start_hashes(u, longest), 1):
                starts[at].append(i)
        if how.window is None or positions[i] - how.window <= start:
            for at in enumerate(_end_hashes(u, longest), 1):
                ends[at].append(i)
    while open_:
        pick = None
        behind_at, before_at = _end_hashes(whole, longest), _start_hashes(whole, longest)
        for k in range(len(behind_at), 0, -1):
            a = next((i for i in starts.get((k, behind_at[k - 1]), ()) if i in open_ and units[i][:k] == whole[len(whole) - k :]), None)
            b = next((i for i in ends.get((k, before_at[k - 1]), ()) if i in open_ and units[i][len(units[i]) - k :] == whole[:k]), None)
            if a is not None or b is not None:
                behind = b is None or (a is not None and a <= b)
                pick = a if behind else b
                break
        if pick is None:
            break
        whole = whole + units[pick][k:] if behind else units[pick][: len(units[pick]) - k] + whole
        open_ -= {i for i in open_ if i == pick or (how.once_per_position and positions[i] == positions[pick])} if how.once_per_position else {pick}
    return glue(whole)


def _start_hashes(units: list[str] | str, most: int) -> list[int]:
    """Hashes of the first 1, 2, ... units, ``most`` at most."""
    out, h = [], 0
    for u in units[:most]:
        h = (h * _BASE + hash(u)) % _PRIME
        out.append(h)
    return out


def _end_hashes(units: list[str] | str, most: int) -> list[int]:
    """Hashes of the last 1, 2, ... units: equal units have the hash they have as a start."""
    out, h, power = [], 0, 1
    for u in units[: -most - 1 : -1]:
        h = (h + hash(u) * power) % _PRIME
        power = power * _BASE % _PRIME
        out.append(h)
    return out


def borders(s: str | list[str]) -> list[int]:
    """Lengths of all prefixes of s that are also suffixes, longest first, by the prefix function in O(n)."""
    fail, k = [0] * len(s), 0
    for i in range(1, len(s)):
        while k and s[i] != s[k]:
            k = fail[k - 1]
        k += s[i] == s[k]
        fail[i] = k
    out, k = [], fail[-1] if s else 0
    while k:
        out.append(k)
        k = fail[k - 1]
    return out


def drop_self_overlap(s: str, how: str = "half") -> str:
    """The text without the start that it repeats at its end."""
    if how == "words":  # limits of the variant: half the text over ten words, else five to fifteen of at most a third
        parts = s.split()
        repeats = borders(parts) if len(s) >= 50 and len(parts) >= 10 else []
        half = len(parts) // 2
        cut = half if half > 10 and half in repeats else next((k for k in repeats if 5 <= k <= min(15, len(parts) // 3)), 0)
        return " ".join(parts[cut:]) if cut else s
    least = 1 if how == "half" else 6
    if len(s) < (2 if how == "half" else 50):
        return s
    return s[next((k for k in borders(s) if least <= k <= len(s) // 2), 0) :]


def ngrams(df: DataFrame, key: str, words: Column, around: int = 1, step: int = 1) -> DataFrame:
    """(key, pos, pre, ngram, post): each step-th word with ``around`` words before and after it, as n-gram files give it."""
    rows = df.select(key, words.alias("_w")).where(F.size("_w") > 0)
    at = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))
    part = lambda a, n: F.array_join(F.slice("_w", a, n), " ")
    cut = F.transform(at, lambda i: F.struct(i.alias("pos"), part(F.greatest(i + 1 - around, F.lit(1)), F.least(i, F.lit(around))).alias("pre"), F.get("_w", i).alias("ngram"), part(i + 2, F.lit(around)).alias("post")))
    return rows.select(key, F.explode(cut).alias("c")).select(key, "c.*")


def finish(s: str) -> str:
    return re.sub(r"\s+", " ", s.replace("|", " ").replace('"', " ").strip())


def assemble(rows: DataFrame, keys: list[str], how: Assembly = CANONICAL) -> DataFrame:
    """rows(*keys, pos, sentence, date) -> (*keys, text, date): one article per key.

    Order: position, then text. date is the first ten characters of the first
    row's. Articles shorter than how.least_chars are left out; empty ones stay
    when it is 0. Null positions count as 999.
    """
    entry = F.struct(F.coalesce("pos", F.lit(999)).alias("pos"), F.coalesce("sentence", F.lit("")).alias("sentence"), F.substring("date", 1, 10).alias("date"))
    # joining costs far more than bytes tell: as many parts as the session shuffles to, whatever their size
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.repartition(parts, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("f"))
    flat = grouped.select(F.struct(*keys).alias("k"), F.col("f.pos").alias("pos"), F.col("f.sentence").alias("s"), F.col("f.date")[0].alias("date"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [finish(drop_self_overlap(join_fragments(s, p, how), how.self_overlap)) for p, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(3)], ["k", "text", "date"])

    kinds = ", ".join(f"{c}: {t}" for c, t in rows.select(*keys).dtypes)
    out = arrow_map(flat, run, f"k struct<{kinds}>, text string, date string").select("k.*", "text", "date")
    return out.where(F.length("text") >= how.least_chars) if how.least_chars else out


def shred(df: DataFrame, key: str, text: str, size: int = 12, step: int = 7) -> DataFrame:
    """(key, pos, sentence): overlapping word windows of a text, for round trips."""
    # the split is a column of its own: inside the lambda it would be made anew for every window
    rows = df.where(F.col(text) != "").select(key, F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ").alias("_w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("_w", i + 1, F.lit(size)), " ").alias("sentence")))
    return rows.select(key, F.explode(cut).alias("c")).select(key, "c.pos", "c.sentence")
