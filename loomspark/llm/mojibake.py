"""Text decoded with the wrong character encoding.

Method: expectation-maximization with latent encoding chains. A chain says
which encoding a text was written in and which it was read with, once or
twice; each document has one latent chain or none. Under a chain some of the
document's units (runs of non-ASCII characters for UTF-8 chains, words for
single-byte ones) stand for other characters; how much likelier these are is
told by a character-pair model of the corpus itself, counted without the
documents that hold undeniable traces. The share of each chain per source is
latent too and is estimated over all records of the source, with the corpus
as prior: evidence too weak in one record counts where its source is known to
garble that way. Records are then repaired by their posterior.

Single-byte chains also turn letters into symbols, so their units are words
and, beside them, runs of letters joined by symbols that a chain maps to
letters. A unit is restored by the posterior of the chains that explain it:
the record's own, and the shares of its source for a spot garbled otherwise.

Scale: two map-only passes over the texts; only documents with any evidence
(a few per cent) reach the iterations, which are aggregations by source and
chain, and their texts stay beside the evidence, so that no repair reads or
shuffles the corpus. The pair model counts letters, punctuation and currency
one by one and all other characters by blocks of 256: its alphabet has some
2,400 symbols, its size a bound that no corpus passes.

East Asian multi-byte encodings read as single-byte ones are not among the
chains; UTF-8 read as one is restored in any script.
"""

from __future__ import annotations

import codecs
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import arrow_map, materialize
from .words import slices

UTF8_READ_AS = ("cp1252", "latin_1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866")
# (written in, read as) of single-byte encodings
SINGLE = (
    ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"),
    ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"),
    ("cp850", "cp1252"), ("cp1252", "iso8859_7"), ("cp1252", "cp1254"), ("cp1252", "cp1257"),
)
CHAINS = [f"utf_8>{w}" for w in UTF8_READ_AS] + [f"{a}>{b}" for a, b in SINGLE]
LOST = len(CHAINS)  # characters that are gone, or control characters no text has
CACHE = 200_000
LIMIT, SYMBOL_RATIO = 0x530, 3.0
SPOT_UTF8, SPOT_SINGLE = 0.2, 0.05  # share of units that are garbled in a garbled document
RARE = 0.002  # characters in fewer of the documents count as never seen
RUN, WORD, GONE = re.compile(r"[^\x00-\x7f]+"), re.compile(r"[^\W\d_]*[^\W\d_a-zA-Z][^\W\d_]*"), re.compile("[�\x80-\x84\x86-\x9f]")


def _table(name: str) -> str:
    """256 characters; bytes without one stand for the control character of their number."""
    return "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))


TABLES = {n: _table(n) for n in {*UTF8_READ_AS, *(x for pair in SINGLE for x in pair)}}
ENCODERS = {n: codecs.charmap_build(t) for n, t in TABLES.items()}


# scripts that UTF-8 read as a single-byte encoding may stand for, besides those of _usual
SCRIPTS = ((0x590, 0x700), (0x900, 0x980), (0xE00, 0xE80), (0x3000, 0x3100), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xFF00, 0xFFF0))


def _usual(c: str) -> bool:
    """Letters of the usual alphabets, punctuation and currency: what a repair may yield."""
    o = ord(c)
    return o < 0x80 or 0xA0 <= o < 0x250 or 0x370 <= o < 0x530 or 0x2010 <= o < 0x2040 or 0x20A0 <= o < 0x20C0 or 0x2100 <= o < 0x2200


def _likely(unit: str) -> bool:
    """Whether unit is of the usual characters, with two letters of another script at least if it has any: one alone is chance."""
    other = [c for c in unit if not _usual(c)]
    return not other or (len(other) > 1 and all(any(a <= ord(c) < b for a, b in SCRIPTS) for c in other) and sum(map(str.isalpha, other)) > 1)


def symbols(code: np.ndarray) -> np.ndarray:
    """The model's symbol of each code point: itself, or its block."""
    own = (code < LIMIT) | ((code >= 0x2000) & (code < 0x2300))
    return np.where(own, code, 0x4000 + (code >> 8))


def undo(unit: str, wrong: str, twice: int = 3) -> str | None:
    """The UTF-8 text that, read as ``wrong`` up to ``twice`` times, gave unit; None if it did not."""
    done = None
    while twice and not unit.isascii():
        try:
            unit = codecs.charmap_encode(unit, "strict", ENCODERS[wrong])[0].decode("utf-8")
        except UnicodeError:
            return done
        if _likely(unit):
            done = unit
        twice -= 1
    return done


def swap(word: str, written: str, wrong: str) -> str | None:
    try:
        return codecs.charmap_decode(codecs.charmap_encode(word, "strict", ENCODERS[wrong])[0], "strict", TABLES[written])[0]
    except UnicodeError:
        return None


class _Hard(dict):
    """run -> whether some UTF-8 chain explains it."""

    def __missing__(self, run: str) -> bool:
        if len(self) > CACHE:
            self.clear()
        v = self[run] = len(run) > 1 and any(undo(run, w) is not None for w in UTF8_READ_AS[:7])
        return v


HARD = _Hard()


def plainly_garbled(text: str) -> bool:
    return any(map(HARD.__getitem__, RUN.findall(text))) or bool(GONE.search(text))


# --- the pair model -------------------------------------------------------


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, int] = {}
    for batch in slices(batches, 0):
        clean = [t for t in batch.column(0).to_pylist() if t and not plainly_garbled(t)]
        totals[0] = totals.get(0, 0) + len(clean)
        for c in itertools.chain.from_iterable(map(set, clean)):
            if "~" < c and ord(c) < 0x2300:
                totals[ord(c)] = totals.get(ord(c), 0) + 1
        code = np.frombuffer("\n".join(clean).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        if len(code) < 2:
            continue
        code = symbols(code)
        a, b = code[:-1], code[1:]
        for first, n in enumerate(np.bincount(a).tolist()):
            if n:
                totals[first << 16 | 0xFFFF] = totals.get(first << 16 | 0xFFFF, 0) + n
        pick = (a > 126) | (b > 126)
        keys, counts = np.unique(a[pick] << 16 | b[pick], return_counts=True)
        for k, n in zip(keys.tolist(), counts.tolist()):
            totals[k] = totals.get(k, 0) + n
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], ["pair", "n"])


def pair_model(df: DataFrame, text: str) -> dict[int, int]:
    """Counts of character pairs with a non-ASCII character (first << 16 | second) and of all first characters (second 0xffff); documents of each character (no first) and of all (0)."""
    counted = df.select(F.col(text).alias("text")).where("text is not null")
    summed = arrow_map(counted, _pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in summed.collect()}  # pairs of the model's alphabet


class PairModel:
    def __init__(self, counts: dict[int, int]):
        self.counts = counts
        self.least = counts.get(0, 0) * RARE
        self.memory: dict[tuple[str, str], float] = {}

    def rare(self, c: int) -> bool:
        return (126 < c < LIMIT or 0x2000 <= c < 0x2300) and self.counts.get(c, 0) < self.least

    @staticmethod
    def symbol(c: str) -> int:
        o = ord(c)
        return o if o < LIMIT or 0x2000 <= o < 0x2300 else 0x4000 + (o >> 8)

    def one(self, a: str, b: str) -> float:
        v = self.memory.get((a, b))
        if v is None:
            x, y = self.symbol(a), self.symbol(b)
            share = 0.05 / 20.0 if self.rare(x) else ((0 if self.rare(y) else self.counts.get(x << 16 | y, 0)) + 0.05) / (self.counts.get(x << 16 | 0xFFFF, 0) + 20.0)
            if a.isupper() and not b.islower():  # text in capitals is rare but no other text
                share += 0.1 * math.exp(self.one(a.lower()[0], b.lower()[0]))
            v = self.memory[a, b] = math.log(share)
        return v

    def score(self, s: str) -> float:
        """Log probability of the pairs of s that hold a non-ASCII character."""
        return sum(self.one(a, b) for a, b in zip(s, s[1:]) if a > "~" or b > "~")


# --- evidence -------------------------------------------------------------


def _letter_symbols(written: str, wrong: str) -> str:
    """Symbols that letters of the one encoding show as in the other."""
    return "".join(b for a, b in zip(TABLES[written], TABLES[wrong]) if a.isalpha() and _usual(a) and a > "~" and b > "~" and not b.isalpha() and not "\x80" <= b <= "\x9f")


JOINING = [_letter_symbols(*pair) for pair in SINGLE]
JOINED = re.compile(r"[^\W\d_]*[{0}](?:[^\W\d_]|[{0}])*".format(re.escape("".join(sorted(set("".join(JOINING)))))))


class Evidence:
    """Log-likelihood ratios of the units of a text under each chain, against their being what they are."""

    def __init__(self, counts: dict[int, int]):
        self.model = PairModel(counts)
        self.runs: dict[str, tuple] = {}
        self.words: dict[str, tuple] = {}

    def of_run(self, before: str, run: str, after: str) -> tuple[tuple[int, float, str], ...]:
        got = self.runs.get((before, run, after))
        if got is None:
            got, own = [], None
            for k, w in enumerate(UTF8_READ_AS if len(run) > 1 else ()):
                if (fixed := undo(run, w)) is not None:
                    own = self.model.score(before + run + after) if own is None else own
                    ratio = (self.model.score(before + fixed + after) if not fixed.isascii() else -8.0) - own
                    if ratio > 0:
                        got.append((k, ratio, fixed))
            if len(self.runs) > CACHE:
                self.runs.clear()
            got = self.runs[before, run, after] = tuple(got)
        return got

    def of_word(self, word: str) -> tuple[tuple[int, float, str], ...]:
        got = self.words.get(word)
        if got is None:
            got, framed = [], f" {word} "
            own = self.model.score(framed)
            for k, (written, wrong) in enumerate(SINGLE, len(UTF8_READ_AS)):
                fixed = swap(word, written, wrong)
                if fixed is not None and fixed != word and word.isalpha() and (len(word) > 1 or self.model.rare(ord(word))) and all(map(_usual, fixed)):
                    ratio = self.model.score(f" {fixed} ") - own
                    if ratio > 0:
                        got.append((k, ratio, fixed))
            if len(self.words) > CACHE:
                self.words.clear()
            got = self.words[word] = tuple(got)
        return got

    def of_symbols(self, before: str, unit: str, after: str) -> tuple[tuple[int, float, str], ...]:
        """As of_word, of letters joined by symbols, where the symbols go and the unit becomes a word."""
        got = self.runs.get((before, unit, after, 1))
        if got is None:
            got, own = [], None
            for k, (written, wrong) in enumerate(SINGLE, len(UTF8_READ_AS)):
                if not any(c in JOINING[k - len(UTF8_READ_AS)] for c in unit):
                    continue
                fixed = swap(unit, written, wrong)
                if fixed is not None and len(fixed) > 2 and fixed.isalpha() and all(map(_usual, fixed)):
                    own = self.model.score(before + unit + after) if own is None else own
                    ratio = self.model.score(before + fixed + after) - own
                    if ratio > SYMBOL_RATIO:
                        got.append((k, ratio, fixed))
            if len(self.runs) > CACHE:
                self.runs.clear()
            got = self.runs[before, unit, after, 1] = tuple(got)
        return got

    def joined(self, text: str) -> list[tuple[tuple[int, float, str], ...]]:
        return [x for m in JOINED.finditer(text) if (x := self.of_symbols(text[m.start() - 1 : m.start()] or "\n", m.group(), text[m.end() : m.end() + 1] or "\n"))]

    def chains(self, text: str) -> list[float] | None:
        """Log-likelihood ratio per chain, and of LOST; None without any evidence."""
        found, seen, hits = [0.0] * (LOST + 1), [0] * (LOST + 1), []
        for m in RUN.finditer(text):
            i, j = m.span()
            if j - i > 1:
                hits += self.of_run(text[i - 1 : i] or "\n", m.group(), text[j : j + 1] or "\n")
        for k, ratio, _ in hits:
            found[k] += math.log(1 - SPOT_UTF8 + SPOT_UTF8 * math.exp(min(ratio, 200.0)))
        words = WORD.findall(text)
        swaps = [x for w in words for x in self.of_word(w)] + [x for got in self.joined(text) for x in got]
        lost = len(GONE.findall(text))
        if not hits and not swaps and not lost:
            return None
        for k, ratio, _ in swaps:
            found[k] += math.log(1 - SPOT_SINGLE + SPOT_SINGLE * math.exp(min(ratio, 200.0)))
            seen[k] += 1
        for k in range(len(UTF8_READ_AS), LOST):
            if seen[k]:
                found[k] += max(-1.5, math.log(1 - SPOT_SINGLE) * (len(words) - seen[k]))
        found[LOST] = 12.0 * lost
        return found if max(found) > 0 else None

    def repair(self, text: str, weight: np.ndarray) -> tuple[str, bool]:
        """(the text with each unit restored by the likeliest chain under the log weights, whether nothing is left to restore)."""

        def best(options: tuple[tuple[int, float, str], ...], unit: str, spot: float) -> str:
            top = max(((weight[k] + math.log(spot) + ratio, fixed) for k, ratio, fixed in options), key=lambda o: o[0], default=(-1.0, unit))
            return top[1] if top[0] > 0 else unit

        def around(m: re.Match) -> tuple[str, str, str]:
            return m.string[m.start() - 1 : m.start()] or "\n", m.group(), m.string[m.end() : m.end() + 1] or "\n"

        text = RUN.sub(lambda m: best(self.of_run(*around(m)), m.group(), SPOT_UTF8), text)
        text = JOINED.sub(lambda m: best(self.of_symbols(*around(m)), m.group(), SPOT_SINGLE), text)
        text = WORD.sub(lambda m: best(self.of_word(m.group()), m.group(), SPOT_SINGLE), text)
        left = any(weight[k] + math.log(SPOT_SINGLE) + ratio > 0 for got in self.joined(text) for k, ratio, _ in got)
        return text, not left and not plainly_garbled(text)


def _ratios(counts: dict[int, int], texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(counts)
        for batch in slices(batches, 2):
            rows = [(i, r) for i, t in enumerate(batch.column(2).to_pylist()) if t and not t.isascii() and (r := evidence.chains(t)) is not None]
            at = pa.array([i for i, _ in rows], pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array([r for _, r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, *([batch.column(2).take(at)] if texts else [])], ["id", "source", "ratios", *(["text"] if texts else [])])

    return run


def garbled(df: DataFrame, key: str, text: str, source: str, rounds: int = 5, texts: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """((doc_id, chain, clean, weight) of documents that more likely than not are garbled, the pair model).

    chain is an index of CHAINS, or LOST; clean is the posterior probability of
    no garbling; weight is, per chain, the log of its posterior or, if that is
    more, of its share in the source. With texts there is a column text too.
    Null, empty and ASCII texts are never cases; a null source is a source of
    its own; an empty table gives no rows.
    """
    counts = pair_model(df, text)
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.lower(F.trim(F.col(source))), F.lit("")).alias("source"), F.col(text).alias("text"))
    totals = rows.groupBy("source").agg(F.count("*").alias("docs"))
    schema = "id bigint, source string, ratios array<double>" + ", text string" * texts
    ratios = materialize(arrow_map(rows.where("text is not null"), _ratios(counts, texts), schema), "ratios")
    totals = materialize(totals, "sources")
    every = totals.agg(F.sum("docs")).first()[0] or 0
    shares = totals.select("source", F.array_repeat(F.lit(0.002), LOST + 1).alias("shares"))
    for _ in range(rounds):
        sums = arrow_map(ratios.join(shares, "source").select("source", "ratios", "shares"), _expected, "source string, r array<double>")
        sums = sums.select("source", F.posexplode("r").alias("k", "r")).groupBy("source", "k").agg(F.sum("r").alias("r"))
        sums = materialize(sums, "sums")  # one row per source and chain
        prior = F.array(*[F.lit(p) for p in _corpus_shares(sums.groupBy("k").agg(F.sum("r").alias("r")), every)])
        own = sums.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("k", "r"))).alias("m"))
        # a source weighs as its documents, the corpus as 200 more
        share = F.transform(prior, lambda p, k: (F.coalesce(F.try_element_at("m", k), F.lit(0.0)) + 200 * p) / (F.col("docs") + 200))
        shares = totals.join(own, "source").select("source", share.alias("shares"))
    schema = "doc_id bigint, chain int, clean double, weight array<double>" + ", text string" * texts
    found = arrow_map(ratios.join(shares, "source").select("id", "ratios", "shares", *(["text"] if texts else [])), _decided, schema)
    return found, counts


def _corpus_shares(whole: DataFrame, every: int) -> list[float]:
    """LOST + 1 numbers: the chains' shares of all documents, never quite nothing."""
    got = {r["k"]: r["r"] for r in whole.collect()}  # one row per chain
    return [max(got.get(k, 0.0) / max(every, 1), 1e-6) for k in range(LOST + 1)]


def _posterior(ratios: pa.Array, shares: pa.Array) -> np.ndarray:
    """Rows x chains: the posterior share of each chain; what is left to 1 is no garbling."""
    r = ratios.flatten().to_numpy(zero_copy_only=False).reshape(-1, LOST + 1)
    s = shares.flatten().to_numpy(zero_copy_only=False).reshape(-1, LOST + 1)
    joint = np.where(r == 0, -1e9, r + np.log(s))
    none = np.log(np.maximum(1 - s.sum(1, keepdims=True), 1e-6))
    top = np.maximum(joint.max(1, keepdims=True), none)
    e = np.exp(joint - top)
    return e / (e.sum(1, keepdims=True) + np.exp(none - top))


def _expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, ratios, shares) -> expected documents per source and chain, summed up over the partition."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        post = _posterior(b.column(1), b.column(2))
        names, at = np.unique(np.array(b.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
        for i, n in enumerate(names):
            sums[str(n)] = sums.get(str(n), 0) + post[at == i].sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["source", "r"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ratios, shares, more...) -> (doc_id, chain, clean, weight, more...) of those garbled more likely than not."""
    for b in batches:
        post = _posterior(b.column(1), b.column(2))
        keep = np.flatnonzero(post.sum(1) > 0.5)
        shares = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, LOST + 1)
        weight, at = np.log(np.maximum(post, shares))[keep], pa.array(keep)
        top = post[keep].argmax(1) if len(keep) else np.empty(0)
        columns = [b.column(0).take(at), pa.array(top, pa.int32()), pa.array(1 - post[keep].sum(1), pa.float64()), pa.array(weight.tolist(), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*columns, *(c.take(at) for c in b.columns[3:])], ["doc_id", "chain", "clean", "weight", *b.schema.names[3:]])


def _repaired(counts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(counts)
        for batch in slices(batches, 1):
            done = [evidence.repair(t, np.array(w)) for t, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([r for _, r in done], pa.bool_())], ["doc_id", "text", "recovered"])

    return run


def repairs(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(doc_id, text, recovered) of the garbled documents; recovered is false where characters stay lost or a unit garbled."""
    found, counts = garbled(df, key, text, source, texts=True)
    return arrow_map(found.select("doc_id", "text", "weight"), _repaired(counts), "doc_id bigint, text string, recovered boolean")
