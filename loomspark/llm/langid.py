"""Language of texts and of their lines, with a confidence.

Method: nearest centroid. Lines become L2-normalised TF-IDF vectors of hashed
character trigrams of any script; each language has several centroids, found
by spherical k-means; the language of the nearest one by cosine is taken, and
nothing where the cosine stays below what lines of that length reach with
their own language (codes, symbols, other languages). That least cosine is
measured on lines held out from the centroids. Garbled lines are compared in
their restored wording. In a text of several languages a line counts for
another than the main one only if all its runs of words are in it.

The languages are a parameter. Centroids and least cosines are fitted on at
most TRAIN_LINES lines of at most TRAIN_DOCS labelled documents, chosen by a
hash of the key; wrong labels among them are left out by comparing every line
with the languages' means first. Classification reads every whole text in one
map-only pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import arrow_map
from .mojibake import HARD, RUN, SINGLE, UTF8_READ_AS, swap, undo
from .words import slices

LANGUAGES = ("en", "it", "fr", "de", "es", "pt", "ru")
TRAIN_DOCS, TRAIN_LINES, CENTROIDS, DIMENSIONS, LINES_AT_ONCE = 1500, 12_000, 4, 4096, 256
MIN_WORDS, NEAR, SHARPNESS, WINDOW, CLEAR = 12, 0.03, 0.04, 8, 0.1
HELD_OUT, ENOUGH, LOW, SLACK, LENGTHS = 4, 50, 0.002, 0.8, (80, 120, 180, 300)  # every fourth line is held out; trigrams of a line
SWITCH = 0.1
_CYRILLIC = [p for p in SINGLE if p[0] in ("koi8_r", "cp1251", "cp866")]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> the letter in lower case, a blank for anything else."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(65, 0x32000):
        if (x := chr(c)).isalpha():
            out[c] = ord(x.lower()[0])
    return out


def _trigrams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all lines and the line of each; letters only, all else is a space."""
    text = " \n".join([" " + x for x in lines]) + " \n"
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.flatnonzero(code == 10)
    c = _letters()[np.minimum(code, 0x10FFFF)].astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)
    h = ((h ^ (h >> np.uint64(15))) * np.uint64(0x2C1B3C6D) >> np.uint64(7)) & np.uint64(DIMENSIONS - 1)
    sizes = np.diff(np.concatenate([[-1], ends]))
    line = np.repeat(np.arange(len(lines)), sizes)
    inside = (np.arange(len(h)) + 2 <= ends[line[: len(h)]]) & ((c[:-2] != 32) | (c[1:-1] != 32))
    return h[inside].astype(np.int64), line[: len(h)][inside]


def counts(lines: list[str]) -> np.ndarray:
    """Matrix lines x DIMENSIONS of trigram weights (root of the count)."""
    gram, line = _trigrams([x.replace("\n", " ") for x in lines])
    flat = np.bincount(line * DIMENSIONS + gram, minlength=len(lines) * DIMENSIONS)
    return np.sqrt(flat.astype(np.float32)).reshape(len(lines), DIMENSIONS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


@dataclass
class Centroids:
    idf: np.ndarray
    rows: np.ndarray  # centroids x DIMENSIONS
    owner: np.ndarray  # language index of each centroid
    floor: np.ndarray  # languages x lengths: least cosine of lines of up to each of LENGTHS, and of longer ones
    languages: tuple[str, ...] = LANGUAGES

    def cosines(self, lines: list[str]) -> np.ndarray:
        """lines x languages: the best cosine with any centroid of the language (-1 without one)."""
        return self.compared(lines)[0]

    def compared(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, the least cosine that counts for each line and language)."""
        out, least = np.full((len(lines), len(self.languages)), -1.0, dtype=np.float32), np.ones((len(lines), len(self.languages)))
        for at in range(0, len(lines), LINES_AT_ONCE):
            x = counts(lines[at : at + LINES_AT_ONCE])
            least[at : at + len(x)] = self.floor[:, np.searchsorted(LENGTHS, np.rint((x * x).sum(1)))].T
            x *= self.idf
            s = x @ self.rows.T / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
            for k in np.unique(self.owner):
                out[at : at + len(x), k] = s[:, self.owner == k].max(1)
        return out, least


def fit(lines: list[str], labels: list[int], centroids: int = CENTROIDS, languages: tuple[str, ...] = LANGUAGES) -> Centroids:
    """Centroids of labelled lines; deterministic, ties to the earlier language."""
    y = np.array(labels, dtype=np.int64)
    floor = np.ones((len(languages), len(LENGTHS) + 1))
    if not len(y):
        return Centroids(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64), floor, languages)
    x = np.concatenate([counts(lines[i : i + LINES_AT_ONCE]) for i in range(0, len(lines), LINES_AT_ONCE)])
    idf = np.log((1 + len(y)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    keep = np.ones(len(y), dtype=bool)
    present = np.unique(y)
    for _ in range(3):
        means = _unit(np.stack([x[(y == k) & keep].mean(0) if ((y == k) & keep).any() else x[y == k].mean(0) for k in present]))
        keep = present[(x @ means.T).argmax(1)] == y
    rows, owner, held = [], [], np.arange(len(y)) % HELD_OUT == HELD_OUT - 1
    for k in present:
        own = x[(y == k) & keep & ~held]
        if not len(own):
            continue
        spread = np.linspace(0, len(own) - 1, min(centroids, len(own))).astype(int)
        c = own[spread]
        for _ in range(8):
            near = (own @ c.T).argmax(1)
            c = _unit(np.stack([own[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))]))
        rows.append(c)
        owner += [k] * len(c)
    model = Centroids(idf, np.concatenate(rows or [x[:0]]).astype(np.float32), np.array(owner, dtype=np.int64), floor, languages)
    # held-out lines, whole and cut to the shortest that count
    tests = [(z, y[i]) for i in np.flatnonzero(held & keep) for z in {lines[i], " ".join(lines[i].split(None, MIN_WORDS)[:MIN_WORDS])}]
    cos = model.cosines([t for t, _ in tests])
    size = np.array([(counts([t]) ** 2).sum() for t, _ in tests]).round() if tests else np.zeros(0)
    own = cos[np.arange(len(tests)), [k for _, k in tests]] if tests else np.zeros(0)
    part, of = np.searchsorted(LENGTHS, size), np.array([k for _, k in tests])
    last = np.quantile(own, LOW) * SLACK if len(own) else 0.0
    for b in range(floor.shape[1]):
        if (part == b).sum() >= ENOUGH:
            last = np.quantile(own[part == b], LOW) * SLACK
        for k in present:  # a language with few lines of the length shares the others' least
            some = own[(part == b) & (of == k)]
            floor[k, b] = np.quantile(some, LOW) * SLACK if len(some) >= ENOUGH else last
    return model


def restored(line: str) -> str:
    """The line with plainly garbled runs restored."""

    def fix(m: re.Match) -> str:
        if HARD[m.group()]:
            for w in UTF8_READ_AS[:7]:
                if (done := undo(m.group(), w)) is not None:
                    return done
        return m.group()

    return RUN.sub(fix, line)


def classify(model: Centroids, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(language index or -1, cosines) of each line."""
    lines = [x if x.isascii() else restored(x) for x in lines]
    cos, least = model.compared(lines)
    best = cos.argmax(1) if len(lines) else np.empty(0, dtype=np.int64)
    every = np.arange(len(lines))
    rejected = cos[every, best] < least[every, best]
    for i in np.flatnonzero(rejected):
        if not lines[i].isascii():
            options = [o for a, b in _CYRILLIC if (o := swap(lines[i], a, b)) is not None]
            if options:
                c, enough = model.compared(options)
                at = int(c.max(1).argmax())
                k = int(c[at].argmax())
                if c[at, k] >= enough[at, k]:
                    cos[i], best[i], rejected[i] = c[at], k, False
    return np.where(rejected, -1, best), cos


def partly(model: Centroids, line: str, label: int, other: int) -> bool:
    """Whether some run of WINDOW words of the line is clearly in the other language."""
    w = restored(line).split()
    c = model.cosines([" ".join(w[i : i + WINDOW]) for i in range(0, max(1, len(w) - WINDOW + 1), WINDOW // 2)])
    return bool((c[:, other] - c[:, label]).max() > CLEAR)


def _lines(model: Centroids, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            lines, numbers, ends = [], [], [0]
            for text in batch.column(1).to_pylist():
                for number, line in enumerate(text.split("\n") if text else (), 1):
                    if len(line.split(None, min_words)) >= min_words:
                        lines.append(line)
                        numbers.append(number)
                ends.append(len(lines))
            label, cos = classify(model, lines)
            chars = np.array([len(x) for x in lines], dtype=np.int64)
            for a, b in zip(ends[:-1], ends[1:]):  # a line that could as well be in the text's main language is
                own = label[a:b]
                if len(np.unique(own[own >= 0])) > 1:
                    main = int(np.bincount(own[own >= 0], weights=chars[a:b][own >= 0]).argmax())
                    close = (own >= 0) & (cos[a:b, main] > cos[np.arange(a, b), np.maximum(own, 0)] - NEAR)
                    label[a:b] = np.where(close, main, own)
                    for i in range(a, b):  # nor is a line that is partly in the main language wholly in another
                        if label[i] >= 0 and label[i] != main and partly(model, lines[i], int(label[i]), main):
                            label[i] = -1
            e = np.exp((cos - cos.max(1, keepdims=True)) / SHARPNESS) if len(lines) else cos
            sure = e[np.arange(len(lines)), np.maximum(label, 0)] / e.sum(1) if len(lines) else np.empty(0)
            names = pa.DictionaryArray.from_arrays(pa.array(label, mask=label < 0), pa.array(model.languages)).cast(pa.string())
            offsets = pa.array(ends, pa.int32())
            wrap = lambda v: pa.ListArray.from_arrays(offsets, v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), wrap(pa.array(numbers, pa.int32())), wrap(names), wrap(pa.array(sure, pa.float64())), wrap(pa.array(chars, pa.int32()))],
                ["doc_id", "line_no", "langs", "sure", "chars"],
            )

    return run


def settled(own: np.ndarray, cos: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Language of each line of a text by the best sum of weighted cosines, less SWITCH for each change; own >= 0 stays."""
    score = cos * weight[:, None]
    score[own >= 0] = -np.inf
    score[own >= 0, own[own >= 0]] = 0.0
    best, came = score[0], np.zeros(score.shape, dtype=np.int64)
    for i in range(1, len(score)):
        top = int(best.argmax())
        stay = best >= best[top] - SWITCH
        came[i] = np.where(stay, np.arange(len(best)), top)
        best = np.where(stay, best, best[top] - SWITCH) + score[i]
    out = np.empty(len(score), dtype=np.int64)
    out[-1] = best.argmax()
    for i in range(len(score) - 1, 0, -1):
        out[i - 1] = came[i, out[i]]
    return out


def _every_line(model: Centroids):
    """As _lines, with a row for each line that is not blank: lines of few words, and those partly in another language, by joint cosine with their neighbours."""
    long_lines = _lines(model, MIN_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            known = [dict(zip(n, g)) for out in long_lines(iter([batch])) for n, g in zip(out.column(1).to_pylist(), out.column(2).to_pylist())]
            lines, numbers, ends = [], [], [0]
            for text in batch.column(1).to_pylist():
                for number, line in enumerate(text.split("\n") if text else (), 1):
                    if line.strip():
                        lines.append(line)
                        numbers.append(number)
                ends.append(len(lines))
            alone, cos = classify(model, lines)
            words = np.array([len(x.split(None, MIN_WORDS)[:MIN_WORDS]) for x in lines], dtype=np.float64)
            weight = words / MIN_WORDS
            label = np.full(len(lines), -1)
            for a, b, fixed in zip(ends[:-1], ends[1:], known):
                own = np.array([model.languages.index(g) if (g := fixed.get(n)) else -1 for n in numbers[a:b]], dtype=np.int64)
                # a long line in no known language stays without one, as do lines without letters
                free = (own < 0) & (cos[a:b].max(1, initial=-1) > 0) & ((words[a:b] < MIN_WORDS) | (alone[a:b] >= 0))
                use = np.flatnonzero((own >= 0) | free)
                if len(use):
                    label[a + use] = settled(own[use], cos[a + use], weight[a + use])
            e = np.exp((cos - cos.max(1, keepdims=True)) * weight[:, None] / SHARPNESS) if len(lines) else cos
            sure = e[np.arange(len(lines)), np.maximum(label, 0)] / e.sum(1) if len(lines) else np.empty(0)
            names = pa.DictionaryArray.from_arrays(pa.array(label, mask=label < 0), pa.array(model.languages)).cast(pa.string())
            offsets = pa.array(ends, pa.int32())
            wrap = lambda v: pa.ListArray.from_arrays(offsets, v)
            chars = pa.array([len(x) for x in lines], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), wrap(pa.array(numbers, pa.int32())), wrap(names), wrap(pa.array(sure, pa.float64())), wrap(chars)],
                ["doc_id", "line_no", "langs", "sure", "chars"],
            )

    return run


def label_language(lang: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """The language a label names, alone or with a region; null for any other label."""
    return F.nullif(F.regexp_extract(F.lower(lang), f"^({'|'.join(languages)})(?:[-_][a-z0-9]+)?$", 1), F.lit(""))


def train(df: DataFrame, key: str, text: str, lang: str, docs: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES, min_words: int = MIN_WORDS, languages: tuple[str, ...] = LANGUAGES) -> Centroids:
    """Centroids from at most ``most_lines`` lines of at most ``docs`` labelled documents of df."""
    named = df.select(F.col(key).alias("id"), label_language(F.col(lang), languages).alias("lang")).where("lang is not null and id is not null")
    chosen = named.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(docs)
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(chosen), "id")
    lines = texts.select("id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).where(F.size(F.split(F.trim("line"), r"(?U)\s+")) >= min_words)
    rows = lines.orderBy(F.xxhash64("id", "p"), "id", "p").limit(most_lines).select("line", "lang").collect()
    rows = [r for r in rows if len(r["line"].split(None, min_words)) >= min_words]
    return fit([r["line"] for r in rows], [languages.index(r["lang"]) for r in rows], languages=languages)


def line_languages(df: DataFrame, key: str, text: str, model: Centroids, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line_no[], langs[], sure[], chars[]) of each text's lines of at least min_words words; lang null where rejected."""
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, _lines(model, min_words), "doc_id bigint, line_no array<int>, langs array<string>, sure array<double>, chars array<int>")


def every_line_language(df: DataFrame, key: str, text: str, model: Centroids) -> DataFrame:
    """As line_languages, of all lines that are not blank; lang null for lines without letters and long ones in no known language."""
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, _every_line(model), "doc_id bigint, line_no array<int>, langs array<string>, sure array<double>, chars array<int>")


def document_languages(lines: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(doc_id, lang, confidence) of every text with a line: the language of most characters and its sure part of them; null and 0 without one."""
    items = F.arrays_zip("langs", "sure", "chars")
    part = lambda g: F.aggregate(F.filter(items, lambda x: x["langs"] == g), F.lit(0.0), lambda acc, x: acc + x["sure"] * x["chars"])
    best = F.array_max(F.array(*[F.struct(part(g).alias("s"), F.lit(-k).alias("k"), F.lit(g).alias("lang")) for k, g in enumerate(languages)]))
    total = F.aggregate("chars", F.lit(0.0), lambda acc, x: acc + x)
    rows = lines.where(F.size("chars") > 0).select("doc_id", best.alias("b"), total.alias("t"))
    return rows.select("doc_id", F.when(F.col("b.s") > 0, F.col("b.lang")).alias("lang"), F.round(F.col("b.s") / F.col("t"), 6).alias("confidence"))


def wrong_labels(df: DataFrame, key: str, text: str, lang: str, model: Centroids) -> DataFrame:
    """(doc_id, lang): the languages of each text that has several, or whose label is missing or another.

    Null and empty texts, and texts without a long enough line in a known
    language, give no rows; other columns of df are not read.
    """
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), label_language(F.col(lang), model.languages).alias("given"))
    return _with_given(rows, model).where((F.size("own") > 1) | F.col("given").isNull() | (F.col("given") != F.get("own", F.lit(0)))).select("doc_id", F.explode("own").alias("lang"))


def _with_given(rows: DataFrame, model: Centroids) -> DataFrame:
    run = _lines(model, MIN_WORDS)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for out in run(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2)], [*out.schema.names, "given"])

    out = arrow_map(rows, keep, "doc_id bigint, line_no array<int>, langs array<string>, sure array<double>, chars array<int>, given string")
    return out.withColumn("own", F.array_distinct(F.array_compact("langs")))


def segments(lines: DataFrame) -> DataFrame:
    """(doc_id, segment_no, first_line, last_line, lang, confidence): runs of lines in one language; shorter lines in between belong to the run."""
    items = F.filter(F.arrays_zip("line_no", "langs", "sure"), lambda x: x["langs"].isNotNull())
    start = F.array().cast("array<struct<first_line:int,last_line:int,lang:string,total:double,n:int>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.struct(x["line_no"].alias("first_line"), x["line_no"].alias("last_line"), x["langs"].alias("lang"), x["sure"].alias("total"), F.lit(1).alias("n"))
        longer = F.struct(last["first_line"].alias("first_line"), x["line_no"].alias("last_line"), last["lang"].alias("lang"), (last["total"] + x["sure"]).alias("total"), (last["n"] + 1).alias("n"))
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["lang"] == x["langs"])
        return F.when(same, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(new)))

    runs = lines.select("doc_id", F.posexplode(F.aggregate(items, start, lambda a, x: F.when(F.size(a) == 0, F.array(F.struct(x["line_no"].alias("first_line"), x["line_no"].alias("last_line"), x["langs"].alias("lang"), x["sure"].alias("total"), F.lit(1).alias("n")))).otherwise(add(a, x)))).alias("p", "r"))
    return runs.select("doc_id", (F.col("p") + 1).alias("segment_no"), "r.first_line", "r.last_line", "r.lang", F.round(F.col("r.total") / F.col("r.n"), 6).alias("confidence"))
