"""Dictionary and fuzzy entity matching."""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from ..session import arrow_map, materialize


def ratio(a: str, b: str) -> float:
    """Indel similarity in percent: 200 * LCS / (len a + len b), by a bit-parallel LCS."""
    if not a and not b:
        return 100.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = row & at.get(c, 0)
        row = ((row + m) | (row - m)) & full
    common = len(a) - bin(row).count("1")
    return 200.0 * common / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)])


def _one_letter(names: DataFrame, known: DataFrame, longer: bool, least: float) -> DataFrame:
    """(name, matched, score): the first of known(matched) that has one letter more, or less, if any, of names of three letters or more.

    One letter more is the best there is. At two edits or more the score is
    100 * (1 - 1 / (length + 1)) at most, which is less than that of one less.
    """
    long, short = ("matched", "name") if longer else ("name", "matched")
    rows = {"name": names.select("name").where(F.length("name") >= 3), "matched": known.select("matched").where(F.length("matched") >= 2)}
    # the words without one of their letters each
    left = F.transform(F.sequence(F.lit(1), F.length(long)), lambda i: F.concat(F.substr(F.col(long), F.lit(1), i - 1), F.substr(F.col(long), i + 1)))
    hashes = F.explode(F.array_distinct(F.transform(left, lambda x: F.xxhash64(x)))).alias("h")
    pairs = rows[long].select(long, hashes).join(rows[short].select(short, F.xxhash64(short).alias("h")), "h").where(F.array_contains(left, F.col(short)))
    score = F.round(200.0 * F.length(short) / (F.length("name") + F.length("matched")), 6)
    return pairs.select("name", "matched", score.alias("score")).where(F.col("score") >= least).groupBy("name").agg(F.min("matched").alias("matched"), F.max("score").alias("score"))


def fuzzy_link(names: DataFrame, name: str, known: DataFrame, known_name: str, known_id: str, least: float = 85.0, shortest: int = 4) -> DataFrame:
    """(name, id, matched, score): exact lower-case hit, else the most similar known name of at least ``least``; ties to the first name.

    Names that are a known one but for a letter more or less meet it by the
    hashes of what is left without each of their letters: nothing else is as
    similar, so only names without such a match look further. Candidates of
    those share one of the name's rarest two-letter pieces, as many as the
    bound needs, fit in length and share enough pieces in all before they are
    compared; names under ``shortest`` characters
    only match exactly.
    """
    n = names.select(F.lower(name).alias("name")).where("name is not null").distinct()
    k = known.select(F.lower(known_name).alias("matched"), F.col(known_id).alias("id")).where("matched is not null").groupBy("matched").agg(F.min("id").alias("id"))
    k = materialize(k, "known")
    exact = n.join(k, F.col("name") == F.col("matched")).select("name", "id", "matched", F.lit(100.0).alias("score"))
    rest = materialize(n.join(k, F.col("name") == F.col("matched"), "left_anti").where(F.length("name") >= shortest), "names")
    linked = exact
    for longer in (True, False):
        close = materialize(_one_letter(rest, k, longer, least), "close")
        linked, rest = linked.unionByName(close.join(k, "matched").select("name", "id", "matched", "score")), rest.join(close, "name", "left_anti")
        if rest.isEmpty():
            return linked
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(2))))
    b = k.select("matched", "id", grams("matched").alias("gb")).select("matched", "id", "gb", F.explode("gb").alias("g"))
    often = b.groupBy("g").agg(F.count("*").alias("df"))  # two-letter pieces: a small table
    own = rest.select("name", grams("name").alias("ga"))
    pieces = own.select("name", "ga", F.explode("ga").alias("g")).join(often, "g").groupBy("name").agg(F.first("ga").alias("ga"), F.sort_array(F.collect_list(F.struct("df", "g"))).alias("l"))
    la, lb = F.length("name"), F.length("matched")
    # edits allowed by the bound; each costs the name two pieces at most, so one of its rarest pieces is in any match
    edits = lambda longest: F.floor((1 - least / 100.0) * longest)
    needed = 2 * edits(la * (1 + (200.0 - least) / least)) + 1 - (F.size("ga") - F.size("l"))
    a = pieces.where(needed > 0).select("name", "ga", F.explode(F.slice("l", F.lit(1), F.least(needed, F.size("l")).cast("int"))["g"]).alias("g"))
    near = 200.0 * F.least(la, lb) / (la + lb) >= least
    shared = F.size(F.array_intersect("ga", "gb")) >= F.greatest(F.lit(1), F.size("ga") - 2 * edits(la + lb))
    pairs = a.join(b, "g").where(near & shared).select("name", "matched", "id").distinct()
    pairs = pairs.withColumn("score", F.round(similarity("name", "matched"), 6)).where(F.col("score") >= least)
    best = pairs.groupBy("name").agg(F.min_by(F.struct("id", "matched", "score"), F.struct((-F.col("score")).alias("s"), "matched")).alias("b"))
    return linked.unionByName(best.select("name", "b.id", "b.matched", "b.score"))


_MACHINES: dict[str, object] = {}  # of this worker


def _machine(name: str, shared: Broadcast):
    if name not in _MACHINES:
        if len(_MACHINES) > 1:
            _MACHINES.clear()
        _MACHINES[name] = pickle.loads(shared.value)
    return _MACHINES[name]


def dictionary_matches(df: DataFrame, key: str, text: str, names: DataFrame, name: str, most_chars: int = 8_000_000) -> DataFrame:
    """(key, name, at): every dictionary name inside each text, case-sensitive and without word borders; at counts from 1, first place.

    The automaton is built once, on the driver, and loaded once per worker. The
    dictionary's characters are counted first; one of more than ``most_chars``
    goes out in parts, each an automaton that reads every text once.
    """
    import ahocorasick

    distinct = names.select(F.col(name).alias("n")).where("n is not null and n <> ''").distinct()
    parts = max(1, math.ceil((distinct.agg(F.sum(F.length("n"))).first()[0] or 0) / most_chars))
    kind, out = dict(df.dtypes)[key], None
    for p in range(parts):
        machine, words = ahocorasick.Automaton(), 0
        for r in distinct.where(F.pmod(F.xxhash64("n"), F.lit(parts)) == p).toLocalIterator():
            machine.add_word(r["n"], r["n"])
            words += 1
        machine.make_automaton()
        shared, called = df.sparkSession.sparkContext.broadcast(pickle.dumps(machine)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared, called: str = called, words: int = words) -> Iterator[pa.RecordBatch]:
            machine = _machine(called, shared)
            for b in batches:
                rows = []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    seen: dict[str, int] = {}
                    for end, w in machine.iter(t) if t and words else ():
                        seen.setdefault(w, end - len(w) + 2)
                    rows += [(k, w, at) for w, at in seen.items()]
                ks, ws, ats = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ks, b.column(0).type), pa.array(ws, pa.string()), pa.array(ats, pa.int32())], [key, "name", "at"])

        found = arrow_map(df.select(key, text), run, f"{key} {kind}, name string, at int")
        out = found if out is None else out.unionByName(found)
    return out


def rich_chunks(matches: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, n_names) of chunks with at least ``least`` different names."""
    return matches.groupBy(key).agg(F.count_distinct("name").alias("n_names")).where(F.col("n_names") >= least)


def capped_names(matches: DataFrame, key: str, most: int = 6) -> DataFrame:
    """(key, names): the first names in text order, at most ``most``."""
    order = F.array_sort(F.collect_list(F.struct("at", "name")))
    return matches.groupBy(key).agg(F.slice(F.transform(order, lambda x: x["name"]), 1, most).alias("names"))


def all_names(matches: DataFrame, key: str) -> DataFrame:
    """(key, names): the different names, in no order."""
    return matches.groupBy(key).agg(F.collect_set("name").alias("names"))
