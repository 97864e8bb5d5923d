"""Packed fields and orphan references."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomspark.functions.urls import normal_key
from loomspark.operators.orphans import month_of, orphan_references, orphan_report, parents, references
from loomspark.operators.packed import Packed, unpack
from loomspark.plans.core_problems import FIELDS

CASES = [
    ("allnames", 'a b,12;c,7|"d; e",3\tf', ["a b", "c", "d; e", "f"]),
    ("allnames", '"the ""x"" y" ; z, w', ['the "x" y', "z, w"]),
    ("allnames", ";; a ;; a ;", ["a", "a"]),
    ("allnames", '"";" ";b', ["b"]),
    ("allnames", 'open "quote; runs on', ['open "quote; runs on']),
    ("allnames", '"x"";y"', ['x";y']),
    ("allnames", "nan", []),
    ("allnames", " None ", []),
    ("allnames", "<NA>", []),
    ("allnames", "nan;x", ["nan", "x"]),
    ("allnames", None, []),
    ("allnames", "", []),
    ("allnames", " \t ", []),
    ("enhancedthemes", '"ECO_A",190|GOV_B_31,5', ["ECO_A", "GOV_B_31"]),
    ("locations", "1#Rome#IT;4#Paris, Texas#FR|x, y", ["Rome", "Paris, Texas", "x, y"]),
    ("locations", '5#"a; b, c"#XC#1;d,204', ["a; b, c", "d,204"]),
    ("locations", "##;#", []),
    ("gcam", 'wc:1,"c2:3",v1:2;"a,b"', ["wc:1", "c2:3", "v1:2", "a,b"]),
]


def test_cases(spark):
    rows = [(i, *[v if f == g else None for g in FIELDS], "k", 1) for i, (f, v, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "gkgrecordid int, " + ", ".join(f"{f} string" for f in FIELDS) + ", item string, pos int")
    got = {}
    for r in unpack(df, "gkgrecordid", FIELDS).collect():
        got.setdefault(r["gkgrecordid"], {})[r["pos"]] = r["item"]
    for i, (f, v, want) in enumerate(CASES):
        assert got.get(i, {}) == dict(enumerate(want, 1)), (f, v)


def test_long_repeated_and_empty(spark):
    df = spark.createDataFrame([("a", ";".join(["v"] * 20_000)), ("a", "v"), ("a", "v"), (None, "w")], "k string, f string")
    out = unpack(df, "k", {"f": Packed()})
    assert out.where("k = 'a'").count() == 20_002 and out.distinct().where("k = 'a'").count() == 20_000
    assert out.where("k is null").count() == 1
    assert unpack(df.limit(0), "k", {"f": Packed()}).count() == 0
    assert dict(out.dtypes)["pos"] == "bigint"


def fold(s):
    """A reader, character by character."""
    out, cur, quoted = [], "", False
    for c in s:
        if c == '"':
            quoted = not quoted
        if c in ";|\t" and not quoted:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]


def test_fold_equals_a_reader(spark):
    from loomspark.operators.packed import fold_values

    r = random.Random(3)
    texts = ["".join(r.choices('ab;|\t", ', k=r.randint(0, 25))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {x["i"]: x["v"] for x in df.select("i", fold_values(F.col("s"), r";|\t").alias("v")).collect()}
    assert all(got[i] == fold(t) for i, t in enumerate(texts))


T = lambda h: dt.datetime(2024, 5, 1, h)


def by_hand(refs, rows, gone):
    out = set()
    for i, t, k, at in refs:
        if k is None:
            continue
        own = [a for tt, kk, a in rows if (tt, kk) == (t, k)]
        dated = [a for a in own if a is not None]
        if not own:
            reason = "deleted" if (t, k) in gone else "missing"
        elif at is not None and dated and min(dated) > at:
            reason = "late"
        else:
            continue
        out.add((i, t, reason, at.strftime("%Y-%m") if at else "unknown"))
    return out


@pytest.mark.parametrize("group_rows", [200_000, 25])
def test_orphans_match_brute_force(spark, group_rows):
    r = random.Random(7)
    keys = [f"k{i}" for i in range(40)]
    rows = [(t, r.choice(keys[:25]), r.choice([None, T(3), T(6), T(9)])) for t in ("event", "article") for _ in range(40)]
    rows += rows[:5]
    gone = {(r.choice(["event", "article"]), r.choice(keys)) for _ in range(15)}
    refs = [(i, r.choice(["event", "article"]), None if i % 11 == 0 else ("k1" if i % 3 else r.choice(keys)), r.choice([None, T(2), T(5), T(8)])) for i in range(300)]
    parent = spark.createDataFrame([(*x, "ts", 1) for x in rows], "ref_table string, key string, at timestamp, h1 string, place int")
    every = None
    for t in ("event", "article"):
        p = parents(t, parent.where(F.col("ref_table") == t), F.col("key"), F.col("at"))
        g = parents(t, spark.createDataFrame([k for k in gone if k[0] == t] or [(t, None)], "ref_table string, key string"), F.col("key"))
        every = p.unionByName(g) if every is None else every.unionByName(p).unionByName(g)
    found = None
    for t in ("event", "article"):
        df = spark.createDataFrame([x for x in refs if x[1] == t], "ref_id bigint, t string, key string, at timestamp")
        one = references(df, "ref_id", {t: F.col("key")}, F.col("at"))
        found = one if found is None else found.unionByName(one)
    cases = orphan_references(found, every, 10, group_rows)
    got = [tuple(x) for x in cases.collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(refs, rows, gone)
    assert sum(x["n_refs"] for x in orphan_report(cases).collect()) == len(got)


def test_orphans_of_nothing(spark):
    none = spark.createDataFrame([], "ref_table string, key string, added bigint, there boolean")
    refs = spark.createDataFrame([(1, "event", "a", None, "unknown")], "ref_id bigint, ref_table string, key string, at bigint, period string")
    assert [tuple(x) for x in orphan_references(refs, none).collect()] == [(1, "event", "missing", "unknown")]
    assert orphan_references(refs.limit(0), none).count() == 0


def test_month_ignores_the_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 30),), (None,)], "t timestamp")
    spark.conf.set("spark.sql.session.timeZone", "America/Lima")
    try:
        moved = spark.sql("select timestamp'2024-01-01 00:30:00Z' as t").select(month_of(F.col("t")).alias("m")).first()["m"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert moved == "2024-01"
    assert [r["m"] for r in df.select(month_of(F.col("t")).alias("m")).collect()] == ["2024-01", "unknown"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="hHtpsS:/xX. ", max_size=14), min_size=1, max_size=5))
def test_normal_key(spark, keys):
    def want(k):
        k = k.lower().strip()
        k = k.removeprefix("http://") if k.startswith("http://") else k.removeprefix("https://")
        return k.removesuffix("/")

    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(normal_key(F.col("k"))).collect()] == [want(k) for k in keys]
