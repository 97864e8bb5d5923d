"""Operators of the core on small inputs with values worked out by hand."""

import json
import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomspark.functions import fields, urls
from loomspark.functions.sites import with_site
from loomspark.operators import agent, assemble, chunk, clean, dedup, entities, graph, quality, relational, retrieve
from loomspark.sources import files, schemas
from loomspark.streaming.files import assemble_stream, windowed_counts


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (fields.list_labels, "A,10;B,20;A,30;;", "A;B"),
        (fields.location_names, "1#Rome#IT;4#Paris#FR;1#Rome#IT", "Paris;Rome"),
        (fields.location_names, "no tuple", ""),
        (fields.first_number, "-1.5,2,3", -1.5),
        (fields.first_number, "x,2", None),
        (fields.theme_label, "WB_696_PUBLIC_SECTOR_MANAGEMENT", "public sector management"),
        (fields.theme_label, "TAX_FNCACT_LEADER", "leader"),
        (fields.event_root_label, "051", "engage in diplomatic cooperation"),
        (fields.event_root_label, "AbC", "abc"),
        (fields.event_root_label, "99", "99"),
        (fields.slug, "  Barack  Obama-Jr. ", "barack_obamajr"),
        (fields.slug, None, "unknown"),
        (fields.entity_name, "barack obama,1234", "barack obama"),
        (fields.entity_name, "ab", None),
        (fields.collapsed, " a \n\t b ", "a b"),
        (fields.without_fences, "```sql\nselect 1\n```", "select 1"),
        (fields.graph_statements, "MATCH (n) RETURN n; -- x; call f()", ["MATCH (n) RETURN n", "call f()"]),
        (fields.json_span, 'so {"a": {"b": 1}} there', '{"a": {"b": 1}}'),
        (fields.json_span, "none", None),
        (fields.literal_list, "['a', 'it''s', \"b\"]".replace("''", "\\'"), ["a", "it's", "b"]),
        (fields.truth, " TRUE ", True),
        (fields.truth, "yes", None),
        (fields.stored_name, "a/b", "a__b"),
        (urls.normal_key, " HTTPS://X.com/a/ ", "x.com/a"),
        (urls.scheme_stripped, " HTTPS://X.com/a/ ", " HTTPS://X.com/a/ "),
        (urls.host, "https://u:p@WWW.A.example:8080/x?y", "www.a.example"),
        (urls.host, "a.example/x", "a.example"),
        (urls.host, "A.example:443/x", "a.example"),
        (urls.host, "//a.example./x", "a.example"),
        (clean.html_main_text, "<html><head><title>T</title></head><body><nav>n</nav><p>a<p>b<script>x()</script></body>", "a b"),
        (clean.html_title, "<TITLE> T </TITLE>", "T"),
        (dedup.collapse_lines, "a\na\na\nb\n\n\na", "a\nb\n\n\na"),
    ],
)
def test_scalar(spark, f, value, want):
    assert one(spark, value, f) == want


def test_nulls_stay_null(spark):
    for f in (fields.list_labels, fields.location_names, fields.first_number, fields.theme_label, urls.normal_key, urls.host, clean.html_main_text, fields.json_span):
        assert one(spark, None, f) in (None, "")


def test_udf_functions(spark):
    df = spark.createDataFrame([("a &amp; &#233;",), (None,), ("ﬁ①",)], "c string")
    assert [r[0] for r in df.select(fields.html_text("c")).collect()] == ["a & é", None, "ﬁ①"]
    assert [r[0] for r in df.select(fields.nfkc("c")).collect()] == ["a &amp; &#233;", None, "fi1"]


def test_minutes(spark):
    got = one(spark, "x/20240101001500.export.CSV", fields.minutes_of_quarter)
    assert len(got) == 15 and got[0] == "20240101001500" and got[-1] == "20240101002900"
    assert one(spark, "20190101001500", fields.minutes_of_quarter) == []


def test_domains(spark):
    h = spark.createDataFrame([("edition.bbc.com",), ("www.bbc.com",), ("notbbc.com",)], "h string")
    got = h.select(urls.in_domains(F.col("h"), ["bbc.com"]), urls.in_domains_naive(F.col("h"), ["bbc.com"])).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, True), (False, False)]


def test_site_by_literal_and_by_join(spark, monkeypatch):
    from loomspark.functions import sites

    df = spark.createDataFrame([(1, "http://x.news.a.b/p"), (2, "http://a.b:80/"), (3, "http://ba.b/"), (4, None)], "i int, url string")
    known = spark.createDataFrame([("a.b",), ("news.a.b",), (None,)], "domain string")
    want = {1: "news.a.b", 2: "a.b", 3: None, 4: None}
    for inline in (100, 1):
        monkeypatch.setattr(sites, "INLINE_DOMAINS", inline)
        assert {r["i"]: r["site"] for r in with_site(df, F.col("url"), known).collect()} == want


def test_categories(spark):
    rules = {"first": ["AB"], "second": ["B", "C."]}
    assert one(spark, "XABX;B;;Q;<NA>", lambda c: fields.theme_categories(c, rules)) == "first; second; unclassified"
    assert one(spark, "", lambda c: fields.theme_categories(c, rules)) is None
    assert one(spark, "CX", lambda c: fields.theme_category(c, rules)) == "unclassified"


def test_middle_passage(spark):
    text = "a" * 30 + " " + "b" * 160 + ". tail" + "c" * 20
    assert one(spark, "x " * 60 + "word " * 40 + "end. rest", fields.middle_passage).endswith("end.")
    assert one(spark, text[:20], fields.middle_passage) == text[:20]


# --- duplicates and quality ---


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None), (None, 1, "z"), ("a", 1, "y")], "k string, n int, v string")
    assert {tuple(r) for r in dedup.keep_first(df, "k", "n", "v").collect()} == {("a", 1, "y"), ("b", 5, None), (None, 1, "z")}
    assert {tuple(r) for r in dedup.keep_last(df, "k", "n", "v").collect()} == {("a", 2, "x"), ("b", 5, None), (None, 1, "z")}
    assert dedup.duplicate_rows(df, "k").count() == 3


def test_profile_and_coverage(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "i int, s string")
    got = {r["column_name"]: (r["n_rows"], r["n_null"], r["n_distinct"]) for r in quality.profile(df, ["i", "s"], exact=True).collect()}
    assert got == {"i": (3, 0, 2), "s": (3, 1, 2)}
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    r = quality.coverage(keys("a", "b", "c", "c", None), keys("a", "b", "z"), keys("a"), "k").first()
    assert (r["n_expected"], r["n_seen"], r["n_usable"], r["n_missing"]) == (3, 2, 1, 1) and r["pct_usable"] == 50.0


def test_insert_absent_and_split(spark):
    target = spark.createDataFrame([(1,)], "k int")
    batch = spark.createDataFrame([(1, "x", 1), (2, "b", 2), (2, "a", 1), (None, "n", 1)], "k int, v string, o int")
    assert [tuple(r) for r in relational.insert_absent(target, batch, "k", "o").collect()] == [(2, "a", 1)]
    df = spark.range(1000)
    a = relational.seeded_part(df, "id", 0.85, "s").where("part = 'train'").count()
    assert 800 < a < 900 and a == relational.seeded_part(df.repartition(7), "id", 0.85, "s").where("part = 'train'").count()


# --- fragments ---


def test_two_fragments():
    assert assemble.join_fragments(["a b c", "c d e"], [1, 2]) == "a b c d e"
    assert assemble.join_fragments(["c d e", "a b c"], [1, 2]) == "a b c d e"
    assert assemble.join_fragments(["c d e", "a b c"], [1, 50]) == "c d e"
    assert assemble.join_fragments(["abc", "cde"], [1, 2], assemble.BY_CHAR) == "abcde"
    assert assemble.join_fragments(["abc", "cde", "ef"], [1, 1, 2], assemble.BY_CHAR_POSITIONS) == "abc"


def slow(texts, positions, how):
    """The rule word for word: every open fragment, every overlap."""
    units = [t.split() if how.by_word else t for t in texts]
    whole, used = units[0], {0}
    while True:
        best = (0, None, None)
        for i, u in enumerate(units):
            if i in used or not u:
                continue
            most = min(len(whole), len(u), how.longest_overlap or len(u))
            for behind, allowed in ((True, how.window is None or positions[i] + how.window >= positions[0]), (False, how.window is None or positions[i] - how.window <= positions[0])):
                k = next((k for k in range(most, 0, -1) if (whole[len(whole) - k :] == u[:k] if behind else whole[:k] == u[len(u) - k :])), 0) if allowed else 0
                if k > best[0]:
                    best = (k, i, behind)
        k, i, behind = best
        if not k:
            return " ".join(whole) if how.by_word else whole
        whole = whole + units[i][k:] if behind else units[i][: len(units[i]) - k] + whole
        used.add(i)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.lists(st.sampled_from("abc"), min_size=1, max_size=5)), min_size=2, max_size=8), st.booleans())
def test_joining_equals_the_slow_rule(parts, by_word):
    how = assemble.CANONICAL if by_word else assemble.Assembly(by_word=False, longest_overlap=30, window=None)
    parts = sorted(parts)
    texts = [(" " if by_word else "").join(w) for _, w in parts]
    assert assemble.join_fragments(texts, [p for p, _ in parts], how) == slow(texts, [p for p, _ in parts], how)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", max_size=40))
def test_borders(s):
    assert assemble.borders(s) == [k for k in range(len(s) - 1, 0, -1) if s[:k] == s[-k:]]


def test_self_overlap():
    assert assemble.drop_self_overlap("abcxyzabc") == "xyzabc"
    assert assemble.drop_self_overlap("ab") == "ab"
    w = " ".join(f"w{i}" for i in range(12))
    assert assemble.drop_self_overlap(f"{w} {w}", "words") == w
    s = "0123456789" * 2 + "x" * 40 + "0123456789" * 2
    assert assemble.drop_self_overlap(s, "border") == s[20:]


def test_round_trip(spark):
    r = random.Random(1)
    texts = [(i, " ".join(f"u{i}x{j}" for j in range(r.randint(1, 90)))) for i in range(12)] + [(50, ""), (51, None)]
    df = spark.createDataFrame(texts, "k bigint, t string")
    parts = assemble.shred(df, "k", "t").withColumn("date", F.lit("2024-02-03T00:00")).repartition(5)
    got = {x["k"]: (x["text"], x["date"]) for x in assemble.assemble(parts, ["k"], assemble.Assembly(window=None)).collect()}
    assert got == {i: (t, "2024-02-03") for i, t in texts if t}


def test_breadcrumb(spark):
    df = spark.createDataFrame([("Home / News", "a", "b", 3), ("Home / News", "a", "b", 30), (None, "a", None, 1)], "p string, g string, q string, n int")
    got = [r[0] for r in df.select(assemble.fragment(F.col("p"), F.col("g"), F.col("q"), F.col("n"))).collect()]
    assert got == ["News a b", "Home / News a b", " a "]


# --- chunks, cleaning, entities ---


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40))
def test_chunks_fit(text, size):
    got = chunk.chunks(text, size, size // 4)
    assert all(0 < len(c) <= size for c in got)
    assert {c for t in got for c in t} >= set(text) - set(" \n")


def test_chunk_overlap():
    assert chunk.chunks("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]


def test_site_rules(spark):
    rules = {"a.b": clean.SiteRules((r"(?im)^read more.*$", r"(?i)advert"), collapse=True), "c.d": clean.SiteRules(("x", "y"), one_pass=True)}
    df = spark.createDataFrame([("a.b", "Read More here\nAdVert t\nt\nt"), ("c.d", "xyz"), ("e.f", " kept  "), ("a.b", ""), ("a.b", None), ("c.d", "xy"), (None, "n")], "s string, t string")
    assert [tuple(r) for r in clean.clean_texts(df, "t", F.col("s"), rules).collect()] == [("a.b", "t t"), ("c.d", "z"), ("e.f", " kept  "), (None, "n")]


def test_ratio():
    assert entities.ratio("abcd", "abcd") == 100.0 and entities.ratio("", "") == 100.0 and entities.ratio("ab", "") == 0.0
    assert math.isclose(entities.ratio("kitten", "sitting"), 200 * 4 / 13)


def test_fuzzy_link_one_letter_away(spark, monkeypatch):
    """Names with a letter more or less find theirs without a comparison of pairs, the one that all pairs give."""
    r = random.Random(6)
    known = sorted({"".join(r.choices("abé", k=r.randint(2, 11))) for _ in range(150)})
    names = sorted({x for w in known for i in (0, len(w) // 2, len(w) - 1) for x in (w[:i] + w[i + 1 :], w[:i] + r.choice("abx") + w[i:]) if len(x) != 3})
    k, n = spark.createDataFrame([(w, w) for w in known], "w string, q string"), spark.createDataFrame([(x,) for x in names], "n string")

    def none(*_):
        raise AssertionError("pairs are compared")

    monkeypatch.setattr(entities, "similarity", none)
    for least in (66.0, 85.0):
        got = {x["name"]: (x["matched"], x["score"]) for x in entities.fuzzy_link(n, "n", k, "w", "q", least).collect()}
        want = {}
        for x in names:
            score, w = max(((round(entities.ratio(x, w), 6), w) for w in known), key=lambda s: (s[0], [-ord(c) for c in s[1]] + [-0x110000]))
            if x in known or len(x) >= 4 and score >= least:
                want[x] = (x, 100.0) if x in known else (w, score)
        assert got == want


def test_fuzzy_link_equals_all_pairs(spark):
    r = random.Random(2)
    known = sorted({"".join(r.choices("abcd", k=r.randint(3, 9))) for _ in range(80)})
    names = sorted({w[: i] + r.choice("abcdx") + w[i + 1 :] for w in known for i in (1, len(w) - 1)} | set(known[:5]) | {"zz"})
    k = spark.createDataFrame([(w, f"Q{i}") for i, w in enumerate(known)], "w string, q string")
    got = {x["name"]: (x["matched"], round(x["score"], 4)) for x in entities.fuzzy_link(spark.createDataFrame([(n,) for n in names] + [(None,)], "n string"), "n", k, "w", "q").collect()}
    want = {}
    for n in names:
        best = (n, 100.0) if n in known else max(((w, round(entities.ratio(n, w), 4)) for w in known), key=lambda x: (x[1], [-ord(c) for c in x[0]] + [-999]), default=None)
        if n in known or (len(n) >= 4 and best[1] >= 85):
            want[n] = best
    assert {n: s for n, (_, s) in got.items()} == {n: s for n, (_, s) in want.items()}


@pytest.mark.parametrize("block", [200_000, 1])
def test_dictionary(spark, block):
    df = spark.createDataFrame([(1, "New York and York"), (2, None), (3, "none")], "k int, t string")
    names = spark.createDataFrame([("York",), ("New York",), ("York",), (None,), ("",)], "n string")
    got = {tuple(r) for r in entities.dictionary_matches(df, "k", "t", names, "n", block).collect()}
    assert got == {(1, "York", 5), (1, "New York", 1)}
    m = entities.dictionary_matches(df, "k", "t", names, "n")
    assert entities.rich_chunks(m, "k").collect() == [(1, 2)]
    assert entities.capped_names(m, "k", 1).collect() == [(1, ["New York"])]
    assert graph.entity_pairs(entities.capped_names(m, "k", 8), "k", "names").count() == 2
    assert entities.dictionary_matches(df, "k", "t", names.limit(0), "n").count() == 0


def test_entity_pairs_of_many_names(spark):
    """All pairs of a text of 30 names, against the self-join."""
    names = [f"Name{chr(65 + i // 26)}{chr(65 + i % 26)}" for i in range(30)]
    df = spark.createDataFrame([(1, " ".join(names + names[:3])), (2, names[0]), (3, None), (4, " ".join(names[5:7]))], "k int, t string")
    m = entities.dictionary_matches(df, "k", "t", spark.createDataFrame([(n,) for n in names], "n string"), "n")
    got = [tuple(r) for r in graph.entity_pairs(entities.all_names(m, "k"), "k", "names").collect()]
    assert sorted(got) == sorted((k, a, b) for k, own in ((1, names), (4, names[5:7])) for a in own for b in own if a != b)


def test_entity_pairs_all_query_has_no_cap(spark, tmp_path):
    from loomspark.plans.textual import QUERIES

    names = [f"Town{chr(65 + i)}" for i in range(12)]
    rows = [(i, f"{n}: news", " ".join(names) if i == 0 else "none") for i, n in enumerate(names)]
    spark.createDataFrame(rows, "doc_id bigint, title string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["entity_pairs_all"](spark, str(tmp_path)).count() == 12 * 11


def test_super_edges(spark):
    rows = [("a", "b", "r", float(i % 7), f"c{i:02d}") for i in range(30)] * 2 + [("a", "b", "s", 1.0, None)]
    got = {r["relation"]: r for r in graph.super_edges(spark.createDataFrame(rows, "source_id string, target_id string, relation string, score double, chunk_id string")).collect()}
    order = [c for _, c in sorted({(-s, c) for _, _, k, s, c in rows if k == "r"})]
    assert got["r"]["chunk_ids"] == "|".join(order[:20]) and got["r"]["weight"] == 60 and got["s"]["chunk_ids"] == ""


# --- retrieval ---


@pytest.mark.parametrize("ps,kept", [([0.9, 0.8, 0.3, 0.29, 0.05], 2), ([0.9, 0.8, 0.7, 0.6, 0.35], 4), ([0.2], 0), ([0.9] * 14, 10), ([0.9, 0.3, 0.9], 1)])
def test_adaptive_cut(spark, ps, kept):
    df = spark.createDataFrame([("q", i, math.log(p / (1 - p))) for i, p in enumerate(ps, 1)], "q string, r int, s double")
    got = retrieve.adaptive_cut(df, "q", "r", "s", 10).orderBy("r").collect()
    assert [x["r"] for x in got] == list(range(1, kept + 1))


def test_bm25_and_dense(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "d")], "k int, t string")
    got = retrieve.bm25(df, "k", "t", ["A", "c"]).collect()
    assert {r["k"] for r in got} == {1, 2}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "k int, v array<float>")
    assert [(r["k"], r["score"]) for r in retrieve.dense(v, "k", "v", [2.0, 0.0]).collect()] == [(1, 1.0), (2, 0.707107)]


# --- agent ---


def test_agent_loop(spark):
    asked = []
    look = lambda q: asked.append(q) or spark.createDataFrame([(q,)], "c string")
    s = agent.answer("how many x", {"sql_db": look, "vector_db": look}, grade=lambda q, c: len(asked) > 2, rewrite=lambda q: q + "?")
    assert asked == ["how many x", "how many x?", "how many x??"] and s.rounds == 2 and s.answer == "SQL Result: how many x??"
    assert agent.route("tell me") == ["vector_db"]
    assert agent.run_sql(spark, "```sql\nselect 1 as a;\n```").first()["a"] == 1
    for bad in ("drop table x", "select 1; drop table x"):
        with pytest.raises(ValueError):
            agent.run_sql(spark, bad)


# --- files and streams ---


def test_tsv(spark, tmp_path):
    (tmp_path / "a.export.CSV").write_bytes("1\tx\té\n2\ty\n3\tz\tw\textra\n".encode("latin-1"))
    got = files.read_tsv(spark, str(tmp_path), ["a", "b", "c"], ["c", "a"], "*.export.[cC][sS][vV]").collect()
    assert [tuple(r) for r in got] == [("é", "1"), (None, "2"), ("w", "3")]
    assert [tuple(r) for r in files.read_tsv_strict(spark, str(tmp_path), ["a", "b", "c"]).collect()] == [("1", "x", "é"), ("2", "y", None)]
    assert (len(schemas.EXPORT), len(schemas.GKG), len(schemas.MENTIONS)) == (61, 27, 16)


def test_csv(spark, tmp_path):
    (tmp_path / "u16.csv").write_bytes("a,b\né,1\n".encode("utf-16"))
    assert [tuple(r) for r in files.read_csv_any_utf(spark, str(tmp_path / "u16.csv")).collect()] == [("é", "1")]
    d = tmp_path / "d"
    d.mkdir()
    (d / "1.csv").write_text("s,n\nx,1.5\ny,bad\n")
    (d / "2.csv").write_text("z,2\nw,3,over\n")
    assert {tuple(r) for r in files.read_csv_mixed(spark, str(d), ["s", "n"], ["n"]).collect()} == {("x", 1.5), ("z", 2.0)}


def test_broken_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1, "b": "}{"}, {"a": 2}, {"a": oops}, {"a": 3')
    assert [tuple(r) for r in files.read_broken_json(spark, str(tmp_path), "a int, b string").collect()] == [(1, "}{"), (2, None)]


def test_link_list_and_todo(spark, tmp_path):
    (tmp_path / "l.txt").write_text("1 h http://x\n2 h ftp://y\nshort\n")
    assert [r["url"] for r in files.link_list(spark, str(tmp_path)).collect()] == ["http://x"]
    listed = spark.createDataFrame([("a/b",), ("c/d",), ("e__f",)], "n string")
    assert [r["n"] for r in files.todo_files(listed, spark.createDataFrame([("a__b",), ("e/f",)], "n string"), "n").collect()] == ["c/d"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "t"), (2, None), (3, "")], "k int, t string")
    files.write_split(df, quality.has_text(F.col("t")), str(tmp_path / "g"), "k", str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 1 and {r[0] for r in spark.read.text(str(tmp_path / "r")).collect()} == {"2", "3"}
    files.write_parquet(df, str(tmp_path / "p"), parts=2)
    files.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 3


def gram(url, pos, pre, n, post, type=1):
    return json.dumps({"url": url, "date": "2024-01-02T00:00", "lang": "en", "type": type, "pos": pos, "pre": pre, "ngram": n, "post": post})


def test_fragment_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join([gram("u", 1, "a b", "c", "d"), gram("u", "2", "c", "d", "e f"), gram("", 1, "x", "y", "z"), "{broken", gram("v", 1, "q", "r", "s", 2)]))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    assemble_stream(spark, str(src), out, state)
    (src / "2.json").write_text(gram("u", 9, "other", "file", "text"))
    assemble_stream(spark, str(src), out, state)
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["a b c d e f", "other file text"]
    assert files.read_fragments(spark, str(src)).count() == 4


def test_windows_on_a_batch(spark):
    df = spark.sql("select * from values (timestamp'2024-01-01 00:10:00', 'a'), (timestamp'2024-01-01 00:50:00', 'a'), (timestamp'2024-01-01 01:00:00', 'a') as t(ts, k)")
    assert sorted(r["n_events"] for r in windowed_counts(df, "ts", "k").collect()) == [1, 2]


def test_listing_and_description(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "a.json").write_text("12345")
    (tmp_path / "s" / "b.json").write_text("1")
    (tmp_path / "c.txt").write_text("12345")
    assert [r["path"].split("/")[-1] for r in files.list_files(spark, str(tmp_path), "*.json", 2).collect()] == ["a.json"]
    assert files.list_files(spark, str(tmp_path), "*.json").count() == 2
    df = spark.createDataFrame([(1,)], "a int")
    assert files.describe(df) == {"columns": [("a", "int")], "rows": [{"a": 1}]}
    files.append_rows(df, str(tmp_path / "t"))
    files.append_rows(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert relational.merged(df, df, spark.createDataFrame([(2,)], "a int")).count() == 2


def test_pages_and_triples(spark):
    long = "<title>t</title><p>" + "word " * 60
    df = spark.createDataFrame([(1, long, None), (2, "<p>x", long), (3, "<p>x", "<p>y"), (4, None, None)], "k int, html string, again string")
    assert {r["k"]: r["title"] for r in clean.pages_text(df, "k", "html", F.col("again")).collect()} == {1: "t", 2: "t"}
    assert [r["k"] for r in clean.pages_text(df, "k", "html").collect()] == [1]
    t = spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), (" ", "r", "b"), ("a", "q", "b"), ("a", "r", None)], "subject string, relation string, object string")
    assert graph.valid_triples(t, ["r"]).collect() == [("a", "r", "b")]


# --- guards, readers and sinks ---


@pytest.mark.parametrize(
    "sql",
    [
        "with t as (select 1 as a) insert into x select * from t",
        "from (select 1 as a) insert into x select a insert into y select a",
        "insert overwrite x select 1",
        "create table x as select 1",
        "select transform(a) using 'cat' from (select 'b' as a)",
        "select java_method('java.lang.System', 'getProperty', 'user.home')",
        "select 1; select 2",
        "set a = 1",
        "not sql at all",
    ],
)
def test_only_queries_are_run(spark, sql):
    from loomspark.operators.agent import run_sql

    with pytest.raises(ValueError):
        run_sql(spark, sql)


def test_queries_are_run(spark):
    from loomspark.operators.agent import run_sql

    assert run_sql(spark, "```sql\nwith t as (select 1 as a union select 2) select count(*) as n from t where a in (select 1);\n```").collect() == [(1,)]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from loomspark.session import shared_folder

    none = SimpleNamespace(isDefined=lambda: False)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none))
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(_jsc=jsc, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_folder(cluster)


def test_literal_lists_of_any_quotes(spark):
    from loomspark.functions.fields import literal_list

    cases = [("""['one, two', 'say "hi"', "it's"]""", ["one, two", 'say "hi"', "it's"]), ("[]", []), ("nan", None), ("['a'", None), (None, None), ("__import__('os')", None)]
    df = spark.createDataFrame([(a,) for a, _ in cases], "t string")
    assert [r["x"] for r in df.select(literal_list("t").alias("x")).collect()] == [b for _, b in cases]


def test_copy_tsv_round_trip(spark, tmp_path):
    from loomspark.sources.files import read_copy_tsv, write_copy_tsv

    rows = [(1, "a\tb\\nc\nd\r"), (2, None), (3, ""), (4, "\\N"), (5, "\\\\t\\t")]
    write_copy_tsv(spark.createDataFrame(rows, "k int, t string"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in read_copy_tsv(spark, str(tmp_path / "c"), "k int, t string").collect()) == rows


def test_report_has_a_sheet_per_result(spark, tmp_path):
    import zipfile
    from xml.dom.minidom import parseString

    from loomspark.sources.files import write_report

    df = spark.createDataFrame([(1, "a & <b>"), (2, None)], "n int, t string")
    path = str(tmp_path / "r.xlsx")
    write_report({"one": df, "two": df.limit(0), "three": df, "four": df}, path)
    with zipfile.ZipFile(path) as z:
        assert sum(n.startswith("xl/worksheets/") for n in z.namelist()) == 4
        sheet = parseString(z.read("xl/worksheets/sheet1.xml"))
        assert [t.firstChild.data for t in sheet.getElementsByTagName("t")] == ["n", "t", "a & <b>"] and len(sheet.getElementsByTagName("row")) == 3
    with pytest.raises(ValueError):
        write_report({"one": df}, path, most=1)


def test_equal_lines_are_folded(spark):
    from loomspark.operators.dedup import collapse_lines

    cases = [("a\na\n\n\nb\na", "a\n\n\nb\na"), ("", ""), ("a\na\na", "a"), (None, None), ("a", "a")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "t string")
    assert [r["x"] for r in df.select(collapse_lines(F.col("t")).alias("x")).collect()] == [b for _, b in cases]


def test_a_service_answers(spark):
    import json
    import threading
    import urllib.error
    import urllib.request

    from loomspark.operators.agent import answer, service

    server = service(lambda q: answer(q, {"vector_db": lambda _: spark.createDataFrame([("found",)], "t string")}))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"http://127.0.0.1:{server.server_port}/ask"
    try:
        got = json.load(urllib.request.urlopen(urllib.request.Request(address, b'{"question": "what is it"}'), timeout=60))
        assert got["answer"] == "found" and got["stores"] == ["vector_db"]
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(urllib.request.Request(address, b"{}"), timeout=60)
    finally:
        server.shutdown()
        server.server_close()


def test_relations_are_classified(spark):
    import random

    from loomspark.operators.relations import classify_relations, train_relations

    r = random.Random(4)
    words = {"owns": ["bought", "holds", "shares"], "attacks": ["struck", "shelled", "raided"], "meets": ["talked", "visited", "hosted"]}
    rows = [(i, f"subject a{r.randrange(50)} object b{r.randrange(50)} text they {r.choice(words[k])} it {r.randrange(9)}", k) for i in range(300) for k in [r.choice(sorted(words))]]
    df = spark.createDataFrame(rows, "id int, text string, relation string")
    model = train_relations(df.where("id % 5 > 0"), "text", "relation")
    got = {x["id"]: x["relation"] for x in classify_relations(model, df.where("id % 5 = 0"), "id", "text").collect()}
    assert len(got) > 50 and sum(got[i] == k for i, _, k in rows if i in got) >= 0.95 * len(got)


def test_catalogue_lists_columns(spark):
    from loomspark.sources.files import catalogue

    spark.createDataFrame([(1, "a")], "k int, t string").createOrReplaceTempView("shown")
    try:
        got = [tuple(r) for r in catalogue(spark).where("table_name = 'shown'").orderBy("position").collect()]
        assert got == [("shown", 1, "k", "int"), ("shown", 2, "t", "string")]
    finally:
        spark.catalog.dropTempView("shown")


def test_hot_edges_keep_their_best_chunks(spark):
    from loomspark.operators.graph import super_edges

    rows = [("s", "t", "r", i / 1000, f"c{i:04d}") for i in range(500)] + [("s", "t", "r", 0.9, None), ("s", None, "r", 0.1, "x")]
    got = {r["target_id"]: r for r in super_edges(spark.createDataFrame(rows, "source_id string, target_id string, relation string, score double, chunk_id string")).collect()}
    assert got["t"]["weight"] == 500 and got["t"]["max_score"] == 0.9 and got["t"]["chunk_ids"].split("|") == [f"c{i:04d}" for i in range(499, 479, -1)]
    assert got[None]["chunk_ids"] == "x"
