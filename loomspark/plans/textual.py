"""Field, URL and text queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fields, urls
from ..operators import assemble, chunk, clean, entities, retrieve
from ..operators.dedup import collapse_lines
from ..session import delete_on_exit, shared_folder
from ..sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


DOMAINS = ["harborledger.example", "ledger.example", "elbkurier.test", "news.millbrook.example", "vestnikzarechya.example"]
_LIST = "[" + ", ".join(f"'{x}'" for x in DOMAINS) + "]"
_NETLOC = r"regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)"
_HOST = rf"lower(regexp_replace({_NETLOC}, ':\d*$', ''))"


def _urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "url").where("url is not null")


@query("select doc_id, regexp_replace(regexp_replace(trim(lower(url)), '^https?://', ''), '/$', '') as k from documents where url is not null")
def url_normalize_key(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("doc_id", urls.normal_key(F.col("url")).alias("k"))


@query("select doc_id, replace(replace(url, 'https://', ''), 'http://', '') as k from documents where url is not null")
def url_scheme_stripped(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("doc_id", urls.scheme_stripped(F.col("url")).alias("k"))


@query(f"select doc_id, {_NETLOC} as netloc from documents where url is not null")
def url_netloc(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("doc_id", urls.netloc(F.col("url")).alias("netloc"))


@query(f"select host, count(*) as n from (select case when {_HOST} = '' then 'unknown' else regexp_replace({_HOST}, '^www\\.', '') end as host from documents where url is not null) group by 1")
def host_counts(spark: SparkSession, d: str) -> DataFrame:
    h = F.coalesce(F.nullif(F.regexp_replace(urls.host(F.col("url")), r"^www\.", ""), F.lit("")), F.lit("unknown"))
    return _urls(spark, d).groupBy(h.alias("host")).agg(F.count("*").alias("n"))


_IN = f"len(list_filter({_LIST}, lambda x: {_HOST} = x or ends_with({_HOST}, '.' || x))) > 0"
_NAIVE = f"list_contains({_LIST}, replace({_HOST}, 'www.', ''))"


@query(f"select doc_id from documents where url is not null and {_IN}")
def domain_allowlist(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).where(urls.in_domains(urls.host(F.col("url")), DOMAINS)).select("doc_id")


@query(f"select doc_id from documents where url is not null and {_IN} and not {_NAIVE}")
def domain_delta(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the right rule keeps and the naive one loses."""
    h = urls.host(F.col("url"))
    return _urls(spark, d).where(urls.in_domains(h, DOMAINS) & ~urls.in_domains_naive(h, DOMAINS)).select("doc_id")


_ALTERNATION = "|".join(x.replace(".", r"\.") for x in DOMAINS)


@query(rf"select doc_id from documents where regexp_matches(url, '(?i)https?://(?:[^\./]+\.)*?(?:{_ALTERNATION})(?:/|$)')")
def domain_regex(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).where(F.col("url").rlike(rf"(?i)https?://(?:[^\./]+\.)*?(?:{_ALTERNATION})(?:/|$)")).select("doc_id")


_BARE = [x.replace(".", "") for x in DOMAINS]
_DOTLESS = "[" + ", ".join(f"'{x}'" for x in _BARE) + "]"


@query(f"select doc_id from documents where url is not null and len(list_filter({_DOTLESS}, lambda x: contains(replace({_HOST}, '.', ''), x))) > 0")
def domain_dotless(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that hold a listed domain when dots do not count: the loosest rule."""
    h = F.replace(urls.host(F.col("url")), F.lit("."), F.lit(""))
    return _urls(spark, d).where(reduce(lambda a, b: a | b, [F.contains(h, F.lit(x)) for x in _BARE])).select("doc_id")


@query("select doc_id, case " + " ".join(f"when contains(lower(url), '{x}') then '{x}'" for x in DOMAINS) + " else '(other)' end as domain from documents where url is not null")
def domain_contains(spark: SparkSession, d: str) -> DataFrame:
    """First listed domain that occurs anywhere in the URL."""
    u = F.lower("url")
    return _urls(spark, d).select("doc_id", F.coalesce(*[F.when(F.contains(u, F.lit(x)), F.lit(x)) for x in DOMAINS], F.lit("(other)")).alias("domain"))


@query(f"select doc_id, list_reduce(list_filter((select list(domain) from news_site), lambda x: {_HOST} = x or ends_with({_HOST}, '.' || x)), lambda a, b: case when length(b) > length(a) then b else a end) as site from documents where url is not null and len(list_filter((select list(domain) from news_site), lambda x: {_HOST} = x or ends_with({_HOST}, '.' || x))) > 0")
def site_of_url(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.sites import with_site

    return with_site(_urls(spark, d), F.col("url"), table(spark, d, "news_site", "domain")).where("site is not null").select("doc_id", "site")


@query("""select gkgrecordid, docidentifier_normalized as k, array_to_string(list_filter(list_transform(list_filter(string_split(allnames, ';'), lambda x: x <> ''), lambda x: split_part(x, ',', 1)), lambda x, i: x <> '' and
    list_position(list_transform(list_filter(string_split(allnames, ';'), lambda y: y <> ''), lambda y: split_part(y, ',', 1)), x) = i), ';') as names from gdelt_article where allnames is not null""")
def list_labels(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "gdelt_article", "gkgrecordid", "docidentifier_normalized", "allnames").where("allnames is not null")
    return a.select("gkgrecordid", F.col("docidentifier_normalized").alias("k"), fields.list_labels(F.col("allnames")).alias("names"))


@query("select gkgrecordid, docidentifier_normalized as k, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(locations, ';'), lambda x: split_part(x, '#', 2)), lambda x: x <> ''))), ';') as places from gdelt_article where locations is not null")
def location_names(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "gdelt_article", "gkgrecordid", "docidentifier_normalized", "locations").where("locations is not null")
    return a.select("gkgrecordid", F.col("docidentifier_normalized").alias("k"), fields.location_names(F.col("locations")).alias("places"))


@query("select globaleventid, actors, count(*) as n from (select globaleventid, nullif(array_to_string(list_sort(list_distinct(list_filter([actor1name, actor2name], lambda x: x is not null and x <> ''))), ';'), '') as actors from gdelt_event) group by all")
def merged_actors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "gdelt_event", "globaleventid", "actor1name", "actor2name")
    return e.groupBy("globaleventid", fields.merged_names(F.col("actor1name"), F.col("actor2name")).alias("actors")).agg(F.count("*").alias("n"))


@query("select theme, count(*) as n from (select trim(unnest(string_split(enhancedthemes, ';'))) as theme from gdelt_article where enhancedthemes is not null) where theme <> '' group by 1")
def unnest_group_count(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "gdelt_article", "enhancedthemes").select(F.explode(F.split("enhancedthemes", ";")).alias("t"))
    return a.select(F.trim("t").alias("theme")).where("theme <> ''").groupBy("theme").agg(F.count("*").alias("n"))


# rules are a parameter of the operator; these fit the themes of the test tables
RULES = {
    "economy": ["ECO_", "BUDGET", "PRICES", "TARIFF", "TRADE"],
    "politics": ["GOV_", "ELECTION", "LEADER", "POLICY", "TAX"],
    "law": ["LAW_", "COURT", "DISPUTE", "AUDIT"],
    "environment": ["ENV_", "FOREST", "DROUGHT", "WX_"],
}
_SQL_CAT = "case " + " ".join("when " + " or ".join(f"contains(x, '{k}')" for k in ws) + f" then '{c}'" for c, ws in RULES.items()) + " else 'unclassified' end"
_SQL_LABEL = r"lower(trim(replace(regexp_replace(regexp_replace(x, '" + fields.THEME_PREFIX + r"', ''), '^[0-9A-Z]+_\d+_', ''), '_', ' ')))"
_CODES = "list_filter(string_split(enhancedthemes, ';'), lambda x: x <> '' and x <> '<NA>')"


@query(f"select gkgrecordid, docidentifier_normalized as k, array_to_string(list_transform({_CODES}, lambda x: {_SQL_LABEL}), '; ') as labels, array_to_string(list_sort(list_distinct(list_transform({_CODES}, lambda x: {_SQL_CAT}))), '; ') as categories from gdelt_article where enhancedthemes <> ''")
def theme_clean_categorize(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "gdelt_article", "gkgrecordid", "docidentifier_normalized", "enhancedthemes").where("enhancedthemes <> ''")
    t = F.col("enhancedthemes")
    return a.select("gkgrecordid", F.col("docidentifier_normalized").alias("k"), fields.theme_labels(t).alias("labels"), fields.theme_categories(t, RULES).alias("categories"))


@query("select gkgrecordid, docidentifier_normalized as k, try_cast(split_part(replace(gcam, 'wc:', ''), ',', 1) as double) as first from gdelt_article where gcam is not null")
def first_number_part(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "gdelt_article", "gkgrecordid", "docidentifier_normalized", "gcam").where("gcam is not null")
    return a.select("gkgrecordid", F.col("docidentifier_normalized").alias("k"), fields.first_number(F.replace("gcam", F.lit("wc:"), F.lit(""))).alias("first"))


@query("select distinct actiongeo_fullname as raw, trim(regexp_replace(actiongeo_fullname, '[,0-9():]+.*$', '', 's')) as name from gdelt_event where length(trim(regexp_replace(actiongeo_fullname, '[,0-9():]+.*$', '', 's'))) > 2")
def entity_name_clean(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "gdelt_event", "actiongeo_fullname")
    return e.select(F.col("actiongeo_fullname").alias("raw"), fields.entity_name(F.col("actiongeo_fullname")).alias("name")).where("name is not null").distinct()


@query(r"select distinct actor1name as name, coalesce(nullif(regexp_replace(regexp_replace(trim(lower(actor1name)), '\s+', '_', 'g'), '[^\p{L}\p{N}_]', '', 'g'), ''), 'unknown') as slug from gdelt_event where actor1name is not null")
def slug_id(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "gdelt_event", "actor1name").where("actor1name is not null")
    return e.select(F.col("actor1name").alias("name"), fields.slug(F.col("actor1name")).alias("slug")).distinct()


@query("select gkgrecordid, cast(try_strptime(split_part(gkgrecordid, '-', 1), '%Y%m%d%H%M%S') as timestamp) as at from (select distinct gkgrecordid from gdelt_article)")
def stamp_parse(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "gdelt_article", "gkgrecordid").distinct()
    return a.select("gkgrecordid", fields.stamp(F.get(F.split("gkgrecordid", "-"), F.lit(0))).cast("timestamp_ntz").alias("at"))


@query("""select gkgrecordid, strftime(unnest(generate_series(t, t + interval '14 minutes', interval '1 minute')), '%Y%m%d%H%M%S') as minute from
    (select gkgrecordid, try_strptime(regexp_extract(gkgrecordid, '(\\d{14})', 1), '%Y%m%d%H%M%S') as t from (select distinct gkgrecordid from gdelt_article)) where t >= timestamp '2020-01-01'""")
def minute_expansion(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "gdelt_article", "gkgrecordid").distinct()
    return a.select("gkgrecordid", F.explode(fields.minutes_of_quarter(F.col("gkgrecordid"))).alias("minute"))


@query()
def html_decode(spark: SparkSession, d: str) -> DataFrame:
    """Extras with their character references decoded."""
    return table(spark, d, "gdelt_article", "extras").where("extras is not null").distinct().select("extras", fields.html_text("extras").alias("plain"))


@query("select distinct extras, trim(regexp_replace(regexp_replace(extras, '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g')) as body from gdelt_article where extras is not null")
def html_main_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gdelt_article", "extras").where("extras is not null").distinct().select("extras", clean.html_main_text(F.col("extras")).alias("body"))


@query()
def nfkc_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "title").select("doc_id", fields.nfkc("title").alias("title"))


_SPACES = r"[\t-\r\x{85}\p{Z}]+"  # what (?U)\s is


@query(f"select doc_id, md5(trim(regexp_replace(text, '{_SPACES}', ' ', 'g'))) as h from documents where text is not null")
def collapse_space(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.md5(fields.collapsed(F.col("text"))).alias("h"))


# rules are a parameter of the operator; these fit two of the test sites
SITE_RULES = {
    "harborledger.example": clean.SiteRules((r"(?imd)^read more from .*$", r"(?imd)^updated .*$", r"(?imd)^by .* for the harbor ledger.*$")),
    "ledger.example": clean.SiteRules((r"(?imd)^we use cookies .*$", r"(?imd)^by .* for ledger weekly.*$")),
}
_REMOVE = {s: ("".join("regexp_replace(" for _ in r.patterns), "".join(f", '{p.replace('(?imd)', '(?im)')}', '', 'g')" for p in r.patterns)) for s, r in SITE_RULES.items()}


@query("select doc_id, md5(text) as h from (select doc_id, case source " + " ".join(f"when '{s}' then trim(regexp_replace({a}text{b}, '{_SPACES}', ' ', 'g'))" for s, (a, b) in _REMOVE.items()) + " else text end as text from documents) where text <> ''")
def clean_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", "doc_id", "source", "text")
    return clean.clean_texts(t, "text", F.col("source"), SITE_RULES).select("doc_id", F.md5("text").alias("h"))


@query("select doc_id, length(text) as before, length(new) as after from (select doc_id, text, array_to_string(list_filter(lines, lambda x, i: x = '' or i = 1 or x <> lines[i - 1]), chr(10)) as new from (select doc_id, text, string_split(text, chr(10)) as lines from documents where text is not null)) where length(new) < length(text)")
def collapse_dup_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold an equal line twice in a row, with one of them left."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return t.select("doc_id", F.length("text").cast("bigint").alias("before"), F.length(collapse_lines(F.col("text"))).cast("bigint").alias("after")).where("after < before")


@query()
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunk_texts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


# the different words of a text in order of first place, none longer than twelve letters: windows of three overlap in one way only
_DISTINCT = r"list_filter(w, lambda x, i: list_position(w, x) = i)"
_NGRAM = f"""select doc_id, {{text}} as text from (select doc_id, array_to_string({_DISTINCT}, ' ') as t, ({_DISTINCT})[1] as w1 from
    (select doc_id, list_filter(regexp_extract_all(text, '[\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda x: length(x) <= 12) as w from documents where text is not null)) where t <> '' and {{where}}"""
_BORDER = "coalesce(list_max(list_filter(range(1, least(length(w1), length(t) // 2) + 1), lambda k: substr(t, 1, k) = right(t, k))), 0)"
_CUT = "trim(substr(t, {k} + 1))"


def _assembled(spark: SparkSession, d: str, how: assemble.Assembly, most: int = 12, numbered: bool = False) -> DataFrame:
    """Texts' three-word n-grams put together again by a variant of the joining; words numbered where letters alone overlap by chance."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    w = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.length(x) <= most))
    if numbered:
        w = F.transform(w, lambda x, i: F.concat(F.lpad(i.cast("string"), 5, "0"), x))
    parts = assemble.ngrams(t.select("doc_id", w.alias("w")), "doc_id", F.col("w"))
    sentence = assemble.fragment(F.col("pre"), F.col("ngram"), F.col("post"), F.col("pos"))
    return assemble.assemble(parts.select("doc_id", "pos", sentence.alias("sentence"), F.lit("2024-01-01T00:00:00").alias("date")), ["doc_id"], how).select("doc_id", "text")


@query(_NGRAM.format(text=_CUT.format(k=_BORDER), where="true"))
def ngram_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d, assemble.CANONICAL)


@query(_NGRAM.format(text="t", where="length(t) >= 100"))
def ngram_by_word(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d, assemble.BY_WORD_15)


_CHAR = f"""select doc_id, t as text from (select doc_id, array_to_string(list_transform({_DISTINCT}, lambda x, i: lpad(cast(i - 1 as varchar), 5, '0') || x), ' ') as t from
    (select doc_id, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) <= 8) as w from documents where text is not null)) where length(t) >= 150"""


@query(_CHAR)
def ngram_by_char_positions(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d, assemble.BY_CHAR_POSITIONS, 8, True)


@query(_CHAR)
def ngram_by_char(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d, assemble.BY_CHAR, 8, True)


@query()
def ngram_reassemble(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts from windows of twelve words, repeated words and all."""
    parts = assemble.shred(table(spark, d, "documents", "doc_id", "text", "published_at"), "doc_id", "text")
    return assemble.assemble(parts.withColumn("date", F.lit("2024-01-01T00:00:00")), ["doc_id"], assemble.Assembly(window=None))


@query("select item_id, case when strpos(substr(t, h), ' ') > 0 and strpos(substr(t, b + 150), '.') > 0 then substr(t, b, strpos(substr(t, b + 150), '.') + 150) else substr(t, 1, 200) end as passage from (select *, strpos(substr(t, h), ' ') + h as b from (select item_id, gold_contexts[1] as t, length(gold_contexts[1]) // 2 + 1 as h from eval_item where gold_contexts[1] is not null))")
def middle_passage(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "eval_item", "item_id", "gold_contexts").select("item_id", F.get("gold_contexts", F.lit(0)).alias("t")).where("t is not null")
    return t.select("item_id", fields.middle_passage(F.col("t")).alias("passage"))


WORDS = ["budget", "harbour", "tariff", "canal"]
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_BM25 = f"""with t as (select doc_id, {_TOK} as t from documents where text is not null),
    c as (select doc_id, len(t) as dl, {', '.join(f"len(list_filter(t, lambda x: x = '{w}')) as tf{i}" for i, w in enumerate(sorted(WORDS)))} from t),
    s as (select count(*) as n, avg(dl) as avgdl, {', '.join(f'count(*) filter (tf{i} > 0) as df{i}' for i in range(len(WORDS)))} from c)
    select doc_id, round({' + '.join(f'ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))' for i in range(len(WORDS)))}, 6) as score
    from c, s where {' or '.join(f'tf{i} > 0' for i in range(len(WORDS)))} order by score desc, doc_id limit 100"""


@query(_BM25)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.bm25(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", WORDS)


@query(_BM25)
def bm25_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stored index: only the postings of the query words are read."""
    path = f"{shared_folder(spark)}/textindex-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    retrieve.save_text_index(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", path)
    return retrieve.search_text_index(spark, path, "doc_id", WORDS)


@query("select label, vec_id, score, cast(rank as integer) as rank from (select label, vec_id, round(cast(embedding[2] as double), 6) as score, row_number() over (partition by label order by round(cast(embedding[2] as double), 6) desc, vec_id) as rank from embeddings) where rank <= 10")
def rerank_by_score(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by their own score where there is no scorer: the first ten of a group."""
    e = table(spark, d, "embeddings", "label", "vec_id", "embedding")
    return retrieve.rerank(e.select("label", "vec_id", F.round(F.col("embedding")[1].cast("double"), 6).alias("score")), "label", "vec_id")


@query("""with s as (select label, vec_id, round(cast(embedding[2] as double), 6) as score, row_number() over (partition by label order by round(cast(embedding[1] as double), 6) desc, vec_id) as rank, 4 * round(cast(embedding[1] as double), 6) as x from embeddings),
    p as (select *, 1 / (1 + exp(-x)) as p from s), q as (select *, lag(p) over (partition by label order by rank) - p as drop_ from p),
    z as (select *, max(case when p < 0.25 or (rank in (2, 3) and drop_ > 0.45) or (rank >= 4 and drop_ > 0.20) or rank > 10 then 1 else 0 end) over (partition by label order by rank) as stopped from q)
    select label, vec_id, score, cast(rank as integer) as rank, round(p, 6) as p from z where stopped = 0""")
def rerank_by_scorer(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by a scorer's column, cut adaptively."""
    e = table(spark, d, "embeddings", "label", "vec_id", "embedding")
    c = e.select("label", "vec_id", F.round(F.col("embedding")[1].cast("double"), 6).alias("score"), F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))
    return retrieve.rerank(c, "label", "vec_id", 4 * F.col("x")).drop("x")


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings", "vec_id", "embedding").orderBy("vec_id").first()["embedding"]]


_COSINE = "select vec_id, round(list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings order by vec_id limit 1)), 6) as score from embeddings order by score desc, vec_id limit 100"


@query(_COSINE)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.dense(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", _query_vector(spark, d))


@query(f"""with b as (select doc_id as id, 'keyword' as via, row_number() over (order by score desc, doc_id) as r from ({_BM25})),
    v as (select vec_id as id, 'vector' as via, row_number() over (order by score desc, vec_id) as r from ({_COSINE}))
    select id, string_agg(via, '+' order by via) as via, round(sum(1 / (60 + r)), 8) as score from (select * from b union all select * from v) group by id""")
def hybrid_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of both retrievers with a reciprocal-rank score."""
    b = bm25_topk(spark, d).withColumnRenamed("doc_id", "id")
    v = cosine_topk(spark, d).withColumnRenamed("vec_id", "id")
    return retrieve.fuse({"keyword": b, "vector": v}, "id")


@query("""with s as (select label, vec_id, row_number() over (partition by label order by round(cast(embedding[1] as double), 6) desc, vec_id) as rank, 4 * round(cast(embedding[1] as double), 6) as score from embeddings),
    p as (select *, 1 / (1 + exp(-score)) as p from s), q as (select *, lag(p) over (partition by label order by rank) - p as drop_ from p),
    z as (select *, max(case when p < 0.25 or (rank in (2, 3) and drop_ > 0.45) or (rank >= 4 and drop_ > 0.20) or rank > 10 then 1 else 0 end) over (partition by label order by rank) as stopped from q)
    select label, vec_id, cast(rank as integer) as rank, score, round(p, 6) as p from z where stopped = 0""")
def adaptive_cutoff(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "embeddings", "label", "vec_id", "embedding").withColumn("x", F.round(F.col("embedding")[0].cast("double"), 6))
    ranked = e.select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("x"), "vec_id")).alias("rank"), (4 * F.col("x")).alias("score"))
    return retrieve.adaptive_cut(ranked, "label", "rank", "score", 10)


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Place names: what stands before the colon of a title."""
    return table(spark, d, "documents", "title").select(F.get(F.split("title", ":"), F.lit(0)).alias("n")).where("title like '%:%' and length(n) >= 4").distinct()


_NAMES = "(select distinct split_part(title, ':', 1) as n from documents where title like '%:%' and length(split_part(title, ':', 1)) >= 4)"
_FOUND = f'select doc_id, n as name, cast(strpos(text, n) as integer) as "at" from documents join {_NAMES} on contains(text, n)'


@query(_FOUND)
def dictionary_matches(spark: SparkSession, d: str) -> DataFrame:
    return entities.dictionary_matches(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", _dictionary(spark, d), "n")


@query(f"select doc_id, count(distinct name) as n_names from ({_FOUND}) group by 1 having count(distinct name) >= 2")
def rich_chunks(spark: SparkSession, d: str) -> DataFrame:
    return entities.rich_chunks(dictionary_matches(spark, d), "doc_id")


@query(f'select doc_id, list(name order by "at", name)[1:6] as names from ({_FOUND}) group by 1')
def capped_names(spark: SparkSession, d: str) -> DataFrame:
    return entities.capped_names(dictionary_matches(spark, d), "doc_id", 6)


@query(f'with c as (select doc_id, list(name order by "at", name)[1:8] as names from ({_FOUND}) group by 1), x as (select doc_id, names, unnest(names) as subject from c) select doc_id, subject, object from (select doc_id, subject, unnest(names) as object from x) where subject <> object')
def entity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pairs of each text's first eight names (the cap of the relation step)."""
    from ..operators.graph import entity_pairs as pairs

    return pairs(entities.capped_names(dictionary_matches(spark, d), "doc_id", 8), "doc_id", "names")


@query(f"select distinct a.doc_id, a.name as subject, b.name as object from ({_FOUND}) a join ({_FOUND}) b on a.doc_id = b.doc_id and a.name <> b.name")
def entity_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pairs of all of each text's names, however many."""
    from ..operators.graph import entity_pairs as pairs

    return pairs(entities.all_names(dictionary_matches(spark, d), "doc_id"), "doc_id", "names")


@query()
def fuzzy_entity_link(spark: SparkSession, d: str) -> DataFrame:
    """Actor names with a letter lost, linked to actor names again (indel ratio: unit-tested)."""
    known = table(spark, d, "gdelt_event", "actor1name").where("actor1name is not null").distinct()
    known = known.select("actor1name", F.concat(F.lit("Q"), F.md5("actor1name")).alias("id"))
    typo = F.concat(F.substring("actor1name", 1, 4), F.substr("actor1name", F.lit(6)))
    return entities.fuzzy_link(known.select(typo.alias("n")), "n", known, "actor1name", "id")
