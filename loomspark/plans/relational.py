"""Relational queries: joins, sets, duplicates, aggregates, windows, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fields import EVENT_ROOTS, event_root_label
from ..functions.urls import normal_key
from ..operators.dedup import duplicate_rows, first_n, keep_first, keep_last
from ..operators.graph import super_edges
from ..operators.quality import coverage, density, distribution, has_text, long_enough, profile
from ..operators.relational import closure, filled, insert_absent, seeded_part, seeded_sample, with_both_parents
from ..sources.tables import table

QUERIES, ORACLE = {}, {}
# normal form of an article key in SQL
KEY = "regexp_replace(regexp_replace(trim(lower({c})), '^https?://', ''), '/$', '')"
A_KEY, M_KEY, U_KEY = (KEY.format(c=c) for c in ("docidentifier_normalized", "mentionidentifier_normalized", "url"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def articles(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "gdelt_article", "docidentifier_normalized", *columns).withColumn("k", normal_key(F.col("docidentifier_normalized"))).drop("docidentifier_normalized")


def mentions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "gdelt_mention", "mentionidentifier_normalized", *columns).withColumn("k", normal_key(F.col("mentionidentifier_normalized"))).drop("mentionidentifier_normalized")


@query(f"""
    select extract(year from event_day) as year, count(distinct e.globaleventid) as n_events
    from gdelt_event e join gdelt_mention m on e.globaleventid = m.globaleventid
      join (select {A_KEY} as k, enhancedthemes from gdelt_article) a on {M_KEY} = a.k
    where a.enhancedthemes ilike '%tariff%' and event_day >= date '2024-06-01' group by all""")
def theme_event_count(spark: SparkSession, d: str) -> DataFrame:
    """Distinct events with a theme since a date: event, mention and article joined, counted per year."""
    e = table(spark, d, "gdelt_event", "globaleventid", "event_day").where("event_day >= date'2024-06-01'")
    a = articles(spark, d, "enhancedthemes").where(F.col("enhancedthemes").ilike("%tariff%")).select("k").distinct()
    m = mentions(spark, d, "globaleventid").join(a, "k", "left_semi")
    return e.join(m.select("globaleventid").distinct(), "globaleventid").groupBy(F.year("event_day").cast("bigint").alias("year")).agg(F.count_distinct("globaleventid").alias("n_events"))


@query(f"""select mentionid from gdelt_mention where globaleventid in (select globaleventid from gdelt_event)
    and {M_KEY} in (select {A_KEY} from gdelt_article where docidentifier_normalized is not null)""")
def fk_kept(spark: SparkSession, d: str) -> DataFrame:
    """Mentions with both parents."""
    return with_both_parents(mentions(spark, d, "mentionid", "globaleventid"), table(spark, d, "gdelt_event", "globaleventid"), "globaleventid", articles(spark, d), "k").select("mentionid")


@query(f"""select coalesce(t.title, '') as title, k, coalesce(cast(t.published_at as timestamp), cast(a.article_date as timestamp)) as at
    from (select {A_KEY} as k, min(article_date) as article_date from gdelt_article where docidentifier_normalized is not null group by 1) a
    left join (select {U_KEY} as k, min_by(struct_pack(title := title, published_at := published_at), doc_id) as t from documents where url is not null group by 1) using (k)""")
def left_join_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Articles with title and date of their document, the article's own date second."""
    a = articles(spark, d, "article_date").where("k is not null").groupBy("k").agg(F.min("article_date").alias("article_date"))
    docs = table(spark, d, "documents", "doc_id", "url", "title", "published_at").where("url is not null").withColumn("k", normal_key(F.col("url")))
    docs = keep_first(docs.select("k", "doc_id", "title", "published_at"), "k", "doc_id")
    out = filled(a.withColumn("none", F.lit("")), docs, "k", {"title": ("title", "none"), "at": ("published_at", "article_date")})
    return out.select("k", "title", F.col("at").cast("timestamp_ntz").alias("at"))


@query(f"select doc_id from documents where {U_KEY} in (select {A_KEY} from gdelt_article)")
def semi_join_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "url").withColumn("k", normal_key(F.col("url"))).join(articles(spark, d), "k", "left_semi").select("doc_id")


@query(f"select doc_id from documents where url is not null and {U_KEY} not in (select {A_KEY} from gdelt_article where docidentifier_normalized is not null)")
def anti_join_keys(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "url").where("url is not null").withColumn("k", normal_key(F.col("url")))
    return docs.join(articles(spark, d), "k", "left_anti").select("doc_id")


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents", "url", "text").withColumn("k", normal_key(F.col("url")))
    return articles(spark, d).select("k"), docs.select("k"), docs.where(has_text(F.col("text")) & long_enough(F.col("text"), 150)).select("k")


_SETS = f"""with a as (select distinct {A_KEY} as k from gdelt_article where docidentifier_normalized is not null),
    b as (select distinct {U_KEY} as k from documents where url is not null),
    c as (select distinct {U_KEY} as k from documents where url is not null and length(text) >= 150) """


@query(_SETS + """select count(*) as n_expected, count(b.k) as n_seen, count(c.k) as n_usable, count(*) - count(b.k) as n_missing,
    round(100.0 * count(b.k) / count(*), 4) as pct_seen, round(100.0 * count(c.k) / count(b.k), 4) as pct_usable
    from a left join b on a.k = b.k left join c on a.k = c.k""")
def gap_analysis(spark: SparkSession, d: str) -> DataFrame:
    return coverage(*_keys(spark, d), "k")


@query(_SETS + "select k from a union select k from b")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _keys(spark, d)
    return a.unionByName(b).where("k is not null").distinct()


@query(_SETS + "select k from a intersect select k from b")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _keys(spark, d)
    return a.intersect(b).where("k is not null")


@query(_SETS + "select k from a except select k from c")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    a, _, c = _keys(spark, d)
    return a.where("k is not null").subtract(c)


@query("select sourceurl as u, 'event' as via from gdelt_event union all select docidentifier_original, 'article' from gdelt_article union all select url, 'document' from documents")
def union_all_sources(spark: SparkSession, d: str) -> DataFrame:
    parts = (("gdelt_event", "sourceurl", "event"), ("gdelt_article", "docidentifier_original", "article"), ("documents", "url", "document"))
    a, b, c = (table(spark, d, t, col).select(F.col(col).alias("u"), F.lit(via).alias("via")) for t, col, via in parts)
    return a.unionByName(b).unionByName(c)


_ROWS = f"select {A_KEY} as k, gkgrecordid, cast(epoch_us(dateadded) as bigint) as added from gdelt_article where docidentifier_normalized is not null"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d, "gkgrecordid", "dateadded").where("k is not null").select("k", "gkgrecordid", F.unix_micros("dateadded").alias("added"))


@query(f"select k, min(gkgrecordid) as gkgrecordid, min_by(coalesce(added, -1), gkgrecordid) as added from ({_ROWS}) group by k")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """First row per article key in order of record id."""
    rows = _rows(spark, d).withColumn("added", F.coalesce("added", F.lit(-1)))
    return keep_first(rows, "k", "gkgrecordid", "added").select("k", "gkgrecordid", "added")


@query(f"select k, r.gkgrecordid as gkgrecordid, r.added as added from (select k, max(struct_pack(added := coalesce(added, -1), gkgrecordid := gkgrecordid)) as r from ({_ROWS}) group by k)")
def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    """Latest row per article key."""
    return keep_last(_rows(spark, d).withColumn("added", F.coalesce("added", F.lit(-1))), "k", "added", "gkgrecordid").select("k", "gkgrecordid", "added")


@query(f"select k, gkgrecordid, n as copies from (select k, gkgrecordid, count(*) over (partition by k) as n from ({_ROWS})) where n > 1")
def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_rows(_rows(spark, d).select("k", "gkgrecordid"), "k").select("k", "gkgrecordid", "copies")


@query("select globaleventid, any_value(eventrootcode) as code from (select globaleventid, min_by(eventrootcode, coalesce(eventrootcode, '~')) as eventrootcode from gdelt_event where globaleventid is not null and globaleventid not in (select try_cast(key_value as bigint) from deleted_key where ref_table = 'event' and try_cast(key_value as bigint) is not null) group by 1) group by 1")
def upsert_absent(spark: SparkSession, d: str) -> DataFrame:
    """Events that an insert-if-absent would append to a table holding the withdrawn keys."""
    target = table(spark, d, "deleted_key", "ref_table", "key_value").where("ref_table = 'event'").selectExpr("try_cast(key_value as bigint) as globaleventid").where("globaleventid is not null").distinct()
    batch = table(spark, d, "gdelt_event", "globaleventid", "eventrootcode").select("globaleventid", F.col("eventrootcode").alias("code"), F.coalesce("eventrootcode", F.lit("~")).alias("o"))
    return insert_absent(target, batch, "globaleventid", "o").select("globaleventid", "code")


@query("select case when not regexp_full_match(eventrootcode, '[0-9]+') then lower(eventrootcode) else case substr(eventrootcode, 1, 2) " + " ".join(f"when '{i}' then '{x}'" for i, x in EVENT_ROOTS.items()) + " else lower(eventrootcode) end end as label, count(*) as n from gdelt_event where eventrootcode is not null group by all")
def event_root_decode(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "gdelt_event", "eventrootcode").where("eventrootcode is not null")
    return e.groupBy(event_root_label(F.col("eventrootcode")).alias("label")).agg(F.count("*").alias("n"))


@query("select mentionsourcename, count(*) as n, count(distinct globaleventid) as n_events from gdelt_mention group by 1 having count(*) between 20 and 200000")
def group_having_range(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gdelt_mention", "mentionsourcename", "globaleventid").groupBy("mentionsourcename")
    return g.agg(F.count("*").alias("n"), F.count_distinct("globaleventid").alias("n_events")).where("n between 20 and 200000")


@query("select coalesce(actor1name, '(none)') as name, count(*) as n from gdelt_event group by 1 order by n desc, name limit 20")
def value_counts_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "gdelt_event", "actor1name")
    return e.groupBy(F.coalesce("actor1name", F.lit("(none)")).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(20)


_PROFILED = ("globaleventid", "isrootevent", "eventrootcode", "actor1name", "actor2name", "actiongeo_fullname", "nummentions")


@query(" union all ".join(f"select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_null, count(distinct {c}) as n_distinct, round(100.0 * (count(*) - count({c})) / count(*), 4) as pct_null, round(100.0 * count(distinct {c}) / count(*), 4) as pct_unique from gdelt_event" for c in _PROFILED))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile(table(spark, d, "gdelt_event", *_PROFILED), list(_PROFILED), exact=True)


@query(" union all ".join(f"select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_null, true as near from gdelt_event" for c in _PROFILED))
def column_profile_approx(spark: SparkSession, d: str) -> DataFrame:
    """The same in one pass without a distinct shuffle; near: the distinct values within 15 % (or 2) of the exact number."""
    e = table(spark, d, "gdelt_event", *_PROFILED)
    exact = profile(e, list(_PROFILED), exact=True).select("column_name", F.col("n_distinct").alias("x"))
    near = F.abs(F.col("n_distinct") - F.col("x")) <= F.greatest(0.15 * F.col("x"), F.lit(2.0))
    return profile(e, list(_PROFILED)).join(exact, "column_name").select("column_name", "n_rows", "n_null", near.alias("near"))


@query("""with e as (select o_orderpriority, o_totalprice, min(o_totalprice) over () as a, (max(o_totalprice) over () - min(o_totalprice) over ()) / 20 as w from orders where o_totalprice is not null),
    b as (select o_orderpriority, least(cast(floor((o_totalprice - a) / w) as bigint), 19) as bin, any_value(a) as a, any_value(w) as w, count(*) as n from e group by 1, 2)
    select o_orderpriority, bin, round(a + bin * w, 6) as low, n, round(n / sum(n) over (partition by o_orderpriority), 6) as share from b""")
def value_density(spark: SparkSession, d: str) -> DataFrame:
    """Outline of the values of each group: counts in 20 bins of equal width."""
    return density(table(spark, d, "orders", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice")


@query(f"select vec_id, doc_id, {U_KEY} as k from embeddings join documents on vec_id = doc_id where url is not null and {U_KEY} in (select {A_KEY} from gdelt_article)")
def vector_article_rows(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose document is an article of the table."""
    v = table(spark, d, "embeddings", "vec_id")
    docs = table(spark, d, "documents", "doc_id", "url").where("url is not null").select("doc_id", normal_key(F.col("url")).alias("k"))
    return docs.join(v, F.col("doc_id") == F.col("vec_id")).join(articles(spark, d), "k", "left_semi").select("vec_id", "doc_id", "k")


@query("select eventrootcode, round(avg(cast(avgtone as double)), 3) as tone, round(avg(nummentions), 3) as mentions, count(*) as n from gdelt_event group by 1")
def mean_by_category(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "gdelt_event", "eventrootcode", "avgtone", "nummentions").groupBy("eventrootcode")
    return e.agg(F.round(F.avg(F.col("avgtone").cast("double")), 3).alias("tone"), F.round(F.avg("nummentions"), 3).alias("mentions"), F.count("*").alias("n"))


@query("select o_orderpriority, o_orderstatus, count(*) as n, round(avg(o_totalprice), 3) as mean, round(median(o_totalprice), 3) as median from orders group by all")
def median_by_group(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice").groupBy("o_orderpriority", "o_orderstatus")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 3).alias("mean"), F.round(F.median("o_totalprice"), 3).alias("median"))


@query("select count(o_totalprice) as n, min(o_totalprice) as least, max(o_totalprice) as most, round(quantile_cont(o_totalprice, 0.25), 6) as q1, round(quantile_cont(o_totalprice, 0.5), 6) as median, round(quantile_cont(o_totalprice, 0.75), 6) as q3 from orders")
def value_distribution(spark: SparkSession, d: str) -> DataFrame:
    return distribution(table(spark, d, "orders", "o_totalprice"), "o_totalprice")


@query("select site, cast(sum(n) as bigint) as n from (select coalesce(source, '(none)') as site, count(*) as n from documents group by 1 union all select '(total)', count(*) from documents) group by 1")
def counts_with_total(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "documents", "source").select(F.coalesce("source", F.lit("(none)")).alias("site")).groupBy("site").agg(F.count("*").alias("n"))
    return by.unionByName(by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("(total)").alias("site"), "n"))


@query("select source, doc_id, rank from (select source, doc_id, cast(row_number() over (partition by source order by doc_id) as integer) as rank from documents where source is not null) where rank <= 3")
def first_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    return first_n(table(spark, d, "documents", "source", "doc_id").where("source is not null"), "source", 3, F.col("doc_id"))


@query("""select eventrootcode, side, rank, globaleventid, tone from (
      select eventrootcode, globaleventid, tone, unnest([struct_pack(side := 'best', rank := b), struct_pack(side := 'worst', rank := w)], recursive := true) from (
        select eventrootcode, globaleventid, tone, cast(row_number() over (partition by eventrootcode order by tone desc, globaleventid) as integer) as b, cast(row_number() over (partition by eventrootcode order by tone, globaleventid) as integer) as w
        from (select eventrootcode, globaleventid, max(cast(avgtone as double)) as tone from gdelt_event where eventrootcode is not null and avgtone is not null group by 1, 2))) where rank <= 5""")
def best_worst_k(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "gdelt_event", "eventrootcode", "globaleventid", "avgtone").where("eventrootcode is not null and avgtone is not null")
    e = e.groupBy("eventrootcode", "globaleventid").agg(F.max(F.col("avgtone").cast("double")).alias("tone"))
    best = first_n(e, "eventrootcode", 5, F.desc("tone"), F.col("globaleventid")).withColumn("side", F.lit("best"))
    return best.unionByName(first_n(e, "eventrootcode", 5, F.col("tone"), F.col("globaleventid")).withColumn("side", F.lit("worst")))


@query("select category, item_id, rank from (select category, item_id, cast(row_number() over (partition by category order by md5(concat(cast(item_id as varchar), 's1')), item_id) as integer) as rank from eval_item) where rank <= 10")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_item", "category", "item_id")
    return first_n(items, "category", 10, F.md5(F.concat(F.col("item_id").cast("string"), F.lit("s1"))), F.col("item_id"))


@query("select source, list(struct_pack(doc_id := doc_id, snippet := substr(text, 1, 80)) order by doc_id) as samples from (select *, row_number() over (partition by source order by doc_id) as r from documents where source is not null and text is not null) where r <= 3 group by source")
def samples_per_source(spark: SparkSession, d: str) -> DataFrame:
    """A few snippets per source, nested."""
    rows = table(spark, d, "documents", "source", "doc_id", "text").where("source is not null and text is not null")
    rows = first_n(rows.select("source", "doc_id", F.substring("text", 1, 80).alias("snippet")), "source", 3, F.col("doc_id"))
    return rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "snippet"))).alias("samples"))


@query("select doc_id from documents order by md5(concat(cast(doc_id as varchar), 'seed7')), doc_id limit 100")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """100 documents by a seeded hash (a sampling operator)."""
    return seeded_sample(table(spark, d, "documents", "doc_id"), "doc_id", 100, "seed7")


@query("select part, count(*) as n from (select case when cast('0x' || substr(md5(concat(cast(item_id as varchar), '42')), 1, 8) as bigint) < 3650722201 then 'train' else 'test' end as part from eval_item) group by 1")
def split_85_15(spark: SparkSession, d: str) -> DataFrame:
    return seeded_part(table(spark, d, "eval_item", "item_id"), "item_id", 0.85, "42").groupBy("part").agg(F.count("*").alias("n"))


@query("""with r as (select cast(l_suppkey as varchar) as source_id, l_returnflag as relation, cast(l_linenumber as varchar) as target_id, l_discount as score, cast(l_orderkey as varchar) as chunk_id from lineitem),
    c as (select source_id, target_id, relation, chunk_id, max(score) as score, count(*) as n from r group by all),
    k as (select *, row_number() over (partition by source_id, target_id, relation order by score desc, chunk_id) as rn from c)
    select source_id, target_id, relation, max(score) as max_score, cast(sum(n) as bigint) as weight, string_agg(case when rn <= 20 then chunk_id end, '|' order by rn) as chunk_ids from k group by all""")
def super_edge_aggregate(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_suppkey", "l_linenumber", "l_returnflag", "l_discount", "l_orderkey")
    return super_edges(li.select(F.col("l_suppkey").cast("string").alias("source_id"), F.col("l_linenumber").cast("string").alias("target_id"), F.col("l_returnflag").alias("relation"), F.col("l_discount").alias("score"), F.col("l_orderkey").cast("string").alias("chunk_id")))


_SAMPLE = "select distinct globaleventid from gdelt_event order by md5(concat(cast(globaleventid as varchar), 'xs')), globaleventid limit 200"


@query(f"""with e as ({_SAMPLE}), m as (select mentionid, {M_KEY} as k from gdelt_mention where globaleventid in (select globaleventid from e)),
    a as (select distinct {A_KEY} as k from gdelt_article where {A_KEY} in (select k from m))
    select 'event' as kind, count(*) as n from e union all select 'mention', count(*) from m union all select 'article', count(*) from a""")
def subset_closure(spark: SparkSession, d: str) -> DataFrame:
    """Sampled events (a sampling operator), all their mentions, and all articles of those."""
    e = seeded_sample(table(spark, d, "gdelt_event", "globaleventid").distinct(), "globaleventid", 200, "xs")
    m, a = closure(e, mentions(spark, d, "globaleventid", "mentionid"), articles(spark, d), "globaleventid", "k")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(e, "event").unionByName(count(m, "mention")).unionByName(count(a.distinct(), "article"))


@query("select category, count(*) as n, greatest(0, 60 - count(*)) as open from eval_item group by 1")
def quota_left(spark: SparkSession, d: str) -> DataFrame:
    """Items per category and how many a quota of 60 still lacks."""
    g = table(spark, d, "eval_item", "category").groupBy("category").agg(F.count("*").alias("n"))
    return g.select("category", "n", F.greatest(F.lit(0).cast("bigint"), 60 - F.col("n")).alias("open"))


@query("select globaleventid, label, p from (select globaleventid, ['root', 'tone', 'scale'] as ls, [round(cast(isrootevent as double), 6), round(abs(cast(avgtone as double)) / 10, 6), round(abs(cast(goldsteinscale as double)) / 10, 6)] as ps, greatest(ps[1], ps[2], ps[3]) as p, ls[list_position(ps, p)] as label from (select globaleventid, max(isrootevent) as isrootevent, max(avgtone) as avgtone, max(goldsteinscale) as goldsteinscale from gdelt_event where isrootevent is not null and avgtone is not null and goldsteinscale is not null group by 1)) where p >= 0.6")
def arg_max_label(spark: SparkSession, d: str) -> DataFrame:
    """Most probable of several labels, at a threshold."""
    e = table(spark, d, "gdelt_event", "globaleventid", "isrootevent", "avgtone", "goldsteinscale").dropna().groupBy("globaleventid")
    e = e.agg(F.max("isrootevent").cast("double").alias("a"), (F.abs(F.max("avgtone").cast("double")) / 10).alias("b"), (F.abs(F.max("goldsteinscale").cast("double")) / 10).alias("c"))
    ps = F.array(*[F.round(x, 6) for x in "abc"])
    e = e.select("globaleventid", ps.alias("ps")).withColumn("p", F.array_max("ps"))
    return e.where("p >= 0.6").select("globaleventid", F.element_at(F.array(F.lit("root"), F.lit("tone"), F.lit("scale")), F.array_position("ps", F.col("p")).cast("int")).alias("label"), "p")


@query("select time_bucket(interval '1 hour', cast(ts as timestamp)) as window_start, event_type, count(*) as n_events from events group by all")
def events_windowed(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type (an extension)."""
    from ..streaming.files import windowed_counts

    out = windowed_counts(table(spark, d, "events", "ts", "event_type"), "ts", "event_type")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def stream_file_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The events file through a file stream with a checkpoint, read back."""
    from ..streaming.files import ingest

    schema = table(spark, d, "events").schema
    out = spark.read.parquet(ingest(spark, d, "events.parquet", schema))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select event_type, count(*) as n, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as k from events group by 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    p = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events", "event_type", "props").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(p).alias("k"))


@query("select 'documents' as table_name, count(*) as before, count(distinct text) + max(case when text is null then 1 else 0 end) as after, count(*) - (count(distinct text) + max(case when text is null then 1 else 0 end)) as removed from documents")
def reduction_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows before and after dropping equal texts."""
    t = table(spark, d, "documents", "text").groupBy("text").agg(F.count("*").alias("n"))
    return t.agg(F.sum("n").alias("before"), F.count("*").alias("after")).select(F.lit("documents").alias("table_name"), "before", "after", (F.col("before") - F.col("after")).alias("removed"))
