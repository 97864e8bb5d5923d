"""Entity and graph queries over event and article tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fields import chunk_id
from ..functions.urls import normal_key
from ..operators import graph
from ..sources.tables import table
from .textual import RULES, _SQL_CAT

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_CLEAN = "case when length(trim(regexp_replace({c}, '[,0-9():]+.*$', '', 's'))) > 2 then trim(regexp_replace({c}, '[,0-9():]+.*$', '', 's')) end"
_DIRTY = f"""select distinct name, tag from (
    select {_CLEAN.format(c='actor1name')} as name, 'ACTOR_OR_LOCATION' as tag from gdelt_event union all select {_CLEAN.format(c='actor2name')}, 'ACTOR_OR_LOCATION' from gdelt_event
    union all select {_CLEAN.format(c='actiongeo_fullname')}, 'LOCATION' from gdelt_event
    union all select {_CLEAN.format(c='x')}, 'UNKNOWN' from (select unnest(string_split(allnames, ';')) as x from gdelt_article)
    union all select {_CLEAN.format(c='x')}, 'LOCATION' from (select unnest(string_split(locations, ';')) as x from gdelt_article)
    union all select x, 'THEME' from (select trim(unnest(string_split(enhancedthemes, ';'))) as x from gdelt_article) where x <> '') where name is not null"""
_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(trim(lower(name)), '\s+', '_', 'g'), '[^\p{L}\p{M}\p{N}_]', '', 'g'), ''), 'unknown')"
_KNOWN = "(select distinct actor1name as known, 'Q' || substr(md5(actor1name), 1, 8) as kid from gdelt_event where actor1name is not null and length(actor1name) % 2 = 0)"
_LINKED = f"""select d.name as dirty_name, coalesce(kid, case when tag = 'THEME' then 'theme:' || {_SLUG} else 'custom:' || lower(kind) || ':' || {_SLUG} end) as id, d.name as name,
    case when kid is not null then 'Actor' else kind end as type, case when kid is not null then 'wikidata' else 'custom' end as source
    from (select name, tag, case tag when 'THEME' then 'Theme' when 'LOCATION' then 'Location' else 'Actor' end as kind from
      (select name, min_by(tag, list_position(['LOCATION', 'THEME', 'ACTOR_OR_LOCATION', 'UNKNOWN'], tag)) as tag from ({_DIRTY}) group by 1)) d left join {_KNOWN} on d.name = known"""


@query(_DIRTY)
def dirty_entities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "gdelt_event", "actor1name", "actor2name", "actiongeo_fullname")
    a = table(spark, d, "gdelt_article", "allnames", "locations", "enhancedthemes")
    split = lambda c: F.split(c, ";")
    themes = F.filter(F.transform(split("enhancedthemes"), lambda x: F.trim(x)), lambda x: x != "")
    return graph.dirty_entities(e, ["actor1name", "actor2name"], ["actiongeo_fullname"], a, {"names": (split("allnames"), "UNKNOWN"), "places": (split("locations"), "LOCATION"), "themes": (themes, "THEME")})


def _known(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in knowledge base: every other actor name."""
    n = table(spark, d, "gdelt_event", "actor1name").where("actor1name is not null and length(actor1name) % 2 = 0").distinct()
    return n.select(F.col("actor1name").alias("dirty_name"), F.concat(F.lit("Q"), F.substring(F.md5("actor1name"), 1, 8)).alias("id"), F.col("actor1name").alias("name"), F.lit("Actor").alias("type"))


@query(_LINKED)
def entity_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.link_entities(dirty_entities(spark, d), _known(spark, d))


_STOP = ("ash", "government")


@query(f"select dirty_name, id from ({_LINKED}) where source = 'wikidata' and type in ('Actor', 'Location') and lower(name) not in ('ash', 'government') and (length(name) > 2 or name in ('UN', 'EU'))")
def entity_filter(spark: SparkSession, d: str) -> DataFrame:
    return graph.good_entities(entity_links(spark, d), ["Actor", "Location"], list(_STOP), ["UN", "EU"]).select("dirty_name", "id")


@query(f"select lower(name) as name, max_by(id, dirty_name) as id from ({_LINKED}) group by 1")
def canonical_lookup(spark: SparkSession, d: str) -> DataFrame:
    return graph.canonical(entity_links(spark, d), "dirty_name")


@query(f"select count(*) as total, count(*) filter (source = 'wikidata') as wikidata, count(*) filter (source = 'custom') as custom from ({_LINKED})")
def entity_stats(spark: SparkSession, d: str) -> DataFrame:
    return entity_links(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("source") == "wikidata").alias("wikidata"), F.count_if(F.col("source") == "custom").alias("custom"))


@query("select globaleventid, cast(any_value(p.day) as varchar) as day, any_value(p.tone) as tone from (select globaleventid, max_by(struct_pack(day := event_day, tone := cast(avgtone as double)), struct_pack(a := coalesce(epoch_us(dateadded), -1), b := coalesce(nummentions, -1), c := coalesce(cast(avgtone as double), -1e9), d := coalesce(event_day, date '1900-01-01'))) as p from gdelt_event group by 1) group by 1")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Event nodes; properties of the row delivered last."""
    e = table(spark, d, "gdelt_event", "globaleventid", "event_day", "avgtone", "dateadded", "nummentions")
    at = F.struct(F.coalesce(F.unix_micros("dateadded"), F.lit(-1)).alias("a"), F.coalesce("nummentions", F.lit(-1)).alias("b"), F.coalesce(F.col("avgtone").cast("double"), F.lit(-1e9)).alias("c"), F.coalesce("event_day", F.lit("1900-01-01").cast("date")).alias("d"))
    return graph.merge_nodes(e.select("globaleventid", F.col("event_day").cast("string").alias("day"), F.col("avgtone").cast("double").alias("tone"), at.alias("at")), "globaleventid", "at")


_INVOLVED = f"""select distinct x.name as src, cast(globaleventid as varchar) as dst, 'INVOLVED_IN' as type from (
    select {_CLEAN.format(c='actor1name')} as name, globaleventid from gdelt_event union all select {_CLEAN.format(c='actor2name')}, globaleventid from gdelt_event union all select {_CLEAN.format(c='actiongeo_fullname')}, globaleventid from gdelt_event) x where name is not null"""


@query(f"select l.id as src, i.dst, i.type from ({_INVOLVED}) i join ({_LINKED}) l on i.src = l.dirty_name group by all")
def graph_edges_involved(spark: SparkSession, d: str) -> DataFrame:
    """Entity -> event, through the entity map."""
    from ..functions.fields import entity_name

    e = table(spark, d, "gdelt_event", "globaleventid", "actor1name", "actor2name", "actiongeo_fullname")
    x = e.select(F.col("globaleventid").cast("string").alias("dst"), F.explode(F.array(*[entity_name(F.col(c)) for c in ("actor1name", "actor2name", "actiongeo_fullname")])).alias("n"))
    x = x.where("n is not null").distinct().join(entity_links(spark, d).select(F.col("dirty_name").alias("n"), "id"), "n")
    return graph.edges(x, F.col("id"), F.col("dst"), "INVOLVED_IN")


_AK = "regexp_replace(regexp_replace(trim(lower(docidentifier_normalized)), '^https?://', ''), '/$', '')"


@query(f"select distinct {_AK} as src, x as dst, 'HAS_THEME' as type from (select docidentifier_normalized, trim(unnest(string_split(enhancedthemes, ';'))) as x from gdelt_article) where x <> '' and docidentifier_normalized is not null")
def graph_edges_themes(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "gdelt_article", "docidentifier_normalized", "enhancedthemes")
    x = a.select(normal_key(F.col("docidentifier_normalized")).alias("k"), F.explode(F.split("enhancedthemes", ";")).alias("x"))
    return graph.edges(x, F.col("k"), F.nullif(F.trim("x"), F.lit("")), "HAS_THEME")


@query(f"select distinct {_AK} as src, {_SQL_CAT} as dst, 'IN_CATEGORY' as type from (select docidentifier_normalized, unnest(string_split(enhancedthemes, ';')) as x from gdelt_article) where x <> '' and docidentifier_normalized is not null")
def graph_edges_categories(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.fields import theme_category

    a = table(spark, d, "gdelt_article", "docidentifier_normalized", "enhancedthemes")
    x = a.select(normal_key(F.col("docidentifier_normalized")).alias("k"), F.explode(F.split("enhancedthemes", ";")).alias("x")).where("x <> ''")
    return graph.edges(x, F.col("k"), theme_category(F.col("x"), RULES), "IN_CATEGORY")


_GEO = "(select 'c' || c_custkey as src, 'n' || c_nationkey as dst, 'LIVES_IN' as type from customer) e"


@query(f"select s.name as source, type, t.name as target from {_GEO} join (select 'c' || c_custkey as id, c_name as name from customer where contains(lower(c_name), '00001')) s on s.id = src join (select 'n' || n_nationkey as id, n_name as name from nation where length(n_name) > 4) t on t.id = dst order by source, type, target limit 50")
def one_hop_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Customers by name and their nation: one hop over node and edge tables (the first 50, as the graph tool shows)."""
    c, n = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey"), table(spark, d, "nation", "n_nationkey", "n_name")
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name")))
    rows = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("LIVES_IN").alias("type"))
    return graph.one_hop(rows, nodes, "id", F.contains(F.lower("name"), F.lit("00001")) & F.startswith("id", F.lit("c")), (F.length("name") > 4) & F.startswith("id", F.lit("n")))


@query("select count(*) as n from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey < 12) and l_partkey in (select p_partkey from part where p_size < 20)")
def attached_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges both of whose ends exist."""
    li = table(spark, d, "lineitem", "l_suppkey", "l_partkey").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey").where("s_nationkey < 12").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    p = table(spark, d, "part", "p_partkey", "p_size").where("p_size < 20").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return graph.attached(li, s.unionByName(p), "id").agg(F.count("*").alias("n"))


@query("select doc_id, length(text) as n from documents where text is not null and (doc_id in (select l_orderkey from lineitem) or doc_id in (select l_partkey from lineitem))")
def graph_text_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the chunk ids that edges carry, packed two to an edge."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey").select(F.concat_ws("|", "l_orderkey", "l_partkey").alias("ids"))
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null").withColumn("id", F.col("doc_id").cast("string"))
    return graph.bridge(li, "ids", docs, "id").select("doc_id", F.length("text").cast("bigint").alias("n"))


@query(f"select k, p.url as url, cast(p.date as varchar) as date from (select {_AK} as k, max_by(struct_pack(url := docidentifier_original, date := strftime(article_date at time zone 'UTC', '%Y-%m-%d')), struct_pack(a := coalesce(epoch_us(dateadded), -1), b := gkgrecordid, c := coalesce(docidentifier_original, ''), d := coalesce(epoch_us(article_date), -1))) as p from gdelt_article where docidentifier_normalized is not null group by 1)")
def graph_nodes_article(spark: SparkSession, d: str) -> DataFrame:
    """Article nodes; address and day of the row delivered last."""
    a = table(spark, d, "gdelt_article", "docidentifier_normalized", "docidentifier_original", "article_date", "dateadded", "gkgrecordid")
    at = F.struct(F.coalesce(F.unix_micros("dateadded"), F.lit(-1)).alias("a"), F.col("gkgrecordid").alias("b"), F.coalesce("docidentifier_original", F.lit("")).alias("c"), F.coalesce(F.unix_micros("article_date"), F.lit(-1)).alias("d"))
    return graph.merge_nodes(a.select(normal_key(F.col("docidentifier_normalized")).alias("k"), F.col("docidentifier_original").alias("url"), F.date_format("article_date", "yyyy-MM-dd").alias("date"), at.alias("at")), "k", "at")


@query(f"select id, p.name as name, p.type as type from (select id, min_by(struct_pack(name := name, type := type), dirty_name) as p from ({_LINKED}) group by id)")
def graph_nodes_entity(spark: SparkSession, d: str) -> DataFrame:
    """Entity nodes, once per id."""
    return graph.entity_nodes(entity_links(spark, d))


@query(f"""select distinct k as src, id as dst, 'MENTIONS' as type from (
    select {_AK} as k, {_CLEAN.format(c='x')} as n from (select docidentifier_normalized, unnest(string_split(allnames, ';')) as x from gdelt_article where docidentifier_normalized is not null)
    union select {_AK}, {_CLEAN.format(c='x')} from (select docidentifier_normalized, unnest(string_split(locations, ';')) as x from gdelt_article where docidentifier_normalized is not null)) join ({_LINKED}) on n = dirty_name""")
def graph_edges_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Article -> entity, through the entity map."""
    a = table(spark, d, "gdelt_article", "docidentifier_normalized", "allnames", "locations").withColumn("k", normal_key(F.col("docidentifier_normalized")))
    return graph.article_mentions(a, "k", {"names": F.split("allnames", ";"), "places": F.split("locations", ";")}, entity_links(spark, d))


def _tool(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two patterns of suppliers' edges, one with its chunk ids packed, one with an array."""
    li = table(spark, d, "lineitem", "l_suppkey", "l_linenumber", "l_returnflag", "l_orderkey", "l_partkey")
    packed = li.where("l_linenumber = 7 and l_returnflag = 'R'").select(F.col("l_suppkey").alias("source"), F.concat_ws("|", "l_orderkey", "l_partkey").alias("chunk_ids"))
    arrays = li.where("l_linenumber = 6").select(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("via"), F.array(F.col("l_partkey").cast("string")).alias("chunk_ids"))
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null").withColumn("id", F.col("doc_id").cast("string"))
    return graph.graph_tool([packed, arrays], docs, "id")


@query("select doc_id, length(text) as n from documents where text is not null and (doc_id in (select unnest([l_orderkey, l_partkey]) from lineitem where l_linenumber = 7 and l_returnflag = 'R') or doc_id in (select l_partkey from lineitem where l_linenumber = 6))")
def graph_tool(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the chunks that the rows of several statements name."""
    return _tool(spark, d)[1].select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("""select 0 as statement, '{"source":' || l_suppkey || '}' as row, [cast(l_orderkey as varchar), cast(l_partkey as varchar)] as chunk_ids from lineitem where l_linenumber = 7 and l_returnflag = 'R'
    union all select 1, '{"source":' || l_suppkey || ',"via":"' || l_returnflag || '"}', [cast(l_partkey as varchar)] from lineitem where l_linenumber = 6""")
def graph_tool_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of several statements in one table, with the chunk ids of both shapes."""
    return _tool(spark, d)[0]


_PAIR = "select globaleventid, lower(actor1name) as subject, lower(actor2name) as object, round(abs(cast(avgtone as double)) / 10, 6) as tone, round(abs(cast(goldsteinscale as double)) / 10, 6) as scale from gdelt_event where actor1name is not null and actor2name is not null and avgtone is not null and goldsteinscale is not null"


@query(f"select globaleventid, subject, case when scale > tone then 'weighs_on' else 'speaks_of' end as relation, object, greatest(scale, tone) as score from ({_PAIR}) where greatest(scale, tone) >= case when scale > tone then 0.7 else 0.3 end")
def relation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Likeliest relation of each pair of actors by a scorer, at a threshold of its own."""
    e = table(spark, d, "gdelt_event", "globaleventid", "actor1name", "actor2name", "avgtone", "goldsteinscale").dropna(subset=["actor1name", "actor2name", "avgtone", "goldsteinscale"])
    tenth = lambda c: F.round(F.abs(F.col(c).cast("double")) / 10, 6)
    pairs = e.select("globaleventid", F.lower("actor1name").alias("subject"), F.lower("actor2name").alias("object"), F.struct(tenth("avgtone").alias("tone"), tenth("goldsteinscale").alias("scale")).alias("text"))
    return graph.scored_relations(pairs, "globaleventid", "text", lambda s, o, t: {"speaks_of": t["tone"], "weighs_on": t["scale"]}, {"speaks_of": 0.3, "weighs_on": 0.7})


@query("select doc_id, sha256(concat(cast(doc_id as varchar), '|', '0')) as id from documents")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id").select("doc_id", chunk_id(F.col("doc_id"), F.lit(0)).alias("id"))
