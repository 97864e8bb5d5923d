"""Queries of the stores and of the evaluation: indexes, payloads, filters of generated and judged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fields
from ..functions.urls import normal_key
from ..operators import graph, retrieve
from ..operators.quality import existing
from ..operators.relational import seeded_sample
from ..sources.files import todo_files
from ..sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(r"select term, count(*) as df, cast(sum(tf) as bigint) as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from documents where text is not null) group by all) group by term")
def text_index_terms(spark: SparkSession, d: str) -> DataFrame:
    """All terms of the lexical index."""
    postings, _ = retrieve.text_index(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(r"select doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as dl from documents where text is not null")
def text_index_lengths(spark: SparkSession, d: str) -> DataFrame:
    _, lengths = retrieve.text_index(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return lengths.select("doc_id", F.col("dl").cast("bigint").alias("dl"))


@query()
def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all texts by the stand-in encoder."""
    return retrieve.embed(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query("select vec_id as id, label, round(cast(embedding[1] as double), 6) as first, len(embedding) as dim from embeddings")
def payload_extract(spark: SparkSession, d: str) -> DataFrame:
    """Fields of nested points (id, vector, payload)."""
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.struct("label").alias("payload"))
    return points.select("id", "payload.label", F.round(F.col("vector")[0].cast("double"), 6).alias("first"), F.size("vector").cast("bigint").alias("dim"))


_MARKERS = ("expected that", "would not comment", "remains unclear")


@query("select item_id, list_filter(gold_contexts, lambda x: not (contains(x, 'expected that') or contains(x, 'would not comment') or contains(x, 'remains unclear'))) as contexts from eval_item where gold_contexts is not null")
def context_filter(spark: SparkSession, d: str) -> DataFrame:
    """Contexts without those that hold a marker."""
    bad = lambda x: F.contains(x, F.lit(_MARKERS[0])) | F.contains(x, F.lit(_MARKERS[1])) | F.contains(x, F.lit(_MARKERS[2]))
    return table(spark, d, "eval_item", "item_id", "gold_contexts").where("gold_contexts is not null").select("item_id", F.filter("gold_contexts", lambda x: ~bad(x)).alias("contexts"))


@query("select vec_id, coalesce(cast(embedding[1] as double), 0) < 0.05 as unfit, coalesce(cast(embedding[1] as double), 0) < 0.5 as poor from embeddings where coalesce(cast(embedding[1] as double), 0) < 0.5 or coalesce(cast(embedding[2] as double), 0) < 0.05")
def failure_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose scores, nulls as 0, stay under the limits."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    a, b = (F.coalesce(F.col("embedding")[i].cast("double"), F.lit(0.0)) for i in (0, 1))
    return e.where((a < 0.5) | (b < 0.05)).select("vec_id", (a < 0.05).alias("unfit"), (a < 0.5).alias("poor"))


_OUTER = r"[\t-\r\x{85}\p{Z}]+"


@query(rf"select doc_id, list_transform(list_filter(list_transform(string_split(regexp_replace(text, '```[A-Za-z]*', '', 'g'), ';'), lambda x: regexp_replace(x, '^{_OUTER}|{_OUTER}$', '', 'g')), lambda x: regexp_matches(upper(x), 'MATCH|RETURN|CALL')), lambda x: md5(x)) as statements from documents where text is not null")
def generated_statements(spark: SparkSession, d: str) -> DataFrame:
    """Parts of every text that would count as graph statements, as the tool that reads generated text sees them."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return t.select("doc_id", F.transform(fields.graph_statements(F.col("text")), lambda x: F.md5(x)).alias("statements"))


@query("select event_id, regexp_extract(props, '(\\{.*\\})', 1, 's') as body, cast(json_extract(regexp_extract(props, '(\\{.*\\})', 1, 's'), '$.k') as bigint) as parsed from events")
def generated_json(spark: SparkSession, d: str) -> DataFrame:
    """The JSON object inside a text field, parsed."""
    t = table(spark, d, "events", "event_id", "props").select("event_id", fields.json_span(F.col("props")).alias("body"))
    return t.select("event_id", "body", F.from_json("body", "k bigint")["k"].alias("parsed"))


@query("select sha256(concat(cast(doc_id as varchar), '|', '0')) as id, doc_id, url, title, strftime(published_at at time zone 'UTC', '%Y-%m-%d') as date, length(text) as n from documents where text <> ''")
def text_index_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the text index stores of each text: under its chunk id, with address, title and day."""
    t = table(spark, d, "documents", "doc_id", "url", "title", "published_at", "text").where("text <> ''")
    return t.select(fields.chunk_id(F.col("doc_id"), F.lit(0)).alias("id"), "doc_id", "url", "title", F.date_format("published_at", "yyyy-MM-dd").alias("date"), F.length("text").cast("bigint").alias("n"))


@query("select vec_id as id, label, substr(text, 1, 200) as preview, cast(0 as integer) as number from embeddings join documents on vec_id = doc_id where len(embedding) = 64 and text is not null")
def vector_collection(spark: SparkSession, d: str) -> DataFrame:
    """Points of a vector collection: dimension checked, one per key, with the payload of record and chunk."""
    v, t = table(spark, d, "embeddings", "vec_id", "embedding", "label"), table(spark, d, "documents", "doc_id", "text").where("text is not null")
    rows = v.join(t, F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("id"), "embedding", fields.payload(F.col("label"), chunk=F.col("text"), number=F.lit(0)).alias("payload"))
    points = retrieve.collection(rows, "id", "embedding", 64)
    return points.select("id", "payload.label", F.col("payload.original_text_preview").alias("preview"), F.col("payload.chunk_number").alias("number"))


@query("select doc_id from documents where replace(url, '/', '__') not in (select replace(docidentifier_original, '/', '__') from gdelt_article where docidentifier_original is not null) and url is not null")
def todo_minus_done(spark: SparkSession, d: str) -> DataFrame:
    """Addresses not yet processed, under either spelling of their name."""
    done = table(spark, d, "gdelt_article", "docidentifier_original").where("docidentifier_original is not null")
    done = done.select(fields.stored_name(F.col("docidentifier_original")).alias("url")).distinct()
    return todo_files(table(spark, d, "documents", "doc_id", "url").where("url is not null"), done, "url").select("doc_id")


@query("select distinct regexp_replace(regexp_replace(trim(lower(url)), '^https?://', ''), '/$', '') as k from documents where text is null or length(text) < 150 order by k")
def problem_urls(spark: SparkSession, d: str) -> DataFrame:
    """Sorted keys of documents without a usable text."""
    t = table(spark, d, "documents", "url", "text").where("text is null or length(text) < 150")
    return t.select(normal_key(F.col("url")).alias("k")).distinct().orderBy("k")


@query("select site_name, country from news_site")
def existing_columns(spark: SparkSession, d: str) -> DataFrame:
    """Of the wanted columns those that the table has."""
    return existing(table(spark, d, "news_site"), "site_name", "country", "no_such_column")


@query("select globaleventid, source_id, relation, target_id from (select globaleventid, lower(actor1name) as source_id, 'acts_on' as relation, lower(actor2name) as target_id from gdelt_event where actor1name is not null and actor2name is not null and actor1name <> actor2name) group by all")
def semantic_relations(spark: SparkSession, d: str) -> DataFrame:
    """Typed relations between the two actors of an event, both ends named."""
    e = table(spark, d, "gdelt_event", "globaleventid", "actor1name", "actor2name").where("actor1name is not null and actor2name is not null and actor1name <> actor2name")
    return e.select("globaleventid", F.lower("actor1name").alias("source_id"), F.lit("acts_on").alias("relation"), F.lower("actor2name").alias("target_id")).distinct()


@query("select source_id, target_id, relation, max(score) as max_score, count(*) as weight, array_to_string(list_slice(list_transform(list_sort(list_distinct(list(cast(chunk as varchar)))), lambda x: x), 1, 20), '|') as chunk_ids from (select lower(actor1name) as source_id, lower(actor2name) as target_id, 'acts_on' as relation, 1.0::double as score, globaleventid as chunk from gdelt_event where actor1name is not null and actor2name is not null) group by 1, 2, 3")
def relation_super_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "gdelt_event", "globaleventid", "actor1name", "actor2name").where("actor1name is not null and actor2name is not null")
    rows = e.select(F.lower("actor1name").alias("source_id"), F.lower("actor2name").alias("target_id"), F.lit("acts_on").alias("relation"), F.lit(1.0).alias("score"), F.col("globaleventid").cast("string").alias("chunk_id"))
    return graph.super_edges(rows)


@query("select doc_id, length(text) as n from (select doc_id, text from documents where text is not null and length(text) >= 300 order by md5(concat(cast(doc_id as varchar), 'facts')), doc_id limit 150)")
def fact_sample(spark: SparkSession, d: str) -> DataFrame:
    """150 long enough texts by a seeded hash (a sampling operator)."""
    t = table(spark, d, "documents", "doc_id", "text").where("length(text) >= 300").select("doc_id", F.length("text").cast("bigint").alias("n"))
    return seeded_sample(t, "doc_id", 150, "facts")
