"""Queries of the text problems and the SQL equivalents of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from . import bpe, langid, leak, mojibake, neardup, sitelines, splitting


def _texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text", *more)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(_texts(spark, sf_dir), "doc_id", "text", 0.5)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.version_groups(_texts(spark, sf_dir), "doc_id", "text", 0.5)


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(_texts(spark, sf_dir), "doc_id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("piece_no = 2").select("doc_id")


def _site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.site_lines(_texts(spark, sf_dir, "url"), "doc_id", "text", "url", table(spark, sf_dir, "news_site", "domain"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.repeated_lines(_site_lines(spark, sf_dir))


def p3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.repeated_blocks(_site_lines(spark, sf_dir))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, sites = _texts(spark, sf_dir, "url"), table(spark, sf_dir, "news_site", "domain")
    blocks = sitelines.repeated_blocks(_site_lines(spark, sf_dir))
    return sitelines.without_lines(docs, "doc_id", "text", "url", sites, blocks)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir, "lang")
    return langid.wrong_labels(docs, "doc_id", "text", "lang", langid.train(docs, "doc_id", "text", "lang"))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir, "lang")
    model = langid.train(docs, "doc_id", "text", "lang")
    return langid.segments(langid.every_line_language(docs, "doc_id", "text", model))


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir, "lang")
    model = langid.train(docs, "doc_id", "text", "lang")
    return langid.document_languages(langid.every_line_language(docs, "doc_id", "text", model))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(_texts(spark, sf_dir), "doc_id", "text")


def _tiles(spark: SparkSession, sf_dir: str, min_words: int = 13, coverage: float = 0.0) -> DataFrame:
    items = table(spark, sf_dir, "eval_item", "item_id", "ground_truth", "gold_contexts")
    passages = F.concat(F.array("ground_truth"), F.coalesce("gold_contexts", F.array().cast("array<string>")))
    return leak.tiles(_texts(spark, sf_dir), "doc_id", "text", items.select("item_id", passages.alias("passages")), min_words, coverage=coverage)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of which half or more is in a text, in tiles of five words or more and any order."""
    return leak.leaks(_tiles(spark, sf_dir, leak.LEAK_WORDS, leak.COVERAGE))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(_texts(spark, sf_dir, "source"), "doc_id", "text", "source")[0].select("doc_id")


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir, "source")
    return mojibake.repairs(docs, "doc_id", "text", "source")


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_blocks": p3_blocks,
    "p3_clean": p3_clean,
    "p4_found": p4_found,
    "p4_segments": p4_segments,
    "p4_languages": p4_languages,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
    "p9_repaired": p9_repaired,
}
_W = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"
ORACLE = {
    "p1_found": f"""
with w as (select doc_id, {_W.format(c='text')} as w from documents where text is not null),
s as (select doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as g from w where len(w) > 0),
u as (select distinct doc_id, g from s),
n as (select doc_id, count(*) as n from u group by doc_id),
c as (select a.doc_id as doc_id_a, b.doc_id as doc_id_b, count(*) as k from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by all)
select doc_id_a, doc_id_b from c join n a on a.doc_id = doc_id_a join n b on b.doc_id = doc_id_b where k >= 0.5 * (a.n + b.n - k)""",
    "p2_found": "select doc_id from documents where length(text) > 1000",
    "p3_found": r"""
with d as (select doc_id, text, (select max_by(domain, length(domain)) from news_site where h = domain or ends_with(h, '.' || domain)) as site
  from (select doc_id, text, lower(regexp_replace(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), ':\d*$', '')) as h from documents where text is not null and url is not null)),
l as (select doc_id, site, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from d where site is not null),
e as (select doc_id, site, line_no, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[ \t\r]+', ' ', 'g')) as form from l where regexp_matches(line, '\p{L}')),
c as (select site, form from e group by all having count(distinct doc_id) >= 5)
select doc_id, line_no from e join c using (site, form)""",
    "p8_found": f"""
with p as (select item_id, unnest(list_concat([ground_truth], coalesce(gold_contexts, []))) as t from eval_item),
pw as (select item_id, {_W.format(c='t')} as w from p where t is not null),
pg as (select distinct item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) as g from pw where len(w) >= 13),
dw as (select doc_id, {_W.format(c='text')} as w from documents where text is not null),
dg as (select doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) as g from dw where len(w) >= 13)
select distinct doc_id, item_id from dg join pg using (g)""",
}
ORACLE["p1_groups"] = f"""
with recursive w as (select doc_id, {_W.format(c='text')} as w from documents where text is not null),
s as (select doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as g from w where len(w) > 0),
f as (select doc_id, md5(string_agg(g, '|' order by g)) as form, count(*) as n from (select distinct doc_id, g from s) group by doc_id),
m as (select doc_id, n, min(doc_id) over (partition by form) as class_id from f),
u as (select distinct s.doc_id, g from s join m on m.doc_id = s.doc_id and m.class_id = s.doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by all),
p as (select a, b from c join m x on x.doc_id = a join m y on y.doc_id = b where k >= 0.5 * (x.n + y.n - k)),
e as (select a, b from p union all select b, a from p),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
low as (select a, least(a, min(b)) as root from r group by a),
deg as (select a, count(*) as n from e group by a)
select doc_id, class_id, coalesce(root, class_id) as group_id, coalesce(deg.n, 0) as n_links from m left join low on low.a = class_id left join deg on deg.a = class_id"""
ORACLE["p3_clean"] = f"""
with f as ({ORACLE['p3_found']}), g as (select doc_id, list(line_no) as gone from f group by doc_id)
select doc_id, case when gone is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(gone, i)), chr(10)) end as text
from documents left join g using (doc_id)"""
