"""Queries p5 and p6 over the packed-field and reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.urls import normal_key
from ..operators.orphans import orphan_references, orphan_report, parents, references
from ..operators.packed import Packed, unpack
from ..sources.tables import table

FIELDS = {
    "allnames": Packed(offset=True),
    "enhancedthemes": Packed(offset=True),
    "locations": Packed(tuples=True),
    "gcam": Packed(separators=r";|\t,"),
}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack(table(spark, sf_dir, "gdelt_article", "gkgrecordid", *FIELDS), "gkgrecordid", FIELDS).distinct()


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    mention = table(spark, sf_dir, "gdelt_mention", "mentionid", "globaleventid", "mentionidentifier_normalized", "mentiontimedate")
    article = table(spark, sf_dir, "gdelt_article", "docidentifier_normalized", "dateadded")
    event = table(spark, sf_dir, "gdelt_event", "globaleventid", "dateadded")
    gone = table(spark, sf_dir, "deleted_key", "ref_table", "key_value")
    key = normal_key(F.col("mentionidentifier_normalized"))
    refs = references(mention, "mentionid", {"event": F.col("globaleventid"), "article": key}, F.col("mentiontimedate"))
    rows = [
        parents("event", event, F.col("globaleventid"), F.col("dateadded")),
        parents("article", article, normal_key(F.col("docidentifier_normalized")), F.col("dateadded")),
        parents("event", gone.where("ref_table = 'event'"), F.expr("try_cast(key_value as bigint)")),
        parents("article", gone.where("ref_table = 'article'"), normal_key(F.col("key_value"))),
    ]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return orphan_references(refs, every)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).withColumnRenamed("ref_id", "mentionid")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_cases(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p6_found": p6_found, "p6_report": p6_report}


def _p5_sql() -> str:
    one = """
    select gkgrecordid, '{f}' as field_name, item, row_number() over (partition by rid order by place) as pos from (
      select rid, gkgrecordid, place, {clean} as item from (
        select rid, gkgrecordid, unnest(vals) as v, generate_subscripts(vals, 1) as place from (
          select row_number() over () as rid, gkgrecordid, regexp_extract_all({f}, '(?:"[^"]*"|[^"{sep}])+') as vals
          from gdelt_article where {f} is not null and trim({f}) not in ('', 'nan', 'None', '<NA>'))))
    where item <> ''"""
    unq = "case when regexp_full_match({v}, '\"(?:[^\"]|\"\")*\"') then trim(replace(substr({v}, 2, length({v}) - 2), '\"\"', '\"')) else {v} end"
    cut = "trim(regexp_replace(trim(v), ',[0-9]+$', ''))"
    tup = "case when contains(trim(v), '#') then trim(trim(split_part(trim(v), '#', 2)), '\"') else " + unq.format(v="trim(v)") + " end"
    parts = [
        one.format(f="allnames", sep=";|\\t", clean=unq.format(v=cut)),
        one.format(f="enhancedthemes", sep=";|\\t", clean=unq.format(v=cut)),
        one.format(f="locations", sep=";|\\t", clean=tup),
        one.format(f="gcam", sep=";|\\t,", clean=unq.format(v="trim(v)")),
    ]
    return "select distinct gkgrecordid, field_name, pos, item from (" + " union all ".join(parts) + ")"


_NORMAL = "regexp_replace(regexp_replace(trim(lower({c})), '^https?://', ''), '/$', '')"
_P6 = f"""
with refs as (
  select mentionid, 'event' as ref_table, cast(globaleventid as varchar) as k, mentiontimedate as seen from gdelt_mention
  union all
  select mentionid, 'article', {_NORMAL.format(c='mentionidentifier_normalized')}, mentiontimedate from gdelt_mention),
par as (
  select 'event' as ref_table, cast(globaleventid as varchar) as k, min(dateadded) as added from gdelt_event group by all
  union all
  select 'article', {_NORMAL.format(c='docidentifier_normalized')} as k, min(dateadded) from gdelt_article group by all),
gone as (
  select distinct ref_table, case when ref_table = 'event' then key_value else {_NORMAL.format(c='key_value')} end as k from deleted_key),
cases as (
  select mentionid, refs.ref_table,
    case when par.k is not null then case when added > seen then 'late' end when gone.k is not null then 'deleted' else 'missing' end as reason,
    coalesce(strftime(seen at time zone 'UTC', '%Y-%m'), 'unknown') as period
  from refs left join par using (ref_table, k) left join gone using (ref_table, k) where refs.k is not null)
"""
ORACLE = {
    "p5_found": _p5_sql(),
    "p6_found": _P6 + "select mentionid, ref_table, reason, period from cases where reason is not null",
    "p6_report": _P6 + "select ref_table, period, reason, count(*) as n_refs from cases where reason is not null group by all",
}
