"""Property graph as node and edge tables; patterns are joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fields import entity_name, slug


def merge_nodes(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One node per key; properties of the row with the greatest ``at`` (a total order)."""
    others = [c for c in rows.columns if c not in (key, at)]
    picked = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.col(at)).alias("_p"))
    return picked.select(key, *[F.col(f"_p.{c}").alias(c) for c in others])


def edges(df: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
    """Distinct (src, dst, type), dangling nulls dropped."""
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type")).where("src is not null and dst is not null").distinct()


def dirty_entities(events: DataFrame, actor_columns: list[str], place_columns: list[str], articles: DataFrame, lists: dict[str, tuple[Column, str]]) -> DataFrame:
    """Distinct (name, tag) of the event columns and of the exploded article lists; cleaned, longer than two characters."""
    cells = [F.struct(entity_name(F.col(c)).alias("name"), F.lit("ACTOR_OR_LOCATION").alias("tag")) for c in actor_columns]
    cells += [F.struct(entity_name(F.col(c)).alias("name"), F.lit("LOCATION").alias("tag")) for c in place_columns]
    parts = [events.select(F.explode(F.array(*cells)).alias("e")).select("e.*")]
    for _, (items, tag) in lists.items():
        parts.append(articles.select(F.explode(items).alias("x")).select((F.col("x") if tag == "THEME" else entity_name(F.col("x"))).alias("name"), F.lit(tag).alias("tag")))
    return reduce(DataFrame.unionByName, parts).where("name is not null").distinct()


def link_entities(dirty: DataFrame, known: DataFrame, preference: tuple[str, ...] = ("LOCATION", "THEME", "ACTOR_OR_LOCATION", "UNKNOWN")) -> DataFrame:
    """(dirty_name, id, name, type, source): the known entry of a name, else one made of its tag.

    known(dirty_name, id, name, type). A name with several tags counts as the first of ``preference``.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("tag"))
    tagged = dirty.groupBy("name").agg(F.min_by("tag", rank).alias("tag"))
    kind = F.when(F.col("tag") == "THEME", "Theme").when(F.col("tag") == "LOCATION", "Location").otherwise("Actor")
    made = F.when(F.col("tag") == "THEME", F.concat(F.lit("theme:"), slug(F.col("d.name")))).otherwise(F.concat(F.lit("custom:"), F.lower(kind), F.lit(":"), slug(F.col("d.name"))))
    out = tagged.alias("d").join(known.alias("k"), F.col("d.name") == F.col("k.dirty_name"), "left")
    return out.select(
        F.col("d.name").alias("dirty_name"), F.coalesce("k.id", made).alias("id"), F.coalesce("k.name", "d.name").alias("name"),
        F.coalesce("k.type", kind).alias("type"), F.when(F.col("k.id").isNotNull(), "wikidata").otherwise("custom").alias("source"),
    )


def good_entities(entities: DataFrame, types: list[str], stop: list[str], acronyms: list[str]) -> DataFrame:
    """Entries from the knowledge base, of the types, neither stop words nor too short unless known acronyms."""
    name = F.lower("name")
    return entities.where(
        (F.col("source") == "wikidata") & ~F.startswith("id", F.lit("custom:")) & F.col("type").isin(types)
        & ~name.isin(stop) & ~F.lower("dirty_name").isin(stop) & ((F.length("name") > 2) | F.col("name").isin(acronyms))
    )


def canonical(entities: DataFrame, order: str) -> DataFrame:
    """(name, id) by lower-cased name; the last entry in order wins."""
    return entities.groupBy(F.lower("name").alias("name")).agg(F.max_by("id", order).alias("id"))


def entity_pairs(chunks: DataFrame, chunk: str, names: str) -> DataFrame:
    """(chunk, subject, object): ordered pairs of different names of one chunk's list.

    Pairs are made inside the row, one subject after another: no join, and no
    array longer than the list.
    """
    c = chunks.select(F.col(chunk), F.array_distinct(names).alias("names"))
    c = c.select(chunk, "names", F.explode("names").alias("subject"))
    return c.select(chunk, "subject", F.explode(F.filter("names", lambda b: b != F.col("subject"))).alias("object"))


def valid_triples(triples: DataFrame, relations: list[str]) -> DataFrame:
    """Triples (subject, relation, object) with both ends and a known relation, distinct."""
    ends = (F.coalesce(F.trim("subject"), F.lit("")) != "") & (F.coalesce(F.trim("object"), F.lit("")) != "")
    return triples.where(ends & F.col("relation").isin(relations)).distinct()


def super_edges(relations: DataFrame, keep: int = 20) -> DataFrame:
    """(source_id, target_id, relation, max_score, weight, chunk_ids): best distinct chunks by score, then id.

    Weight and maximum are combinable sums of the distinct chunks; the ranked
    branch is cut to ``keep`` rows a group before it is moved, so that no task
    holds or sorts all chunks of a hot edge.
    """
    group = ["source_id", "target_id", "relation"]
    per_chunk = relations.groupBy(*group, "chunk_id").agg(F.max("score").alias("score"), F.count("chunk_id").alias("n"))
    whole = per_chunk.groupBy(*group).agg(F.max("score").alias("max_score"), F.sum("n").alias("weight"))
    w = Window.partitionBy(*group).orderBy(F.desc("score"), "chunk_id")
    best = per_chunk.where("chunk_id is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
    best = best.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("r", "chunk_id"))).alias("l"))
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    out = whole.alias("w").join(best.alias("b"), reduce(lambda x, y: x & y, same), "left")
    return out.select(*[F.col(f"w.{c}").alias(c) for c in group], "max_score", "weight", F.coalesce(F.array_join(F.transform("l", lambda x: x["chunk_id"]), "|"), F.lit("")).alias("chunk_ids"))


def attached(edge_rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select(F.col(key).alias("_n"))
    out = edge_rows.join(ids, edge_rows["src"] == F.col("_n"), "left_semi")
    return out.join(ids, out["dst"] == F.col("_n"), "left_semi")


def one_hop(edge_rows: DataFrame, nodes: DataFrame, key: str, where_source: Column, where_target: Column, limit: int = 50, types: list[str] | None = None, banned: list[str] | None = None) -> DataFrame:
    """Neighbours (source, type, target) of the matching nodes, at most ``limit`` in order of names.

    Only edges of ``types``, if given; no node whose lower-cased name is banned.
    """
    allowed = ~F.lower("name").isin(banned) if banned else F.lit(True)
    s = nodes.where(where_source & allowed).select(F.col(key).alias("src"), F.col("name").alias("source"))
    t = nodes.where(where_target & allowed).select(F.col(key).alias("dst"), F.col("name").alias("target"))
    rows = edge_rows.where(F.col("type").isin(types)) if types else edge_rows
    return rows.join(s, "src").join(t, "dst").select("source", "type", "target").orderBy("source", "type", "target").limit(limit)


def article_mentions(articles: DataFrame, key: str, names: dict[str, Column], known: DataFrame) -> DataFrame:
    """Edges article -> entity (MENTIONS) through the entity map known(dirty_name, id): distinct names of the packed fields."""
    parts = [articles.select(F.col(key).alias("k"), F.explode(c).alias("n")).select("k", entity_name(F.col("n")).alias("n")) for c in names.values()]
    found = reduce(DataFrame.unionByName, parts).where("n is not null and k is not null").distinct()
    return edges(found.join(known.select(F.col("dirty_name").alias("n"), "id"), "n"), F.col("k"), F.col("id"), "MENTIONS")


def entity_nodes(links: DataFrame) -> DataFrame:
    """(id, name, type) once per id: of the first of its dirty names."""
    return links.groupBy("id").agg(F.min_by(F.struct("name", "type"), "dirty_name").alias("p")).select("id", "p.name", "p.type")


def run_statements(statements: list[DataFrame]) -> DataFrame:
    """Rows of several pattern queries in one table: (statement from 0, row as JSON, chunk_ids); ids from an array or a '|' text."""
    parts = []
    for i, d in enumerate(statements):
        kind = dict(d.dtypes).get("chunk_ids")
        ids = F.col("chunk_ids") if kind == "array<string>" else F.split("chunk_ids", r"\|") if kind else F.array().cast("array<string>")
        shown = [F.col(c) for c in d.columns if c != "chunk_ids"]
        parts.append(d.select(F.lit(i).alias("statement"), F.to_json(F.struct(*shown)).alias("row"), F.filter(ids, lambda x: x != "").alias("chunk_ids")))
    return reduce(DataFrame.unionByName, parts)


def graph_tool(statements: list[DataFrame], chunks: DataFrame, chunk: str) -> tuple[DataFrame, DataFrame]:
    """(the rows of all statements, the texts of the chunks they name, once each)."""
    rows = run_statements(statements)
    wanted = rows.select(F.explode("chunk_ids").alias(chunk)).distinct()
    return rows, chunks.join(wanted, chunk, "left_semi")


def scored_relations(pairs: DataFrame, chunk: str, text: str, scorer: Callable[[Column, Column, Column], dict[str, Column]], thresholds: dict[str, float], default: float = 0.6) -> DataFrame:
    """(chunk, subject, relation, object, score) of pairs(chunk, subject, object, text): the likeliest relation of each, from its own threshold on.

    The scorer gives a column per relation for subject, object and text; a
    relation's threshold is its entry or the default. Ties go to the earlier name.
    """
    scores = scorer(F.col("subject"), F.col("object"), F.col(text))
    best = F.array_max(F.array(*[F.struct(s.cast("double").alias("score"), F.lit(-i).alias("i"), F.lit(r).alias("relation")) for i, (r, s) in enumerate(sorted(scores.items()))]))
    out = pairs.select(chunk, "subject", "object", best.alias("b")).select(chunk, "subject", F.col("b.relation").alias("relation"), "object", F.col("b.score").alias("score"))
    least = F.coalesce(*[F.when(F.col("relation") == r, F.lit(t)) for r, t in thresholds.items()], F.lit(default))
    return out.where(F.col("score") >= least)


def bridge(rows: DataFrame, ids: str, chunks: DataFrame, chunk: str) -> DataFrame:
    """Texts of the chunk ids packed in rows ('|'), found ones only."""
    wanted = rows.select(F.explode(F.split(ids, r"\|")).alias(chunk)).distinct()
    return chunks.join(wanted, chunk)
