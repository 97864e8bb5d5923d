"""References to records that do not exist, or not yet.

Method: keys are mapped to a uniform 64-bit space that is cut into equal
ranges; the parents of each range are stored as one row of sorted arrays;
references are brought to their range in bounded groups, probed there by
binary search as whole vectors, and the misses are classified.

Skew: a range whose references exceed ``group_rows`` (one hot key is enough)
is split by a salt of the reference id, and its parent row, bounded by
``range_keys``, is repeated once per salt. No group is larger than about
``group_rows`` references plus ``range_keys`` parents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship_package

CASE_SCHEMA = "ref_id bigint, ref_table string, reason string, period string"
REASONS = np.array(["", "missing", "deleted", "late"])


def month_of(ts: Column) -> Column:
    """yyyy-MM of a timestamp in UTC whatever the session's zone, 'unknown' for null."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("unknown"))


def references(df: DataFrame, ref_id: str, keys: dict[str, Column], at: Column) -> DataFrame:
    """(ref_id, ref_table, key, at, period) of each non-null reference; keys: ref_table -> key as string."""
    refs = F.explode(F.array(*[F.struct(F.lit(t).alias("ref_table"), k.cast("string").alias("key")) for t, k in keys.items()]))
    out = df.select(F.col(ref_id).alias("ref_id"), refs.alias("r"), F.unix_micros(at).alias("at"), month_of(at).alias("period"))
    return out.select("ref_id", "r.ref_table", "r.key", "at", "period").where("key is not null")


def parents(ref_table: str, df: DataFrame, key: Column, added: Column | None = None) -> DataFrame:
    """Rows (ref_table, key, added, there) of a parent table, or of withdrawn keys when added is None."""
    micros = F.lit(None).cast("bigint") if added is None else F.unix_micros(added)
    return df.select(F.lit(ref_table).alias("ref_table"), key.cast("string").alias("key"), micros.alias("added"), F.lit(added is not None).alias("there")).where("key is not null")


def _probe(parent: pa.Table, refs: pa.Table) -> pa.Table:
    at = refs["at"].combine_chunks()
    known_at = ~np.asarray(at.is_null())
    at = at.fill_null(0).to_numpy(zero_copy_only=False)
    h1, h2 = refs["h1"].to_numpy(), refs["h2"].to_numpy()
    status = np.ones(len(h1), dtype=np.int64)  # missing
    if parent.num_rows:
        k1, k2, first, there = (parent[c].combine_chunks().flatten() for c in ("k1", "k2", "first", "there"))
        k1, k2, there = k1.to_numpy(), k2.to_numpy(), there.to_numpy(zero_copy_only=False)
        dated = ~np.asarray(first.is_null())
        first = first.fill_null(0).to_numpy(zero_copy_only=False)
        place = np.searchsorted(k1, h1)
        open_ = np.arange(len(h1))
        while len(open_):  # more than one round only where two keys share their first 64 bits
            spot = place[open_]
            inside = spot < len(k1)
            open_, spot = open_[inside], spot[inside]
            same = k1[spot] == h1[open_]
            open_, spot = open_[same], spot[same]
            hit = k2[spot] == h2[open_]
            rows, spots = open_[hit], spot[hit]
            late = dated[spots] & known_at[rows] & (first[spots] > at[rows])
            status[rows] = np.where(there[spots], np.where(late, 3, 0), 2)
            open_ = open_[~hit]
            place[open_] += 1
    cases = np.flatnonzero(status)
    out = refs.select(["ref_id", "ref_table", "period"]).take(pa.array(cases))
    return pa.table({"ref_id": out["ref_id"], "ref_table": out["ref_table"], "reason": pa.array(REASONS[status[cases]], pa.string()), "period": out["period"]})


def orphan_references(refs: DataFrame, parent_rows: DataFrame, range_keys: int = 100_000, group_rows: int = 200_000) -> DataFrame:
    """Cases (ref_id, ref_table, reason, period) among ``refs``.

    reason: 'deleted' if no row has the key and a withdrawn key equals it,
    'missing' if neither, 'late' if rows have it but the earliest ``added`` of
    them is after ``at``. A null key is no reference; without ``at``, or when
    all ``added`` are null, nothing is late. Empty parents make every reference
    a case; empty references give no rows.
    """
    h1, h2 = F.xxhash64("ref_table", "key"), F.xxhash64("key", F.lit("second"), "ref_table")
    spark = refs.sparkSession
    ship_package(spark)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(parent_rows.count() / range_keys))
    width = 2**64 // ranges + 1
    # h1 is shifted to be non-negative in decimal space by halves: floor(h1 / width) with an offset
    place = F.floor(F.col("h1") / F.lit(float(width))).cast("int").alias("place")

    keyed = (
        parent_rows.select(h1.alias("h1"), h2.alias("h2"), "added", "there")
        .groupBy("h1", "h2")
        .agg(F.min("added").alias("first"), F.max("there").alias("there"))
    )
    arrays = (
        keyed.withColumn("place", place)
        .groupBy("place")
        .agg(F.sort_array(F.collect_list(F.struct("h1", "h2", "first", "there"))).alias("s"))
        .select("place", F.col("s.h1").alias("k1"), F.col("s.h2").alias("k2"), F.col("s.first").alias("first"), F.col("s.there").alias("there"))
    )
    probes = refs.select("ref_id", "ref_table", "at", "period", h1.alias("h1"), h2.alias("h2")).withColumn("place", place)
    salts = probes.groupBy("place").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("salts"))  # one row per range
    probes = probes.join(F.broadcast(salts), "place").withColumn("salt", F.pmod(F.xxhash64("ref_id"), F.col("salts")).cast("int")).drop("salts")
    arrays = arrays.join(F.broadcast(salts), "place").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return arrays.groupBy("place", "salt").cogroup(probes.groupBy("place", "salt")).applyInArrow(_probe, CASE_SCHEMA)


def orphan_report(cases: DataFrame) -> DataFrame:
    """Cases counted per table, period and reason."""
    return cases.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("n_refs"))
