"""Several values packed in one field: one row per value with its place.

Method: split on quote characters; odd pieces are literals, even pieces are
split on the separators, and an array fold reassembles the values in order.
Everything is a built-in expression, so the plan is scan -> project ->
generate without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

PLACEHOLDERS = ("nan", "None", "<NA>")


@dataclass(frozen=True)
class Packed:
    """How a field is packed. separators: body of a regex class; offset: ',digits' ends a value; tuples: '#' tuples count by part 2."""

    separators: str = r";|\t"
    offset: bool = False
    tuples: bool = False


def fold_values(c: Column, separators: str) -> Column:
    """Raw values of a packed string, quotes still on them; an unclosed quote reaches to the end."""
    pieces = F.split(c, '"', -1)
    step = lambda acc, x: F.when(
        x["i"] % 2 == 1,
        F.struct(
            acc["done"].alias("done"),
            F.concat(acc["cur"], F.lit('"'), x["p"], F.lit('"')).alias("cur"),
        ),
    ).otherwise(
        F.struct(
            F.concat(acc["done"], F.when(F.size(x["v"]) > 1, F.concat(F.array(F.concat(acc["cur"], x["v"][0])), F.slice(x["v"], 2, F.greatest(F.size(x["v"]) - 2, F.lit(0))))).otherwise(F.array().cast("array<string>"))).alias("done"),
            F.when(F.size(x["v"]) > 1, F.element_at(x["v"], -1)).otherwise(F.concat(acc["cur"], x["p"])).alias("cur"),
        )
    )
    parts = F.transform(pieces, lambda p, i: F.struct(i.alias("i"), p.alias("p"), F.split(p, f"[{separators}]", -1).alias("v")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    folded = F.aggregate(parts, start, step)
    cur = F.when(F.size(pieces) % 2 == 0, F.substr(folded["cur"], F.lit(1), F.length(folded["cur"]) - 1)).otherwise(folded["cur"])  # the last quote was never closed
    folded = F.concat(folded["done"], F.array(cur))
    # most fields carry no quote at all: one split is the whole fold then
    return F.when(F.contains(c, F.lit('"')), folded).otherwise(F.split(c, f"[{separators}]", -1))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _unquoted(c: Column) -> Column:
    """Enclosing quotes dropped, doubled ones inside made one."""
    inner = F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.when(F.startswith(c, F.lit('"')), F.when(c.rlike(r'^"(?:[^"]|"")*"$'), _bare(inner)).otherwise(c)).otherwise(c)


def clean_value(c: Column, how: Packed) -> Column:
    v = _bare(c)
    if how.offset:
        v = _bare(F.regexp_replace(v, r",[0-9]+$", ""))
    v = _unquoted(v)
    if how.tuples:
        second = F.regexp_extract(v, r'^[^#"]*#("(?:[^"]|"")*"|[^#]*)', 1)
        v = F.when(F.contains(v, F.lit("#")) & v.rlike(r'^[^#"]*#'), _unquoted(_bare(second))).otherwise(v)
    return v


def packed_values(c: Column, how: Packed) -> Column:
    """array<string> of the counted values in order; null, blank and placeholder fields give none."""
    none = c.isNull() | _bare(c).isin("", *PLACEHOLDERS)
    values = F.filter(F.transform(fold_values(c, how.separators), lambda v: clean_value(v, how)), lambda v: v != "")
    return F.when(none, F.array().cast("array<string>")).otherwise(values)


def unpack(df: DataFrame, key: str, fields: dict[str, Packed]) -> DataFrame:
    """One row (key, field_name, pos, item) per value of each field.

    pos counts the values of the field from 1; blank values do not count,
    repeated ones do. Null keys are kept as they are. An empty table gives no
    rows; other columns of df, whatever their names, are not read.
    """
    packed = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), packed_values(F.col(f), how).alias("items")) for f, how in fields.items()]))
    rows = df.select(F.col(key), packed.alias("_f"))
    rows = rows.select(key, F.col("_f.field_name").alias("field_name"), F.posexplode("_f.items").alias("_p", "item"))
    return rows.select(key, "field_name", (F.col("_p") + 1).cast("bigint").alias("pos"), "item")
