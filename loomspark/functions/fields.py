"""Field clean-up of event and article records, as Catalyst expressions unless noted."""

from __future__ import annotations

import ast
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

# fixed values: root codes of the event taxonomy and their labels
EVENT_ROOTS = {
    "01": "make public statement", "02": "appeal", "03": "express intent to cooperate", "04": "consult",
    "05": "engage in diplomatic cooperation", "06": "engage in material cooperation", "07": "provide aid", "08": "yield",
    "09": "investigate", "10": "demand", "11": "disapprove", "12": "reject", "13": "threaten", "14": "protest",
    "15": "exhibit force posture", "16": "reduce relations", "17": "coerce", "18": "assault", "19": "fight",
    "20": "use unconventional mass violence",
}
# fixed values: prefixes that a theme code loses before it is shown
THEME_PREFIX = (
    r"^(WB_\d+_|UNGP_|USPEC_|CRISISLEX_[A-Z0-9]*_|EPU_|TAX_FNCACT_|TAX_AIDGROUPS_|TAX_SPECIAL_ISSUES_|TAX_SPECIAL_|TAX_|SOC_|GEN_|SLFID_|INFO_|ETH_"
    r"|CRM_|ACT_|REL_|MIL_|MED_|AVIATION_|TECH_|RAIL_|EMERG_)"
)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """White space runs as one space, outer ones removed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def first_number(c: Column) -> Column:
    """First comma part as a double, null when it is none."""
    return F.get(F.split(c, ","), F.lit(0)).try_cast("double")


def list_labels(c: Column, sep: str = ";") -> Column:
    """Parts before their first comma, empty parts dropped, first occurrence kept, joined again."""
    parts = F.transform(F.filter(F.split(c, sep), lambda x: x != ""), lambda x: F.get(F.split(x, ","), F.lit(0)))
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), sep)


def location_names(c: Column) -> Column:
    """Second part of each '#' tuple, distinct and sorted, joined by ';'."""
    names = F.transform(F.split(c, ";"), lambda x: F.try_element_at(F.split(x, "#"), F.lit(2)))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))), ";")


def merged_names(*cs: Column) -> Column:
    """Sorted distinct names joined by ';', null when there is none."""
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*cs), lambda x: x.isNotNull() & (x != "")))), ";"), F.lit(""))


def event_root_label(c: Column) -> Column:
    """Label of a numeric root code (its first two digits), other codes in lower case."""
    out = F.when(~c.rlike("^[0-9]+$"), F.lower(c))
    for code, label in EVENT_ROOTS.items():
        out = out.when(F.substring(c, 1, 2) == code, label)
    return out.otherwise(F.lower(c))


def theme_label(c: Column) -> Column:
    """Readable label of one theme code."""
    bare = F.regexp_replace(F.regexp_replace(c, THEME_PREFIX, ""), r"^[0-9A-Z]+_\d+_", "")
    return F.lower(F.trim(F.replace(bare, F.lit("_"), F.lit(" "))))


def theme_category(c: Column, rules: dict[str, list[str]]) -> Column:
    """First category of rules, in order, with a keyword inside the code; else 'unclassified'."""
    out = F.coalesce(*[F.when(c.rlike("|".join(f"\\Q{k}\\E" for k in words)), F.lit(cat)) for cat, words in rules.items()], F.lit("unclassified"))
    return out


def theme_categories(c: Column, rules: dict[str, list[str]], sep: str = ";") -> Column:
    """Sorted distinct categories of a packed theme field joined by '; '; null for an empty field."""
    codes = F.filter(F.split(c, sep), lambda x: (x != "") & (x != "<NA>"))
    cats = F.array_sort(F.array_distinct(F.transform(codes, lambda x: theme_category(x, rules))))
    return F.when(c != "", F.array_join(cats, "; "))


def theme_labels(c: Column, sep: str = ";") -> Column:
    codes = F.filter(F.split(c, sep), lambda x: (x != "") & (x != "<NA>"))
    return F.when(c != "", F.array_join(F.transform(codes, theme_label), "; "))


def slug(c: Column) -> Column:
    """Identifier text: lower case, white space to '_', other signs dropped; 'unknown' for nothing."""
    s = F.regexp_replace(F.regexp_replace(trimmed(F.lower(c)), r"(?U)\s+", "_"), r"(?U)[^\w_]", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("unknown")).otherwise(s)


def entity_name(c: Column) -> Column:
    """Name cut at its first comma, digit, colon or bracket; null when two characters or fewer are left."""
    n = F.trim(F.regexp_replace(c, r"(?s)[,0-9():]+.*$", ""))
    return F.when(F.length(n) > 2, n)


def without_fences(c: Column) -> Column:
    """Generated text without its code fences."""
    return trimmed(F.regexp_replace(c, r"```[A-Za-z]*", ""))


def graph_statements(c: Column) -> Column:
    """Statements of a generated graph query text that match or call something."""
    return F.filter(F.transform(F.split(without_fences(c), ";"), trimmed), lambda s: F.upper(s).rlike("MATCH|RETURN|CALL"))


def middle_passage(c: Column, least: int = 150, fallback: int = 200) -> Column:
    """From the first space after the middle to the first full stop at least ``least`` characters on, else the first characters."""
    half = (F.floor(F.length(c) / 2) + 1).cast("int")
    begin = F.instr(F.substr(c, half), F.lit(" ")) + half
    stop = F.instr(F.substr(c, begin + least), F.lit("."))
    return F.when((F.instr(F.substr(c, half), F.lit(" ")) > 0) & (stop > 0), F.substr(c, begin, stop + least)).otherwise(F.substr(c, F.lit(1), F.lit(fallback)))


def stored_name(key: Column) -> Column:
    """Object key as a local file name."""
    return F.replace(key, F.lit("/"), F.lit("__"))


def object_key(name: Column) -> Column:
    return F.replace(name, F.lit("__"), F.lit("/"))


def stamp(c: Column) -> Column:
    """yyyyMMddHHmmss as a timestamp, null for anything else."""
    return F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss"))


def minutes_of_quarter(name: Column) -> Column:
    """The 15 minute stamps of a 15-minute file name, from 2020 on; empty before, null without a stamp."""
    start = stamp(F.nullif(F.regexp_extract(name, r"(\d{14})", 1), F.lit("")))
    every = F.transform(F.sequence(start, start + F.expr("interval 14 minutes"), F.expr("interval 1 minute")), lambda t: F.date_format(t, "yyyyMMddHHmmss"))
    return F.when(start >= F.lit("2020-01-01").cast("timestamp"), every).when(start.isNotNull(), F.array().cast("array<string>"))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def chunk_id(key: Column, number: Column) -> Column:
    """Deterministic id of a chunk, the same for every index of it."""
    return F.sha2(F.concat_ws("|", key.cast("string"), number.cast("string")), 256)


def json_span(c: Column) -> Column:
    """From the first '{' to the last '}' of a generated answer; null without both."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def _literals(x: object) -> list[str] | None:
    try:
        value = ast.literal_eval(x) if isinstance(x, str) else None
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    return [str(v) for v in value] if isinstance(value, (list, tuple)) else None


@F.pandas_udf(ArrayType(StringType()))
def literal_list(s: pd.Series) -> pd.Series:
    """A list written as a Python literal, as array<string>, whatever quotes it uses; null when it is none. No built-in reads it."""
    return s.map(_literals)


def truth(c: Column) -> Column:
    """Boolean of 'true' or 'false' text in any case, null otherwise."""
    t = F.lower(F.trim(c))
    return F.when(t == "true", True).when(t == "false", False)


@F.pandas_udf(StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Character references decoded; no built-in does it."""
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; no built-in does it."""
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def payload(*columns: Column, chunk: Column, number: Column, preview: int = 200) -> Column:
    """Metadata of a record joined with its chunk: what is stored beside a vector."""
    return F.struct(*columns, F.substring(chunk, 1, preview).alias("original_text_preview"), chunk.alias("chunk_text"), number.alias("chunk_number"))
