"""Readers of the raw files and writers of results."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..session import arrow_map, materialize
from .schemas import strings

def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


FRAGMENT = "url string, date string, lang string, type string, pos string, pre string, ngram string, post string, _broken string"


def read_tsv(spark: SparkSession, path: str, names: list[str], columns: list[str], pattern: str | None = None) -> DataFrame:
    """Headerless Latin-1 TSV, columns by position, only those asked for; short and long lines are kept."""
    reader = spark.read.option("sep", "\t").option("encoding", "ISO-8859-1").option("quote", "").option("mode", "PERMISSIVE")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.schema(strings(names)).csv(path).select(*[F.col(f"`{c}`") for c in columns])


def read_tsv_strict(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The same, but lines with too many fields are dropped and short ones padded with null."""
    parts = F.split("value", "\t", -1)
    # whole lines through the CSV reader, which knows encodings: its separator here is no Latin-1 character
    whole = spark.read.option("sep", "\u241f").option("encoding", "ISO-8859-1").option("quote", "").schema("value string").csv(path)
    lines = whole.where(F.size(parts) <= len(names)).select(parts.alias("p"))
    return lines.select(*[F.nullif(F.get("p", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def file_marks(spark: SparkSession, path: str) -> dict[str, str]:
    """Encoding of each file of path by its first bytes, of which no more are read: UTF-16 by mark or by zero bytes, else UTF-8."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for status in fs.globStatus(jpath) or []:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        for f in inner:
            name = f.getPath().getName()
            if f.isDirectory() or name[:1] in "_.":
                continue
            stream = fs.open(f.getPath())
            try:
                b = [stream.read() for _ in range(4)]
            finally:
                stream.close()
            mark = {(0xFF, 0xFE): "UTF-16", (0xFE, 0xFF): "UTF-16"}.get((b[0], b[1]))
            out[f.getPath().toString()] = mark or ("UTF-16LE" if b[1] == b[3] == 0 else "UTF-16BE" if b[0] == b[2] == 0 else "UTF-8")
    return out


def read_csv_any_utf(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header, in UTF-8 or UTF-16, mixed as they may be; columns by name, missing ones null.

    UTF-8 files are split as usual; a UTF-16 file is one task, as its line ends
    cannot be found from its middle.
    """
    by: dict[str, list[str]] = {}
    for name, code in file_marks(spark, path).items():
        by.setdefault(code, []).append(name)
    parts = [spark.read.option("header", True).option("encoding", code).option("multiLine", code != "UTF-8").csv(names) for code, names in sorted(by.items())]
    if not parts:
        raise FileNotFoundError(path)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv_mixed(spark: SparkSession, path: str, names: list[str], numbers: list[str]) -> DataFrame:
    """CSV files of one directory, some with a header row: header rows, over-long rows and rows with a null are dropped."""
    wide = spark.read.schema(strings([*names, "_more"])).option("mode", "PERMISSIVE").csv(path).where("_more is null").drop("_more")
    rows = wide.where(F.col(names[0]) != names[0])
    return rows.select(*[F.col(n).try_cast("double").alias(n) if n in numbers else F.col(n) for n in names]).dropna()


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """N-gram JSON lines; broken lines and lines without a URL are skipped, a position that is no number is 999."""
    rows = spark.read.schema(FRAGMENT).option("columnNameOfCorruptRecord", "_broken").json(path)
    rows = rows.where("_broken is null and coalesce(url, '') <> ''")
    return rows.select("url", "date", F.coalesce("lang", F.lit("un")).alias("lang"), F.coalesce(F.col("type").try_cast("int"), F.lit(-1)).alias("type"), F.coalesce(F.col("pos").try_cast("int"), F.lit(999)).alias("pos"), "pre", "ngram", "post", F.input_file_name().alias("file"))


def balanced_objects(text: str) -> list[str]:
    """Top-level {...} spans of a broken JSON array; braces inside strings do not count."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


def read_broken_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of truncated or concatenated JSON arrays, one file per record; objects that do not parse are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(0).to_pylist():
                for o in balanced_objects(t or ""):
                    try:
                        json.loads(o)
                        found.append(o)
                    except ValueError:
                        pass
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["o"])

    objects = arrow_map(spark.read.option("wholetext", True).text(path), run, "o string")
    return objects.select(F.from_json("o", schema).alias("r")).select("r.*")


def todo_files(listed: DataFrame, done: DataFrame, name: str) -> DataFrame:
    """Files still to read: those not done under either spelling of their name."""
    plain = F.replace(F.col(name), F.lit("/"), F.lit("__"))
    return listed.withColumn("_k", plain).join(done.select(plain.alias("_k")), "_k", "left_anti").drop("_k")


def list_files(spark: SparkSession, path: str, pattern: str = "*", least_bytes: int = 0, recursive: bool = True) -> DataFrame:
    """(path, length, modified) of files by name and size; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified")).where(F.col("length") >= least_bytes)


def describe(df: DataFrame, sample: int = 3) -> dict[str, list]:
    """Columns with their types and a few rows: what a query writer is shown."""
    return {"columns": df.dtypes, "rows": [r.asDict() for r in df.limit(sample).collect()]}


def catalogue(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table_name, position, column_name, type) of all tables and views of a database: the schema a query writer is shown."""
    rows = []
    for t in spark.catalog.listTables(database):
        name = t.name if t.isTemporary else ".".join([*(t.namespace or []), t.name])
        rows += [(t.name, i, c.name, c.dataType) for i, c in enumerate(spark.catalog.listColumns(name), 1)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string")


def link_list(spark: SparkSession, path: str) -> DataFrame:
    """Third field of each line, where it is a link."""
    third = F.get(F.split(F.trim("value"), r"\s+"), F.lit(2))
    return spark.read.text(path).select(third.alias("url")).where(F.startswith("url", F.lit("http")))


def read_scrape(spark: SparkSession, path: str, least: int = 150) -> DataFrame:
    """Crawl results (JSON lines) as articles (url, text, title, author, date): typed and renamed, broken lines and short texts dropped, a missing title empty."""
    rows = spark.read.schema("url string, title string, body_text string, author string, date string, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    rows = rows.where("_broken is null and coalesce(url, '') <> ''").where(F.length("body_text") >= least)
    return rows.select("url", F.col("body_text").alias("text"), F.coalesce("title", F.lit("")).alias("title"), "author", F.to_timestamp(F.substring("date", 1, 19)).alias("date"))


def read_union(spark: SparkSession, paths: list[str], *columns: str) -> DataFrame:
    """Parquet of several directories as one table, by name; columns a directory lacks are null."""
    parts = [spark.read.parquet(p) for p in paths]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*columns) if columns else out


def read_sql(spark: SparkSession, url: str, query: str, key: str | None = None, parts: int = 8, fetch: int = 10_000, **options: str) -> DataFrame:
    """Rows of a database query, fetched by cursor; with a numeric key in ``parts`` ranges of it at once."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch).options(**options)
    if key is None:
        return reader.option("query", query).load()
    ends = reader.option("query", f"select min({key}) as a, max({key}) as b from ({query}) q").load().first()
    if ends[0] is None:
        return spark.read.format("jdbc").option("url", url).options(**options).option("query", query).load()
    whole = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch).options(**options)
    return whole.option("dbtable", f"({query}) q").option("partitionColumn", key).option("lowerBound", int(ends[0])).option("upperBound", int(ends[1]) + 1).option("numPartitions", parts).load()


def write_copy_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text for a bulk COPY: null is \\N; tabs, line ends and backslashes are escaped."""
    cells = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`").cast("string")
        for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")) if kind == "string" else ():
            c = F.replace(c, F.lit(a), F.lit(b))
        cells.append(F.coalesce(c, F.lit("\\N")))
    df.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)


def read_copy_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_copy_tsv wrote."""
    fields = schema_of(schema).fields
    p = F.split("value", "\t", -1)

    def cell(i: int) -> Column:
        c = F.get("p", F.lit(i))
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\t", "$1\t"), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"(?<!\\)((?:\\\\)*)\\r", "$1\r")
        return F.when(c != "\\N", F.replace(plain, F.lit("\\\\"), F.lit("\\")))

    return spark.read.text(path).select(p.alias("p")).select(*[cell(i).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def append_csv(df: DataFrame, path: str) -> None:
    """Rows added to a CSV directory, each file with its header; readers see one header a file whether it is the first or not."""
    df.write.mode("append").option("header", True).csv(path)


def batch_numbers(df: DataFrame, order: list[str], size: int, file: str | None = None) -> DataFrame:
    """df with ``batch``: rows of a file (or of all) in order, ``size`` to a batch, from 0.

    Without a file the ranks are made per range of the order and shifted by
    the ranges before, so that no task sorts everything.
    """
    if file:
        return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(file).orderBy(*order)) - 1) / size))
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = parts.groupBy("_part").agg(F.count("*").alias("n"))
    before = before.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # one row a part
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    return parts.join(F.broadcast(before), "_part").withColumn("batch", F.floor(rank / size)).drop("_part", "_before")


def write_report(sheets: dict[str, DataFrame], path: str, most: int = 100_000) -> None:
    """A workbook with a sheet for each result; a sheet of more than ``most`` rows is refused, as a report is no table store.

    Cells are written as inline strings and numbers; path is on the driver.
    """
    from xml.sax.saxutils import escape

    head, ns = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        relations, office = "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{relations}"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{relations}">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'{head}<workbook {ns} xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        for i, df in enumerate(sheets.values(), 1):
            rows = df.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"more than {most} rows")
            cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"{head}<worksheet {ns}><sheetData>" + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [df.columns, *rows]) + "</sheetData></worksheet>")


def write_parquet(df: DataFrame, path: str, parts: int | None = None, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    out = df.repartition(parts) if parts else df
    w = out.write.mode(mode).option("compression", "snappy")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to a table of results."""
    df.write.mode("append").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_split(df: DataFrame, good, path: str, key: str, rest: str) -> None:
    """Two results of one plan: good rows as Parquet, the keys of the others as text; computed once."""
    df = df.persist()
    try:
        df.where(good).write.mode("overwrite").parquet(path)
        df.where(~good).select(F.col(key).cast("string")).where(F.col(key).isNotNull()).write.mode("overwrite").text(rest)
    finally:
        df.unpersist()
