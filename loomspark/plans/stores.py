"""Readers and sinks: each query writes a table's rows in a format and reads them back."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fields
from ..operators.relational import merged
from ..session import delete_on_exit, materialize, shared_folder
from ..sources import files
from ..sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None) -> Callable:
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


_EVENTS = ["globaleventid", "eventrootcode", "nummentions"]


def _tsv(spark: SparkSession, d: str) -> str:
    path = _folder(spark)
    e = table(spark, d, "gdelt_event", *_EVENTS)
    e.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _EVENTS]).alias("value")).write.text(path)
    return path


@query("select globaleventid, nummentions from gdelt_event")
def tsv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Headerless tab-separated rows, two of three columns by position, in splits of 128 MB."""
    rows = files.read_tsv(spark, _tsv(spark, d), _EVENTS, ["globaleventid", "nummentions"])
    return rows.select(F.col("globaleventid").cast("bigint").alias("globaleventid"), F.col("nummentions").cast("int").alias("nummentions"))


@query("select globaleventid, nullif(eventrootcode, '') as eventrootcode from gdelt_event")
def tsv_strict_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = files.read_tsv_strict(spark, _tsv(spark, d), _EVENTS)
    return rows.select(F.col("globaleventid").cast("bigint").alias("globaleventid"), "eventrootcode")


@query("select doc_id, title from documents")
def csv_utf8_and_utf16(spark: SparkSession, d: str) -> DataFrame:
    """One directory of CSV files in two encodings."""
    path, t = _folder(spark), table(spark, d, "documents", "doc_id", "title")
    t.where("doc_id % 2 = 0").write.option("header", True).csv(path)
    t.where("doc_id % 2 = 1").write.mode("append").option("header", True).option("encoding", "UTF-16").csv(path)
    return files.read_csv_any_utf(spark, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), "title")


@query("select eventrootcode, nummentions, round(cast(avgtone as double), 4) as tone from gdelt_event where eventrootcode is not null and nummentions is not null and avgtone is not null")
def csv_mixed_headers(spark: SparkSession, d: str) -> DataFrame:
    """One directory of CSV files with and without a header row; rows with a null are dropped."""
    path, e = _folder(spark), table(spark, d, "gdelt_event", "eventrootcode", "nummentions", "avgtone")
    e = e.select("eventrootcode", "nummentions", F.round(F.col("avgtone").cast("double"), 4).alias("tone"))
    e.where("nummentions % 2 = 0").write.option("header", True).csv(path)
    e.where("coalesce(nummentions % 2, 1) <> 0").write.mode("append").csv(path)
    rows = files.read_csv_mixed(spark, path, ["eventrootcode", "nummentions", "tone"], ["nummentions", "tone"])
    return rows.select("eventrootcode", F.col("nummentions").cast("int").alias("nummentions"), F.round("tone", 4).alias("tone"))


@query("select user_id, count(*) as n, sum(cast(event_id % 997 as bigint)) as places from events group by 1")
def fragment_lines(spark: SparkSession, d: str) -> DataFrame:
    """N-gram JSON lines with broken lines and positions that are no number between them."""
    path, e = _folder(spark), table(spark, d, "events", "event_id", "user_id")
    good = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("url"), (F.col("event_id") % 997).cast("string").alias("pos"), F.lit("1").alias("type")))
    e.select(F.explode(F.array(good, F.lit('{"url": "x", '), F.lit('{"pos": "3"}'))).alias("value")).write.text(path)
    rows = files.read_fragments(spark, path)
    return rows.groupBy(F.substring("url", 2, 20).cast("bigint").alias("user_id")).agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@query("select doc_id as id, url, text, coalesce(title, '') as title, author from documents where url is not null and url <> '' and length(text) >= 150")
def scrape_lines(spark: SparkSession, d: str) -> DataFrame:
    """Crawl results as JSON lines, renamed and typed."""
    path, t = _folder(spark), table(spark, d, "documents", "doc_id", "url", "title", "text", "author", "published_at").where("url is not null")
    line = F.to_json(F.struct(F.concat_ws("\u0001", "doc_id", "url").alias("url"), "title", F.col("text").alias("body_text"), "author", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("date")))
    t.select(line.alias("value")).write.text(path)
    rows, part = files.read_scrape(spark, path), F.split("url", "\u0001")
    return rows.select(part[0].cast("bigint").alias("id"), part[1].alias("url"), "text", "title", "author").where("url <> ''")


@query("select count(*) as n, sum(cast(event_id as bigint)) as ids from events")
def broken_json_array(spark: SparkSession, d: str) -> DataFrame:
    """JSON arrays that end in the middle of an object."""
    path, e = _folder(spark), table(spark, d, "events", "event_id", "props")
    one = F.concat(F.to_json(F.struct("event_id", "props")), F.lit(","))
    e.select(one.alias("value")).unionByName(spark.range(1).select(F.lit('{"event_id": 7, "props": "{').alias("value"))).coalesce(1).write.text(path)
    return files.read_broken_json(spark, path, "event_id bigint, props string").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("select doc_id, title, text, author from documents")
def copy_tsv(spark: SparkSession, d: str) -> DataFrame:
    """Rows as a bulk COPY takes them, with line ends, tabs and nulls."""
    path = _folder(spark)
    files.write_copy_tsv(table(spark, d, "documents", "doc_id", "title", "text", "author"), path)
    return files.read_copy_tsv(spark, path, "doc_id bigint, title string, text string, author string")


@query("select vec_id, label from embeddings union all select vec_id, label from embeddings where label < 3")
def csv_append(spark: SparkSession, d: str) -> DataFrame:
    """A CSV result that grows, its header in every file."""
    path, e = _folder(spark), table(spark, d, "embeddings", "vec_id", "label")
    files.append_csv(e, path)
    files.append_csv(e.where("label < 3"), path)
    return spark.read.option("header", True).csv(path).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"))


@query("select doc_id, 'good' as part from documents where length(text) >= 150 union all select doc_id, 'rest' from documents where coalesce(length(text), 0) < 150")
def two_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Usable rows and the keys of the others, written from one plan."""
    path = _folder(spark)
    t = table(spark, d, "documents", "doc_id", "text").withColumn("n", F.coalesce(F.length("text"), F.lit(0))).drop("text")
    files.write_split(t, F.col("n") >= 150, f"{path}/good", "doc_id", f"{path}/rest")
    good = spark.read.parquet(f"{path}/good").select("doc_id", F.lit("good").alias("part"))
    return good.unionByName(spark.read.text(f"{path}/rest").select(F.col("value").cast("bigint").alias("doc_id"), F.lit("rest").alias("part")))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by all")
def union_directories(spark: SparkSession, d: str) -> DataFrame:
    """Several directories of Parquet as one table, a column missing in one of them."""
    path, li = _folder(spark), table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_tax")
    files.write_parquet(li.where("l_returnflag = 'R'").drop("l_tax"), f"{path}/a")
    files.write_parquet(li.where("l_returnflag <> 'R'"), f"{path}/b")
    return files.read_union(spark, [f"{path}/a", f"{path}/b"], "l_returnflag", "l_linestatus").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("select doc_id, cast(floor((row_number() over (order by doc_id) - 1) / 100) as bigint) as batch from documents")
def batches_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Batch numbers of a hundred over all rows in order, without one task that sorts all."""
    return files.batch_numbers(table(spark, d, "documents", "doc_id"), ["doc_id"], 100)


@query("select source, doc_id, cast(floor((row_number() over (partition by source order by doc_id) - 1) / 10) as bigint) as batch from documents where source is not null")
def batches_in_a_file(spark: SparkSession, d: str) -> DataFrame:
    return files.batch_numbers(table(spark, d, "documents", "source", "doc_id").where("source is not null"), ["doc_id"], 10, "source")


def _database(spark: SparkSession, df: DataFrame, name: str) -> str:
    """URL of an embedded database with the rows of df(SKEY, SNAME) as table ``name``, that every executor can read.

    The driver alone loads it, from text files, and closes it; a closed one in
    an archive is read-only, so any number of processes open it at once.
    """
    path, local, made = _folder(spark), tempfile.mkdtemp(prefix="loomspark-db-"), f"m{uuid.uuid4().hex}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        raise RuntimeError("an embedded database needs a shared folder that is mounted on all executors")
    cell = F.coalesce(F.concat(F.lit('"'), F.replace("SNAME", F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))
    df.select(F.concat(F.coalesce(F.col("SKEY").cast("string"), F.lit("")), F.lit(","), cell).alias("value")).write.text(path)
    mounted, derby, none = Path(fs_path.toUri().getPath()), spark._jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver(), spark._jvm.java.util.Properties()
    link = derby.connect(f"jdbc:derby:{local}/{made};create=true", none)
    try:
        call = link.createStatement()
        call.execute(f"create table {name} (SKEY bigint, SNAME varchar(32672))")
        for part in sorted(p for p in mounted.glob("part-*") if p.stat().st_size):
            call.execute(f"call SYSCS_UTIL.SYSCS_IMPORT_TABLE(null, '{name}', '{part}', ',', '\"', 'UTF-8', 0)")
    finally:
        link.close()
    try:
        derby.connect(f"jdbc:derby:{local}/{made};shutdown=true", none)
    except Py4JJavaError:  # that is how it tells that it is closed
        pass
    jar = shutil.make_archive(f"{local}/{made}-all", "zip", local, made)
    shutil.move(jar, mounted / f"{made}.jar")
    shutil.rmtree(local)
    return f"jdbc:derby:jar:({mounted / made}.jar){made}"


@query("select s_suppkey, s_name from supplier")
def sql_cursor_scan(spark: SparkSession, d: str) -> DataFrame:
    """A database table read by ranges of its key (an embedded database stands for the server)."""
    s = table(spark, d, "supplier", "s_suppkey", "s_name")
    url = _database(spark, s.select(F.col("s_suppkey").alias("SKEY"), F.col("s_name").alias("SNAME")), "SUPPLIERS")
    rows = files.read_sql(spark, url, "select SKEY, SNAME from SUPPLIERS", "SKEY", 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    return materialize(rows.select(F.col("SKEY").cast(s.schema["s_suppkey"].dataType).alias("s_suppkey"), F.col("SNAME").alias("s_name")), "cursor")


@query("select item_id, category from eval_item union select item_id, expected_db from eval_item")
def merged_results(spark: SparkSession, d: str) -> DataFrame:
    """Result sets of a question and its translation, each row once."""
    e = table(spark, d, "eval_item", "item_id", "category", "expected_db")
    return merged(e.select("item_id", "category"), e.select("item_id", F.col("expected_db").alias("category")), e.select("item_id", "category"))


@query("select item_id, list_filter(gold_contexts, lambda x: x is not null) as contexts from eval_item where len(list_filter(gold_contexts, lambda x: x is not null)) > 0")
def literal_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists written as Python literals, read again."""
    t = table(spark, d, "eval_item", "item_id", "gold_contexts").select("item_id", F.filter("gold_contexts", lambda x: x.isNotNull()).alias("c")).where(F.size("c") > 0)
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))
    text = F.concat(F.lit("["), F.array_join(F.transform("c", lambda x: F.concat(F.lit("'"), esc(x), F.lit("'"))), ", "), F.lit("]"))
    return t.select("item_id", fields.literal_list(text).alias("contexts"))
