"""File streams: resume by checkpoint, bounded micro-batches, assembly per file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.assemble import CANONICAL, Assembly, assemble, fragment
from ..session import delete_on_exit, shared_folder


def ingest(spark: SparkSession, folder: str, glob: str, schema, per_batch: int = 100, out: str | None = None, state: str | None = None) -> str:
    """All files that are new since the last call, as Parquet; returns the path. The checkpoint remembers files read.

    glob names files of folder, or one directory in it whose Parquet files are read.
    """
    inner = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{glob}")
    if "*" not in glob and inner.getFileSystem(spark._jsc.hadoopConfiguration()).isDirectory(inner):
        folder, glob = f"{folder}/{glob}", "*.parquet"
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    delete_on_exit(spark, base)  # of what is given by the caller nothing is removed
    out, state = out or f"{base}/out", state or f"{base}/state"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).parquet(folder)
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def assemble_stream(spark: SparkSession, folder: str, out: str, state: str, per_batch: int = 100, how: Assembly = CANONICAL) -> None:
    """N-gram JSON files -> articles, each assembled within its own file; a batch that is run again overwrites itself."""
    schema = "url string, date string, lang string, type string, pos string, pre string, ngram string, post string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder).withColumn("file", F.input_file_name())

    def one(batch: DataFrame, number: int) -> None:
        pos = F.coalesce(F.col("pos").try_cast("int"), F.lit(999))
        good = batch.where("coalesce(url, '') <> '' and try_cast(type as int) = 1")
        parts = good.select("url", "file", pos.alias("pos"), fragment(F.col("pre"), F.col("ngram"), F.col("post"), pos).alias("sentence"), "date")
        assemble(parts, ["file", "url"], how).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.writeStream.foreachBatch(one).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Events per window and kind; on a stream, later ones than ``late`` are dropped (an extension)."""
    rows = events.withWatermark(at, late) if events.isStreaming and late else events
    return rows.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("window_start"), kind, "n_events")
