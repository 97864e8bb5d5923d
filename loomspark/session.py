"""Session set-up and the shared folder for tables that cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "loomspark", cpus: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "128m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one of this machine, set here, only on a local master where that is unset.

    On a cluster without the setting it raises: what executors write to their
    own disks cannot be read back by others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"loomspark-shared-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Removes path when the driver's file systems close."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table of the shared folder and reads it back: cuts lineage, survives lost executors.

    The table is removed when the driver's file systems close.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    out = spark.read.parquet(path)
    out._loomspark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of materialize() that nothing reads any more."""
    for t in tables:
        path, spark = getattr(t, "_loomspark_path", None), t.sparkSession
        if path:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def sweep(spark: SparkSession) -> None:
    """Has the shuffle files of finished plans removed now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once per application."""
    context = spark.sparkContext
    if getattr(context, "_loomspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loomspark-code-")) / "loomspark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._loomspark_shipped = True


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with this package on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
