"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by ``work_table``, by application.
_WRITTEN: dict[str, list[str]] = {}


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cuespan")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CUESPAN_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir``, or the one already set on the context.

    Without either, a local master gets a scratch folder of its own; a cluster gets an error, as its nodes would not
    see each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("name a folder that all nodes share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="spark-cuespan-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def work_table(df: DataFrame, *, rows_per_file: int = 0) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back; at most ``rows_per_file`` rows a file, if given.

    What is used more than once is computed once and survives lost executors; the size of the files is then known to
    the optimizer, which broadcasts such a table only below its own threshold. ``drop_work`` deletes these folders.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/work-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_work(spark: SparkSession) -> None:
    """Delete what ``work_table`` has written in this application; results that still read it are lost."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: used twice, it is computed once, and lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)
