"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("chronofind")
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
        **conf,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset and
    the master is local, a temporary folder. Anything else raises, as a cluster has no such folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="chronofind-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def filesystem(spark: SparkSession, path: str) -> tuple[object, object]:
    """(Hadoop file system, Hadoop path) of an address; one without a scheme is the cluster's default one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def qualified(spark: SparkSession, path: str) -> str:
    """The address with the scheme that Spark itself would give it, for readers other than Spark."""
    fs, hadoop = filesystem(spark, path)
    return fs.makeQualified(hadoop).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = filesystem(spark, path)
    return fs.exists(hadoop)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new address in this application's part of the shared folder, which is deleted when the driver's JVM ends."""
    root = f"{shared_dir(spark)}/chronofind/{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_chronofind_scratch", None) != root:
        fs, hadoop = filesystem(spark, root)
        fs.mkdirs(hadoop)
        fs.deleteOnExit(hadoop)
        spark.sparkContext._chronofind_scratch = root
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder made by scratch_path before the end of the application."""
    if "/chronofind/" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    fs, hadoop = filesystem(spark, path)
    fs.delete(hadoop, True)


def local_path(uri: str) -> str:
    """file:// address to path; only file systems mounted on every executor can be opened by path."""
    path = uri.removeprefix("file:")
    return "/" + path.lstrip("/") if uri.startswith("file:") else os.path.abspath(uri)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_chronofind_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="chronofind-ship-")) / "chronofind.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._chronofind_shipped = True
