"""Session helpers: code shipping, checkpoint folder, table loading."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as a zip that Spark's file server hands out."""
    sc = spark.sparkContext
    if getattr(sc, "_arborlake_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="arborlake"), "arborlake.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    sc.addPyFile(target)
    sc._arborlake_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the application, in spark.checkpoint.dir; a temporary one only on a local master, as on a cluster it would be lost with the driver."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="arborlake-checkpoint"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new name in the shared folder, for a table that one job writes and another reads."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Spark's setting by which a statement's shuffle files go when it is done, not when the driver's garbage collector finds them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder: smaller than a checkpoint's rows, and joins know its size. Every column needs a type.

    What the write shuffled is deleted when it is done, so steps one after the other need the disk of the largest, not of all.
    """
    spark = df.sparkSession
    at, before = scratch(spark), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out._written = at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables as `written` gave them, which nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, most: int = 200_000) -> bool:
    """Whether df has at most `most` rows. Counts rows, so give it something written out."""
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows, else as it is, to be joined by shuffle. Counts rows, so give it something written out."""
    return F.broadcast(df) if is_small(df, most) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_session(master: str = "local[8]", app: str = "arborlake", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and bench share."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
