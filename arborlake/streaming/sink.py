"""Sinks of streams: a keyed table of which a batch rewrites only the buckets it touches, and appended lines.

A keyed table is a folder: `rows/version=N/bucket=B` holds a bucket as batch N left it, `versions/N` says for each bucket
which version is its last. A batch that is run again writes the same version again, so each takes effect once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = "bucket int, version long"


def _folder(spark: SparkSession, path: str):
    # Hadoop's view of a path, so that any store Spark writes to can be listed and cleaned
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    return here.getFileSystem(spark._jsc.hadoopConfiguration()), here


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that are complete and kept, the last one last."""
    store, here = _folder(spark, f"{path}/versions")
    if not store.exists(here):
        return []
    names = [s.getPath() for s in store.listStatus(here)]
    done = [p for p in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done if p.getName().isdigit())


def _buckets(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    # one row a bucket, so as many as the table was made with
    return {r["bucket"]: r["version"] for r in spark.read.schema(VERSIONS).parquet(f"{path}/versions/{version}").collect()}


def _place(path: str, bucket: int, version: int) -> str:
    return f"{path}/rows/version={version}/bucket={bucket}"


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a keyed table as its last batch, or a kept earlier one, left it; FileNotFoundError if there is none."""
    kept = versions(spark, path)
    if not kept or version is not None and version not in kept:
        raise FileNotFoundError(f"no version {'' if version is None else version} of {path}")
    found = _buckets(spark, path, kept[-1] if version is None else version)
    return spark.read.parquet(*[_place(path, b, v) for b, v in sorted(found.items())])


def upsert(batch: DataFrame, number: int, path: str, keys: list[str], order: str, buckets: int = 64, keep: int = 2) -> None:
    """Write batch `number` into the keyed table at `path`.

    Of the rows of a key, in the batch and in the table, the one with the greatest `order` stays; of equal ones the batch's. Give as
    many buckets as make each fit a few tasks; the number is fixed once a table has rows. `keep` versions stay readable. A null key is a key; an empty batch changes nothing.
    """
    spark = batch.sparkSession
    batch = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
    try:
        touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())
        before = [v for v in versions(spark, path) if v < number]
        old = _buckets(spark, path, before[-1]) if before else {}
        if not touched:
            return
        rows = batch.withColumn("_new", F.lit(1))
        places = [_place(path, b, old[b]) for b in touched if b in old]
        if places:
            plain = batch.drop("bucket")
            stored = spark.read.schema(plain.schema).parquet(*places).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("_new", F.lit(0))
            rows = rows.unionByName(stored)
        columns = [c for c in batch.columns if c not in keys and c != "bucket"]
        last = F.max_by(F.struct(*columns), F.struct(F.col(order), F.col("_new"))).alias("_last")
        # partial aggregation keeps one row a key and task; rebalancing splits a great bucket over tasks and makes one file of a small one
        merged = rows.groupBy("bucket", *keys).agg(last).select("bucket", *keys, "_last.*")
        merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={number}")
        now = old | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), VERSIONS).coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{number}")
        clean(spark, path, keep)
    finally:
        batch.unpersist()


def clean(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last `keep` versions, and the buckets that none of them holds."""
    kept = versions(spark, path)
    used = {(b, v) for version in kept[-keep:] for b, v in _buckets(spark, path, version).items()}
    store, rows = _folder(spark, f"{path}/rows")
    for version in store.listStatus(rows):
        number = int(version.getPath().getName().removeprefix("version="))
        # what a later batch is writing is left alone
        if number > kept[-1]:
            continue
        parts = [p.getPath() for p in store.listStatus(version.getPath()) if p.isDirectory()]
        unused = [p for p in parts if (int(p.getName().removeprefix("bucket=")), number) not in used]
        for part in [version.getPath()] if len(unused) == len(parts) else unused:
            store.delete(part, True)
    for version in kept[:-keep]:
        store.delete(_folder(spark, f"{path}/versions/{version}")[1], True)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, buckets: int = 64, keep: int = 2) -> None:
    """Drain what a stream has into the keyed table at `path`; begun again, it goes on after the last batch of its checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        upsert(batch, number, path, keys, order, buckets, keep)

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what a stream has as JSON lines to a folder, each row once; nulls are left out of the lines."""
    stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
