"""Challenge folders: writing splits with a registry and a manifest, finding them, and checking them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLIC = ["kg_id", "project", "filepath", "func_name"]


def with_ids(samples: DataFrame, seed: int = 0) -> DataFrame:
    """samples with kg_id, an opaque id that does not tell the label."""
    return samples.withColumn("kg_id", F.concat(F.lit("kg_"), F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("sample_id").cast("string"))), 1, 12)))


def write(samples: DataFrame, path: str) -> None:
    """train and test without what gives labels away, labels apart, an empty submission, a registry and a manifest.

    samples: kg_id, sample_id, project, filepath, func_name, is_vulnerable, split.
    """
    out = lambda df, name: df.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")
    label = F.col("is_vulnerable").cast("int").alias("label")
    train, test = samples.where("split = 'train'"), samples.where("split = 'test'")
    out(train.select(*PUBLIC, label), "train")
    out(test.select(*PUBLIC), "test")
    out(test.select("kg_id", label), "labels")
    out(test.select("kg_id", F.lit(None).cast("int").alias("prediction")), "submission")
    samples.select("kg_id", "sample_id", "project", "func_name", "split", label).write.mode("overwrite").json(f"{path}/registry")
    counts(samples).write.mode("overwrite").json(f"{path}/manifest")


def counts(samples: DataFrame) -> DataFrame:
    """(split, rows, vulnerable, projects) of each split."""
    return samples.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_vulnerable").alias("vulnerable"), F.countDistinct("project").alias("projects"))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every challenge below a folder: where a manifest stands."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    return files.where(F.col("path").rlike("/manifest/[^/]+$")).select(F.regexp_replace("path", "/manifest/[^/]+$", "").alias("path")).distinct().orderBy("path")


def problems(spark: SparkSession, path: str) -> DataFrame:
    """(problem, n): ids that occur twice, are in both splits, or lack a label, and test columns that give labels away."""
    read = lambda name: spark.read.option("header", "true").csv(f"{path}/{name}")
    train, test, labels = read("train"), read("test"), read("labels")
    ids = train.select("kg_id").unionByName(test.select("kg_id"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    leak = test.select(F.lit("label" in test.columns or "sample_id" in test.columns).cast("int").alias("x")).where("x = 1")
    parts = [
        n(ids.groupBy("kg_id").count().where("count > 1"), "repeated_id"), n(train.join(test, "kg_id", "left_semi"), "in_both_splits"),
        n(test.join(labels, "kg_id", "left_anti"), "no_label"), n(leak, "label_leak"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")
