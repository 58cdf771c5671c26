"""Corpus sources: formats by suffix, aliased columns to one schema, inventories, tolerant JSON lines, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions.text import norm_list
from arborlake.sources.arrow_files import read_arrow

#: The spellings of each column, the first that has a value wins.
ALIASES = {
    "idx": ("idx", "index"), "sample_id": ("sample_id", "id", "idx", "index"), "project": ("project", "project_name", "repository", "repo", "repo_name", "name"),
    "project_url": ("project_url", "repo_url", "repository_url", "url", "github_url", "repo"), "filepath": ("filepath", "file_path", "path", "filename", "file"),
    "func_name": ("func_name", "function_name", "target_func", "target_function_name", "symbol", "name"),
    "func_body": ("func_body", "function_body", "target_function", "function", "source", "code", "func_before", "vulnerable_function", "fixed_function"),
    "commit_id": ("commit_id", "commit", "commit_hash", "dataset_commit", "before_commit"), "patch_commit_id": ("patch_commit_id", "fix_commit"),
    "commit_message": ("commit_message", "message", "fix_message"), "is_vulnerable": ("is_vulnerable", "vulnerable", "label", "target", "ground_truth", "is_buggy"),
    "cve_list": ("cve_list", "cves", "cve"), "cwe_list": ("cwe_list", "cwes", "cwe"),
}
YES = ("1", "1.0", "true", "yes", "vulnerable", "vuln", "buggy")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A corpus by suffix: jsonl, ndjson, json (a list, or rows or data in an object), csv, tsv, parquet, pq, orc, arrow, feather."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("jsonl", "ndjson"):
        return read_json_lines(spark, path)
    if suffix == "json":
        rows = spark.read.option("multiLine", "true").json(path)
        for key in ("rows", "data"):
            if key in rows.columns and isinstance(rows.schema[key].dataType, T.ArrayType):
                return rows.select(F.explode(key).alias("r")).select("r.*")
        return rows
    if suffix in ("csv", "tsv"):
        return spark.read.option("header", "true").option("sep", "\t" if suffix == "tsv" else ",").option("multiLine", "true").option("escape", '"').csv(path)
    if suffix in ("arrow", "feather"):
        return read_arrow(spark, path)
    if suffix == "orc":
        return spark.read.orc(path)
    if suffix in ("parquet", "pq"):
        return spark.read.parquet(path)
    raise ValueError(f"unknown corpus format: {path}")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; lines that are no object are dropped."""
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def present(c: Column, kind: T.DataType) -> Column:
    """The value as text; null if missing, blank, not a number or an empty list."""
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(F.size(c) > 0, F.array_join(c.cast("array<string>"), ",") if isinstance(kind, T.ArrayType) else F.to_json(c))
    if isinstance(kind, T.StructType):
        return F.to_json(c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
        return F.when(~F.isnan(c), whole)
    if isinstance(kind, T.BinaryType):
        return F.nullif(F.decode(c, "UTF-8"), F.lit(""))
    text = c.cast("string")
    return F.when(F.trim(text) != "", text)


def normalize(rows: DataFrame) -> DataFrame:
    """One schema for any spelling of the columns, with what is left over as JSON in `extras`, and `seq` for the order of rows.

    Missing projects come from the end of the url, missing names from the body.
    """
    by_lower = {c.lower(): c for c in reversed(rows.columns)}
    pick = {name: F.coalesce(*[present(F.col(f"`{by_lower[a]}`"), rows.schema[by_lower[a]].dataType) for a in aliases if a in by_lower], F.lit(None).cast("string")) for name, aliases in ALIASES.items()}
    used = {a for aliases in ALIASES.values() for a in aliases}
    rest = [c for c in rows.columns if c.lower() not in used]
    extras = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])) if rest else F.lit(None).cast("string")
    out = rows.select(*[c.alias(name) for name, c in pick.items()], extras.alias("extras")).withColumn("seq", F.monotonically_increasing_id())
    tail = F.regexp_replace(F.regexp_replace("project_url", "/+$", ""), r"^.*/|\.git$", "")
    name = F.nullif(F.regexp_extract("func_body", r"\b([A-Za-z_]\w*)\s*\([^;{}]*\)\s*\{", 1), F.lit(""))
    return out.withColumns({
        "idx": F.coalesce(F.col("idx").try_cast("long"), F.col("seq")), "sample_id": F.coalesce("sample_id", F.col("seq").cast("string")),
        "project": F.coalesce("project", F.nullif(tail, F.lit("")), F.lit("unknown_project")), "func_name": F.coalesce("func_name", name, F.lit("unknown_function")),
        "filepath": F.coalesce("filepath", F.lit("")), "func_body": F.coalesce("func_body", F.lit("")), "is_vulnerable": F.coalesce(F.lower(F.trim("is_vulnerable")).isin(*YES), F.lit(False)),
        "cve_list": norm_list(F.col("cve_list")), "cwe_list": norm_list(F.col("cwe_list")),
    })


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """A corpus file in the one schema."""
    return normalize(read(spark, path))


def smoke_samples(spark: SparkSession) -> DataFrame:
    """Two rows to try things with."""
    rows = [("0", "demo", "demo.c", "copy", "void copy(char *d, char *s) { strcpy(d, s); }", True), ("1", "demo", "demo.c", "copy", "void copy(char *d, char *s, int n) { if (n > 0) strncpy(d, s, n); }", False)]
    return normalize(spark.createDataFrame(rows, "sample_id string, project string, filepath string, func_name string, func_body string, is_vulnerable boolean"))


def counts(samples: DataFrame) -> DataFrame:
    """One row: rows, distinct projects and functions, and the split of labels."""
    return samples.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("project").alias("projects"), F.countDistinct("project", "filepath", "func_name").alias("functions"), F.count_if("is_vulnerable").alias("vulnerable"), F.count_if(~F.col("is_vulnerable")).alias("safe"))


def load_inventory(rows: DataFrame, values: list[str]) -> DataFrame:
    """A lookup table (key, *values): each repository under its project, its url, and both in lower case; the first row of a key stays."""
    keys = F.array_distinct(F.array_compact(F.array("project", "project_url", F.lower("project"), F.lower("project_url"))))
    exploded = rows.withColumn("_seq", F.monotonically_increasing_id()).select(F.explode(keys).alias("key"), "_seq", F.struct(*values).alias("v"))
    return exploded.groupBy("key").agg(F.min_by("v", "_seq").alias("v")).select("key", "v.*")


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of several shapes as one table; columns that a file lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(spark, p) for p in paths])


def tree_stats(listing: DataFrame) -> DataFrame:
    """(repo_key, files, source_files, bytes, source_bytes, largest) from listing lines (repo_key, line) of `mode type id size<TAB>path`."""
    from arborlake.sources.code import EXTENSIONS

    path, size = F.substring_index("line", "\t", -1), F.regexp_extract("line", r"\s(\d+)\t", 1).try_cast("long")
    rows = listing.select("repo_key", path.alias("path"), size.alias("size")).where("size IS NOT NULL")
    source = reduce(lambda a, b: a | b, [F.lower("path").endswith(e) for e in EXTENSIONS])
    return rows.groupBy("repo_key").agg(F.count(F.lit(1)).alias("files"), F.count_if(source).alias("source_files"), F.sum("size").alias("bytes"), F.coalesce(F.sum(F.when(source, F.col("size"))), F.lit(0)).alias("source_bytes"), F.max_by("path", F.struct("size", "path")).alias("largest"))
