"""Selecting and splitting a corpus: pairs, curricula, quotas, exclusions, shuffles and splits."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.session import checkpoint

TEST, TRAIN = "test", "train"


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def group_key(url: Column, project: Column) -> Column:
    """The url of a project, else its name."""
    return F.coalesce(blank_to_null(url), project)


def project_stats(samples: DataFrame) -> DataFrame:
    """(project, project_url, samples, vulnerable, safe, commits, files); blank commits and files do not count."""
    return samples.groupBy("project").agg(
        F.min_by(blank_to_null(F.col("project_url")), F.when(blank_to_null(F.col("project_url")).isNotNull(), F.col("seq"))).alias("project_url"),
        F.count(F.lit(1)).alias("samples"), F.count_if("is_vulnerable").alias("vulnerable"), F.count_if(~F.col("is_vulnerable")).alias("safe"),
        F.countDistinct(blank_to_null(F.col("commit_id"))).alias("commits"), F.countDistinct(blank_to_null(F.col("filepath"))).alias("files"),
    )


def by_project_commit(samples: DataFrame) -> DataFrame:
    """(project_key, commit_key, n, ids): samples of each project and commit."""
    key = group_key(F.col("project_url"), F.col("project"))
    return samples.groupBy(key.alias("project_key"), F.coalesce(blank_to_null(F.col("commit_id")), F.lit("unknown_commit")).alias("commit_key")).agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_id"))


def fixed_pairs(samples: DataFrame, same_file: bool = True, same_function: bool = True, pair_by: str = "key") -> DataFrame:
    """(vulnerable_id, fixed_id) of each vulnerable sample with the first safe one of its project, file and function.

    With pair_by="fixed_idx" the safe sample is the one whose idx stands in the vulnerable one's fixed_func_idx.
    """
    vulnerable, safe = samples.where("is_vulnerable"), samples.where("NOT is_vulnerable")
    if pair_by == "fixed_idx":
        right = safe.select(F.col("idx").cast("double").alias("fixed_func_idx"), F.col("sample_id").alias("fixed_id"))
        return vulnerable.join(right, "fixed_func_idx").select(F.col("sample_id").alias("vulnerable_id"), "fixed_id")
    keys = ["_key"] + ["filepath"] * same_file + ["func_name"] * same_function
    keyed = lambda df: df.withColumn("_key", group_key(F.col("project_url"), F.col("project")))
    first = keyed(safe).groupBy(*keys).agg(F.min_by("sample_id", "seq").alias("fixed_id"))
    return keyed(vulnerable).join(first, keys).select(F.col("sample_id").alias("vulnerable_id"), "fixed_id")


def curriculum(rows: DataFrame, key: list[str], complexity: list[str], one_per: str | None = None, limit: int | None = None) -> DataFrame:
    """Pairs of a vulnerable and a fixed row with one key, simplest first.

    Of several rows with one key and label, the last by seq stays. Order: the complexity columns, nulls last, then the
    first seq of the pair. one_per keeps the simplest pair of each value of that column. Other labels are ignored.
    """
    pairs = rows.groupBy(*key).agg(
        F.max_by("sample_id", F.when(F.col("label") == "vulnerable", F.col("seq"))).alias("vulnerable_id"), F.max_by("sample_id", F.when(F.col("label") == "fixed", F.col("seq"))).alias("fixed_id"),
        F.min("seq").alias("seq"), *[F.min(c).alias(c) for c in complexity],
    )
    pairs = pairs.where("vulnerable_id IS NOT NULL AND fixed_id IS NOT NULL")
    order = [F.asc_nulls_last(c) for c in complexity] + [F.asc("seq")]
    if one_per:
        pairs = pairs.withColumn("_place", F.row_number().over(Window.partitionBy(one_per).orderBy(*order))).where("_place = 1").drop("_place")
    pairs = pairs.orderBy(*order)
    return pairs.limit(limit) if limit else pairs


def label_of(c: Column) -> Column:
    """`vulnerable`, `fixed` or the cleaned text itself for any spelling of a label."""
    low = F.replace(F.lower(F.trim(c.cast("string"))), F.lit("_"), F.lit("-"))
    return F.when(low.isin("vulnerable", "vuln", "yes", "true", "1"), "vulnerable").when(low.isin("fixed", "non-vulnerable", "nonvulnerable", "safe", "false", "0"), "fixed").otherwise(low)


def quota(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def exclusion_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does."""
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in rules])


def excluded_projects(projects: DataFrame, patterns: Iterable[str], name: str = "project") -> DataFrame:
    """projects with the first pattern they match: exactly, as a glob, or as a part; null if none. Case is ignored."""
    low = F.lower(F.col(name))

    def matches(pattern: str) -> Column:
        p = pattern.lower()
        if any(c in p for c in "*?"):
            special = "".join("\\" + c if c in ".+()[]{}|^$\\" else {"*": ".*", "?": "."}.get(c, c) for c in p)
            return low.rlike(f"^{special}$")
        return (low == p) | F.contains(low, F.lit(p))

    return projects.withColumn("excluded_by", F.coalesce(*[F.when(matches(p), F.lit(p)) for p in patterns], F.lit(None)))


def shuffle(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in an order drawn from a hash of key and seed; the same on every run and cluster."""
    return rows.orderBy(F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key)


def train_test_split(samples: DataFrame, projects: int, order: list[Column]) -> DataFrame:
    """samples with `split`: of the first `projects` projects that have both labels, one row of each label is test.

    order ranks rows inside a project and label; projects rank by name.
    """
    both = samples.groupBy("project").agg(F.countDistinct("is_vulnerable").alias("labels")).where("labels = 2")
    chosen = both.orderBy("project").limit(projects).select("project", F.lit(True).alias("_chosen"))
    place = F.row_number().over(Window.partitionBy("project", "is_vulnerable").orderBy(*order))
    rows = samples.join(chosen, "project", "left").withColumn("_place", place)
    return rows.withColumn("split", F.when(F.col("_chosen") & (F.col("_place") == 1), TEST).otherwise(TRAIN)).drop("_place", "_chosen")


def pick_samples(samples: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), need_url: bool = False, ids: Iterable[str] = (), functions: Iterable[str] = (), vulnerable: int | None = None, safe: int | None = None, projects: int | None = None, limit: int | None = None) -> DataFrame:
    """The selection rules in their order: projects in, projects out, url, counts by label, smallest projects, ids, functions, limit."""
    named = lambda names: F.lower("project").isin(*[n.lower() for n in names]) | F.coalesce(F.lower("project_url").isin(*[n.lower() for n in names]), F.lit(False))
    rows = samples
    if include:
        rows = rows.where(named(list(include)))
    if exclude:
        rows = rows.where(~named(list(exclude)))
    if need_url:
        rows = rows.where(blank_to_null(F.col("project_url")).isNotNull())
    for flag, most in ((True, vulnerable), (False, safe)):
        if most is not None:
            wanted = rows.where(F.col("is_vulnerable") == flag).orderBy("seq").limit(most)
            rows = rows.where(F.col("is_vulnerable") != flag).unionByName(wanted)
    if projects:
        keep = rows.groupBy("project").count().orderBy("count", "project").limit(projects).select("project")
        rows = rows.join(keep, "project", "left_semi")
    if ids:
        rows = rows.where(F.col("sample_id").cast("string").isin(*ids))
    if functions:
        rows = rows.where(F.lower("func_name").isin(*[f.lower() for f in functions]))
    rows = rows.orderBy("seq")
    return rows.limit(limit) if limit else rows


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], on: str, values: list[str]) -> DataFrame:
    """rows with the values of the first of their keys that the table has; the table's `on` must be unique.

    Keys are exploded with their priority, so there is one join whatever their number.
    """
    # written out, so that both uses below see the same row numbers whatever rows come from
    wanted = checkpoint(rows.withColumn("_row", F.monotonically_increasing_id()))
    tried = wanted.select("_row", F.posexplode(F.array(*[F.col(k).cast("string") for k in keys])).alias("_rank", on))
    found = tried.join(table.select(on, F.struct(*values).alias("_v")), on).groupBy("_row").agg(F.min_by("_v", "_rank").alias("_v"))
    return reduce(lambda df, v: df.withColumn(v, F.col(f"_v.{v}")), values, wanted.join(found, "_row", "left")).drop("_row", "_v")


def size_score(byte_columns: list[str], count_columns: list[str]) -> Column:
    """The first known number of bytes, else a thousand for each thing counted; zero and null are unknown."""
    known = [F.when(F.col(c) > 0, F.col(c).cast("double")) for c in byte_columns]
    counted = sum((F.coalesce(F.col(c), F.lit(0)) for c in count_columns), F.lit(0)) * F.lit(1000.0)
    return F.coalesce(*known, F.when(counted > 0, counted))
