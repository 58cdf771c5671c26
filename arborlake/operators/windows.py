"""Ordered computations: predecessors, last definitions, as-of lookups, trailing windows, latest records, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.session import checkpoint


def previous(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the value of the row before in its group."""
    return rows.withColumn(name, F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def def_use(rows: DataFrame, by: list[str], order: list[str], spot: str, defines: str, uses: str) -> DataFrame:
    """(by, definition, use): for each use, the last definition up to and with its own row; a row's own definition gives no link."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_def", F.last(F.when(F.col(defines), F.col(spot)), ignorenulls=True).over(frame))
    return rows.where(F.col(uses) & F.col("_def").isNotNull() & (F.col("_def") != F.col(spot))).select(*by, F.col("_def").alias("definition"), F.col(spot).alias("use"))


def preceding_context(rows: DataFrame, by: list[str], order: list[str], value: str, n: int, name: str = "context") -> DataFrame:
    """rows with an array of the values of up to n rows before."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)
    return rows.withColumn(name, F.collect_list(value).over(frame))


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, value: list[str]) -> DataFrame:
    """left with the values of the last right row of its group at or before its time; equal times match.

    One sort by group and time over both sides together, so rows never meet in pairs.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.select(F.struct(*value)).schema[0].dataType))
    b = right.select(*by, time, F.struct(*value).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    frame = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_v", ignorenulls=True).over(frame)).where("_side = 1")
    return found.select(*left.columns, *[F.col(f"_last.{v}").alias(f"asof_{v}") for v in value])


def global_rank(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """rows with their place in a total order, from 1. Ranges are sorted by themselves; only a count for each range meets in one place.

    Rows that are equal in all of order share out their places in any way.
    """
    ranged = checkpoint(rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    # as many rows as the sort had ranges
    placed = ranged.join(F.broadcast(bases), "_part")
    return placed.withColumn(name, F.col("_base") + F.col("_at") - F.col("_first") + 1).select(*rows.columns, name)


def seconds(time: Column) -> Column:
    """A timestamp as whole seconds."""
    return F.unix_seconds(time.cast("timestamp"))


def trailing_counts(rows: DataFrame, by: list[str], at: str, spans: dict[str, int]) -> DataFrame:
    """rows with a count for each span of the rows of the group in the last n seconds, both ends included."""
    out = rows
    for name, n in spans.items():
        out = out.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy(at).rangeBetween(-n, 0)))
    return out


def required_wait(rows: DataFrame, by: list[str], at: str, limits: dict[int, int], margin: int = 1) -> DataFrame:
    """rows with `wait`: the longest time until each window of n seconds that is full to its limit has room again."""
    out, waits = rows, []
    for n, limit in limits.items():
        frame = Window.partitionBy(*by).orderBy(at).rangeBetween(-n, 0)
        out = out.withColumn(f"_used{n}", F.count(F.lit(1)).over(frame)).withColumn(f"_first{n}", F.min(at).over(frame))
        waits.append(F.when(F.col(f"_used{n}") >= limit, F.col(f"_first{n}") + n - F.col(at) + margin).otherwise(0))
    return out.withColumn("wait", F.greatest(*waits, F.lit(0)).cast("long")).drop(*[f"_{x}{n}" for n in limits for x in ("used", "first")])


def latest(rows: DataFrame, by: list[str], order: list[str], fresh: Column | None = None) -> DataFrame:
    """The last row of each group; then only fresh ones."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order]))
    out = rows.withColumn("_place", place).where("_place = 1").drop("_place")
    return out.where(fresh) if fresh is not None else out


def running_total(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value so far in the group."""
    return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def last_n(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order]))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def progress(rows: DataFrame, by: list[str], order: list[str], at: str, total: int) -> DataFrame:
    """rows with done so far, rate in rows a minute since the group's first, and seconds left at that rate (null at no rate)."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = rows.withColumn("done", F.row_number().over(w).cast("long")).withColumn("_first", F.first(at).over(w))
    elapsed = F.col(at) - F.col("_first")
    out = out.withColumn("rate", F.when(elapsed > 0, F.col("done") * 60.0 / elapsed))
    return out.withColumn("eta", F.when(F.col("rate") > 0, F.greatest(F.lit(total) - F.col("done"), F.lit(0)) * 60.0 / F.col("rate"))).drop("_first")


def stage_timeline(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, stage, started, done, seconds) from events (stage, kind start or done, at): each stage's first start and last end."""
    out = events.groupBy(*by, "stage").agg(F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("started"), F.max(F.when(F.col("kind") == "done", F.col("at"))).alias("done"))
    return out.withColumn("seconds", F.when(F.col("done") >= F.col("started"), F.col("done") - F.col("started")))


def next_boundary(rows: DataFrame, by: list[str], order: list[str], value: str, marks: str, name: str) -> DataFrame:
    """rows with the value of the first marked row after each."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(name, F.first(F.when(F.col(marks), F.col(value)), ignorenulls=True).over(frame))


def range_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, stop: str, most: int, order: list[Column], point_id: str) -> DataFrame:
    """Points with up to `most` spans of the same key that hold them, both ends included, in the given order.

    Only different places meet, and of spans with the same ends only the first `most`: points of one place have the same spans. Rows of one point_id share
    their `most` spans, so these are counted anew over the point's places.
    """
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    few = spans.withColumn("place", best(key, start, stop)).where(F.col("place") <= most).drop("place")
    spots = points.select(key, at).where(F.col(key).isNotNull() & F.col(at).isNotNull()).distinct()
    held = spots.join(few, key).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(stop)))
    held = held.withColumn("place", best(key, at)).where(F.col("place") <= most).drop("place")
    joined = points.join(held, [key, at])
    return joined.withColumn("place", best(point_id)).where(F.col("place") <= most)


def nearest_declaration(uses: DataFrame, declarations: DataFrame, key: list[str], use_id: str, line: str) -> DataFrame:
    """uses with the id of the last declaration of the same key at or before their line, else of the first one."""
    d = declarations.select(*key, F.col("decl_id"), F.col("decl_line"))
    joined = uses.join(d, key, "left")
    before = F.max_by("decl_id", F.when(F.col("decl_line") <= F.col(line), F.struct("decl_line", "decl_id")))
    return joined.groupBy(use_id).agg(F.coalesce(before, F.min_by("decl_id", F.struct("decl_line", "decl_id"))).alias("decl_id"))
