"""Mixing sources to target weights along a time-varying curriculum.

Every source has a share of the mix and a schedule that says how its weight moves over training time. Integrating
the schedule gives the source's cumulative token demand; the documents of a source stand in a fixed shuffled order,
and inverting the demand at a document's token offset gives its training position. A source whose share exceeds its
size is repeated, up to max_repeats. Sorting by range of position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.texts import free_name, word_count
from arborlake.session import broadcast_if_small, checkpoint

WEIGHTS = (5.0, 2.0, 1.0)
#: Weight at the start and at the end of training for each of WEIGHTS, relative to the mean; linear in between.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
SHARE = 1.5
MAX_REPEATS = 2
#: Rows that are the same in every column beyond which one stands for all.
HOT = 4096


def _pick(values: tuple[float, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (index + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, n_docs, kind, target): the weighted share of each source, capped and reshared.

    Sources stand by code point, null last, and take the weights in turn. The caps are met by water-filling: sources
    are ordered by cap over weight and the first level that fits all later ones is the common level.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("place", order).withColumn("kind", F.pmod(F.col("place"), F.lit(len(weights))))
    sources = sources.withColumn("weight", _pick(weights, F.col("kind")))
    sources = sources.withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    sources = sources.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "place")
    sources = sources.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    sources = sources.withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    sources = sources.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("total") - F.col("full")) / F.col("open")
    sources = sources.withColumn("fits", F.when(level <= F.col("ratio"), level))
    sources = sources.withColumn("level", F.first("fits", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(F.col("level"), F.max("ratio").over(everything)))
    return sources.select("source", "source_size", "n_docs", "kind", target.alias("target"))


def inverse_demand(fraction: Column, start: Column, end: Column) -> Column:
    """Training time at which a linear schedule from start to end has asked for this fraction of its tokens."""
    mean = (start + end) / 2
    slope = end - start
    wanted = fraction * mean
    # start * t + slope * t^2 / 2 = wanted, in the form that is also exact for slope 0
    return 2 * wanted / (start + F.sqrt(F.greatest(start * start + 2 * slope * wanted, F.lit(0.0))))


def _whole(docs: DataFrame) -> list[Column]:
    """128 bits of a row's whole content, so that rows equal in them are the same in every column."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in docs.schema]
    return [F.xxhash64(*plain), F.xxhash64(F.lit("second"), *plain)]


def plan(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    schedules: tuple[tuple[float, float], ...] = SCHEDULES,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, positions (one for each time it is taken).

    A null text has size 0; a null source is a source of its own, last in order. Documents of size 0 are taken with
    the offset they stand at and count no words. A very long text is one document like any other. Repeated rows and
    ties in the shuffled order stand side by side and each row counts. An empty table gives an empty result. A copy of
    a document is taken if at least half of it lies below the target, so a source misses its target by at most half a
    document.
    """
    return _plan(docs.select("doc_id", "source", "text"), weights, schedules, share, max_repeats).drop("one", "two")


def _plan(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share=SHARE, max_repeats=MAX_REPEATS) -> DataFrame:
    """plan() with the identity (one, two) of each row. Texts are read once.

    Offsets are prefix sums in two levels: rows are dealt to ranges of (source, place), each with a number of its own
    so that a place which very many rows share is split too, and sums of a range's sources give its base.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    one, two = _whole(docs)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))
    sizes = docs.select(
        "doc_id", "source", key.alias("source_key"), word_count(F.col("text")).alias("size"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("place"),
        one.alias("one"), two.alias("two"), F.monotonically_increasing_id().alias("row"),
    )
    sizes = checkpoint(sizes)
    targets = source_targets(sizes, weights, share, max_repeats)
    targets = checkpoint(targets.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))).drop("source"))
    order = ["source_key", "place", "doc_id", "size", "one", "two", "row"]
    rows = checkpoint(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sums = rows.groupBy("source_key", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as there are ranges and sources
    sums = sums.select("source_key", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("base"))
    rows = rows.join(broadcast_if_small(checkpoint(sums)), ["source_key", "part"]).join(broadcast_if_small(targets), "source_key")
    inside = Window.partitionBy("source_key", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("offset", F.col("base") + F.sum("size").over(inside) - F.col("size"))
    start, end = (_pick(tuple(s[i] for s in schedules), F.pmod(F.col("kind"), F.lit(len(schedules)))) for i in (0, 1))

    def middle(copy: Column) -> Column:
        return copy * F.col("source_size") + F.col("offset") + F.col("size") / 2

    copies = F.filter(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: middle(e) <= F.col("target"))
    fraction = lambda e: F.when(F.col("target") > 0, middle(e) / F.col("target")).otherwise(0.0)
    positions = F.transform(copies, lambda e: inverse_demand(fraction(e), start, end))
    return rows.select("doc_id", "source", "size", "source_size", "target", positions.alias("positions"), "one", "two")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs in training order, each as often as it is taken; the columns of docs are unchanged.

    A row is matched to its own plan by all its columns. Rows that are the same in all of them are matched one to one;
    of more than HOT such rows one stands for all, as nothing tells them apart, and is written once for each place.
    """
    planned = checkpoint(_plan(docs, **options))
    names = [free_name(docs.columns, n) for n in ("one", "two", "shares", "share", "all", "at", "positions", "position")]
    one, two, shares, share, every, at, positions, position = names
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = _whole(docs)
    rows = docs.select(*columns, key[0].alias(one), key[1].alias(two))
    mine = planned.select(F.col("one").alias(one), F.col("two").alias(two), F.col("positions").alias(positions))
    times = mine.groupBy(one, two).agg(F.count(F.lit(1)).alias("n"))
    hot = checkpoint(times.where(F.col("n") > HOT).select(one, two, F.ceil(F.col("n") / HOT).cast("int").alias(shares)))
    crowded = not hot.isEmpty()
    usual = mine.join(broadcast_if_small(hot), [one, two], "left_anti") if crowded else mine
    usual = usual.groupBy(one, two).agg(F.array_sort(F.collect_list(positions)).alias(every))
    # the join leaves equal rows side by side, so numbering them takes neither exchange nor sort
    number = F.row_number().over(Window.partitionBy(one, two).orderBy(one, two))
    taken = rows.join(usual, [one, two]).withColumn(at, number).select(*columns, F.explode(F.element_at(every, F.col(at))).alias(position))
    if crowded:
        # at most a row for each HOT rows of the corpus, so it is broadcast only if that is few
        few = rows.join(broadcast_if_small(hot), [one, two]).groupBy(one, two).agg(F.any_value(F.struct(*columns)).alias("row"), F.any_value(shares).alias(shares))
        few = few.select("row", one, two, F.explode(F.sequence(F.lit(0), F.col(shares) - 1)).alias(share))
        many = mine.withColumn(at, F.monotonically_increasing_id()).join(broadcast_if_small(hot), [one, two]).withColumn(share, F.pmod(F.xxhash64(at), F.col(shares)).cast("int"))
        crowd = few.join(many.select(one, two, share, positions), [one, two, share]).select("row.*", F.explode(positions).alias(position))
        taken = taken.unionByName(crowd)
    return taken.repartitionByRange(F.col(position), F.col("doc_id")).sortWithinPartitions(position, "doc_id").select(*columns)


def query(docs: DataFrame) -> DataFrame:
    """The fixed report over a plan: what each document gives to the mix, and where it is first used."""
    rows = plan(docs)
    taken = (F.col("size") * F.size("positions")).cast("long")
    first = F.round(F.element_at(F.col("positions"), F.when(F.size("positions") > 0, 1)), 6)
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), first.alias("first_position"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         CASE rank % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a,
         CASE rank % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS b,
         CAST(source_size AS DOUBLE) * 2 AS cap FROM s),
o AS (
  SELECT *, cap / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken_up,
         sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w),
l AS (SELECT arg_min((total - taken_up) / open, (ratio, rank)) AS level FROM o WHERE (total - taken_up) / open <= ratio),
t AS (SELECT o.*, least(cap, weight * level) AS target FROM o, l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.a, t.b,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, CASE WHEN target > 0 THEN (off + size / 2.0::DOUBLE) / target ELSE 0 END * (a + b) / 2 AS wanted,
         (CASE WHEN off + size / 2.0::DOUBLE <= target THEN 1 ELSE 0 END) + (CASE WHEN source_size + off + size / 2.0::DOUBLE <= target THEN 1 ELSE 0 END) AS times
  FROM p)
SELECT doc_id, size, source_size, target, CAST(size * times AS BIGINT) AS taken,
       CASE WHEN times > 0 THEN round(2 * wanted / (a + sqrt(greatest(a * a + 2 * (b - a) * wanted, 0))), 6) END AS first_position
FROM q
"""
