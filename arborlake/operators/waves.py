"""Costly checks on few rows: candidates in order are checked in growing waves until enough have passed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.session import broadcast_if_small, checkpoint

#: Bits of monotonically_increasing_id that number the rows of a partition.
_ROW_BITS = 33


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with place: 1, 2, 3 ... in order, written out. Rows are sorted by range; a range's place is behind all earlier ones."""
    sorted_ = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS)
    # as many rows as there are ranges
    before, bases = 0, []
    for r in sorted_.groupBy(part.alias("_part")).count().orderBy("_part").collect():
        bases.append((r["_part"], before))
        before += r["count"]
    base = broadcast_if_small(rows.sparkSession.createDataFrame(bases, "_part long, _base long"))
    place = F.col("_base") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    return checkpoint(sorted_.withColumn("_part", part).join(base, "_part").select(*rows.columns, place.alias("place")))


def first_valid(candidates: DataFrame, order: list[Column], check: Callable[[DataFrame], DataFrame], wanted: int, group: str | None = None, first: int | None = None) -> DataFrame:
    """candidates with place, outcome and checked (whether it was checked at all): the result of going through them one by one.

    Going in order, a row whose group already has a selected one is `blocked`, a row that passes is `selected`, one that
    does not is `invalid`, and after `wanted` selected rows all others are `not_reached`. check(rows) gives the rows
    with a column valid; null counts as not. Rows are checked in waves of `first` rows, twice as many each time, so at
    most about as many rows are checked in vain as in earnest. Rows of a null group never block each other. order must
    tell all rows apart for reruns to agree. An empty table gives an empty result.
    """
    rows = placed(candidates, order)
    columns, low, size, chosen, out, groups = candidates.columns, 1, first or 2 * wanted, 0, [], None
    total = rows.count()
    while low <= total and chosen < wanted:
        wave = rows.where(F.col("place").between(low, low + size - 1))
        open_ = wave if groups is None else wave.join(broadcast_if_small(groups), group, "left_anti")
        judged = checkpoint(check(open_).select(*columns, "place", F.coalesce("valid", F.lit(False)).alias("valid")))
        passed = judged.where("valid")
        if group is not None:
            firsts = passed.where(F.col(group).isNotNull()).groupBy(group).agg(F.min("place").alias("_first"))
            passed = passed.select(group, "place").join(firsts, group, "left").where("_first IS NULL OR place = _first")
        # at most `wanted` rows
        taken = checkpoint(passed.select("place", *([group] if group else [])).orderBy("place").limit(wanted - chosen))
        found = taken.agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last")).first()
        chosen += found["n"]
        stop = found["last"] if chosen >= wanted else low + size - 1
        mark = broadcast_if_small(taken.select("place", F.lit(True).alias("_taken")))
        seen = judged.join(mark, "place", "left")
        if group is not None:
            before = broadcast_if_small(taken.where(F.col(group).isNotNull()).groupBy(group).agg(F.min("place").alias("_by")))
            seen = seen.join(before, group, "left")
            skipped = wave.join(broadcast_if_small(groups), group, "left_semi") if groups is not None else wave.where("false")
            out.append(skipped.select(*columns, "place", F.when(F.col("place") > stop, "not_reached").otherwise("blocked").alias("outcome"), F.lit(False).alias("checked")))
        blocked = F.coalesce(F.col("_by") < F.col("place"), F.lit(False)) if group is not None else F.lit(False)
        outcome = F.when(F.col("place") > stop, "not_reached").when(F.col("_taken"), "selected").when(blocked, "blocked").otherwise("invalid")
        out.append(seen.select(*columns, "place", outcome.alias("outcome"), F.lit(True).alias("checked")))
        if group is not None:
            new = taken.where(F.col(group).isNotNull()).select(group).distinct()
            groups = checkpoint(new if groups is None else groups.unionByName(new).distinct())
        low, size = low + size, size * 2
    out.append(rows.where(F.col("place") >= low).select(*columns, "place", F.lit("not_reached").alias("outcome"), F.lit(False).alias("checked")))
    return reduce(DataFrame.unionByName, out)
