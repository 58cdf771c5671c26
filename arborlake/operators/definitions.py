"""Definitions of the macros that a function uses: the nearest one, and for sizes one that shadows it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a name of a macro looks like, and what the names of sizes hold.
MACRO_NAME = r"\b[A-Z_][A-Z0-9_]{2,}\b"
SIZE_MARKS = ("SIZE", "LEN", "MAX", "MIN", "LIMIT", "BUFFER", "BUF")

# strings, characters and comments, by what comes first; an open comment runs to the end
_NO_CODE = r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)"


def macro_names(text: Column) -> Column:
    """The distinct names in a text that look like macros, outside of strings, characters and comments; none for null."""
    code = F.regexp_replace(F.coalesce(text, F.lit("")), _NO_CODE, " ")
    return F.array_distinct(F.regexp_extract_all(code, F.lit(MACRO_NAME), 0))


def is_size(name: Column) -> Column:
    """Whether a name is that of a size or bound."""
    return reduce(lambda a, b: a | b, [F.contains(name, F.lit(m)) for m in SIZE_MARKS])


def _best_two(definitions: DataFrame, by: list[str], name: str) -> DataFrame:
    # for each group its first definition, and the first whose text is another; texts are folded first, so a much defined name is small before it is shuffled
    one = definitions.groupBy(*by, "text").agg(F.min(F.struct("not_header", "line", "id")).alias("at"))
    ranked = one.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).where("_r <= 2")
    pick = lambda n: F.max(F.when(F.col("_r") == n, F.struct("at", "text")))
    return ranked.groupBy(*by).agg(F.array(pick(1), pick(2)).alias(name))


def macro_definitions(functions: DataFrame, definitions: DataFrame, most: int = 16) -> DataFrame:
    """(target, place, name, id, extra): the definitions to show with each function, at most `most`.

    functions are (target, relpath, text), one row each, definitions (id, name, relpath, line, text). Sizes come first, then names in
    order. Of a name's definitions one of the function's own file is best, then one of a header, then the least line (none counts as
    last), then the least id; a size whose next best definition with another text exists has that too (extra). Null paths and texts count as empty.

    A function meets four rows of a name at most, however often the name is defined.
    """
    empty = F.lit("")
    defs = definitions.where("name IS NOT NULL").select(
        "id", "name", F.coalesce("relpath", empty).alias("relpath"), F.coalesce(F.col("line"), F.lit(10**9)).cast("long").alias("line"), F.coalesce("text", empty).alias("text"))
    defs = defs.withColumn("not_header", (~F.endswith("relpath", F.lit(".h"))).cast("int"))
    # one file's definitions all are headers or none, so one order serves both
    near, far = _best_two(defs, ["name", "relpath"], "near"), _best_two(defs, ["name"], "far")
    wanted = functions.select("target", F.coalesce("relpath", empty).alias("relpath"), F.explode(macro_names(F.col("text"))).alias("name"))
    found = wanted.join(near, ["name", "relpath"], "left").join(far, "name")
    order = F.filter(F.concat(F.coalesce("near", F.array().cast(near.schema["near"].dataType)), F.col("far")), lambda d: d.isNotNull())
    first = F.element_at(order, 1)
    others = F.filter(order, lambda d: d["text"] != first["text"])
    size = is_size(F.col("name"))
    picks = F.when(size & (F.size(others) > 0), F.array(first, F.get(others, F.lit(0)))).otherwise(F.array(first))
    rows = found.select("target", "name", (~size).alias("_later"), F.posexplode(picks).alias("_pick", "d"))
    place = F.row_number().over(Window.partitionBy("target").orderBy("_later", "name", "_pick"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("target", "place", "name", F.col("d.at.id").alias("id"), (F.col("_pick") == 1).alias("extra"))
