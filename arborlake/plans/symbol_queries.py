"""Queries of variables and of guarding and risky statements, over functions made from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import outline as o
from arborlake.operators import symbols
from arborlake.plans.outline_queries import _functions
from arborlake.session import written

QUERIES, SQL = {}, {}


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statements, variables, functions) of the orders' functions; the file of each is the order's key."""
    rows = o.outline(_functions(spark, d).select(F.col("o_orderkey").cast("string").alias("path"), "text"))
    # declared names are found once a statement and written with it
    rows = written(rows.withColumn("declared", F.when(F.col("idx") >= 0, o.declared(F.col("code")))))
    functions = rows.where("idx = -1")
    named = functions.select("file", "fn", F.explode(o.parameters(F.col("signature"))).alias("name"), "line", F.lit(-1).alias("idx"))
    local = rows.where("idx >= 0").select("file", "fn", F.col("declared").alias("name"), "line", "idx").where("name IS NOT NULL")
    variables = named.unionByName(local).groupBy("file", "fn", "name").agg(F.min_by("line", "idx").alias("line"))
    return rows.where("idx >= 0"), variables, functions


def _requests(functions: DataFrame, *names: str | None) -> DataFrame:
    symbol = F.explode(F.array(*[F.lit(n).cast("string") for n in names]))
    return functions.select("file", "fn", symbol.alias("symbol")).withColumns({"request": F.concat_ws(":", "file", "symbol"), "source_line": F.when(F.col("symbol") == "n", 10).cast("int")})


def _variables(spark: SparkSession, d: str) -> DataFrame:
    """All that each order's function does to four of its names, of which it declares three; n is asked for at line 10."""
    statements, variables, functions = _tables(spark, d)
    out = symbols.variable_statements(statements, variables, _requests(functions, "copy", "size", "n", "absent"), budgets=False)
    return out.select("request", "place", "category", "idx", "line", "declared_line")


QUERIES["variable_statements"] = _variables
# copies: line and place of what stands after the strcpy of F orders shift by one. n at line 10 means the declaration that `return n;` at line 8 counts as.
SQL["variable_statements"] = """WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS x FROM orders),
t(symbol, place, category, idx, line, declared_line, late, only_f) AS (VALUES
  ('copy', 1, 'declaration', -1, 6, 6, 0, 0), ('copy', 2, 'declaration', 2, 6, 6, 0, 0), ('copy', 3, 'allocation', 3, 7, 6, 0, 0), ('copy', 4, 'writes', 6, 10, 6, 0, 1), ('copy', 4, 'uses', 6, 10, 6, 1, 0),
  ('size', 1, 'declaration', -1, 2, 2, 0, 0), ('size', 2, 'sinks', 2, 6, 2, 0, 0), ('size', 3, 'uses', 0, 2, 2, 0, 0),
  ('n', 1, 'declaration', 4, 8, 8, 0, 0), ('n', 2, 'allocation', 6, 10, 8, 2, 0), ('n', 3, 'bounds_checks', 7, 11, 8, 2, 0))
SELECT k || ':' || symbol AS request, CAST(place + CASE WHEN late = 1 THEN x ELSE 0 END AS INTEGER) AS place, category, CAST(idx + CASE WHEN late > 0 THEN x ELSE 0 END AS INTEGER) AS idx, CAST(line + CASE WHEN late > 0 THEN x ELSE 0 END AS INTEGER) AS line, declared_line
FROM f, t WHERE only_f = 0 OR x = 1"""


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    """Guarding and risky statements of each order's function: all, and those that hold one of its names."""
    statements, _, functions = _tables(spark, d)
    requests = _requests(functions, None, "copy").withColumn("request", F.concat_ws(":", "file", F.coalesce("symbol", F.lit("*"))))
    parts = [symbols.flagged_statements(statements, requests, kind).select("request", F.lit(kind).alias("kind"), "place", "idx", "line") for kind in ("safety", "risk")]
    return parts[0].unionByName(parts[1])


QUERIES["flagged_statements"] = _flagged
SQL["flagged_statements"] = """WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS x FROM orders),
t(symbol, kind, place, idx, line, late, only_f) AS (VALUES ('*', 'safety', 1, 3, 7, 0, 0), ('*', 'safety', 2, 4, 8, 0, 0), ('*', 'safety', 3, 7, 11, 1, 0), ('copy', 'safety', 1, 3, 7, 0, 0),
  ('*', 'risk', 1, 2, 6, 0, 0), ('*', 'risk', 2, 6, 10, 0, 1), ('copy', 'risk', 1, 2, 6, 0, 0), ('copy', 'risk', 2, 6, 10, 0, 1))
SELECT k || ':' || symbol AS request, kind, place, CAST(idx + late * x AS INTEGER) AS idx, CAST(line + late * x AS INTEGER) AS line FROM f, t WHERE only_f = 0 OR x = 1"""
