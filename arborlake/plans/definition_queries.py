"""Queries of macro definitions: parts are definitions, orders are functions and their line items statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators import definitions
from arborlake.session import table

QUERIES, SQL = {}, {}


def _definitions(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.element_at(F.array(*map(F.lit, ("MAX_", "LEN", "FLAG_", "BUF_", "MODE"))), (F.col("p_size") % 5 + 1).cast("int")), (F.col("p_size") % 11).cast("string"))
    path = F.concat(F.lit("f"), (F.col("p_partkey") % 13).cast("string"), F.when(F.col("p_partkey") % 13 < 5, ".h").otherwise(".c"))
    text = F.concat(F.lit("#define "), name, F.lit(" "), (F.col("p_partkey") % 3).cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), path.alias("relpath"), F.when(F.col("p_partkey") % 17 > 0, F.col("p_partkey") % 10).alias("line"), text.alias("text"))


def _functions(spark: SparkSession, d: str) -> DataFrame:
    number = lambda n: F.pmod(F.col("l_partkey"), F.lit(n)).cast("string")
    line = F.concat(F.lit("x = MAX_"), number(12), F.lit(' + LEN'), number(7), F.lit(' - FLAG_'), number(13), F.lit(' * BUF_'), number(9), F.lit('; log("MODE1", \'A\'); // MODE2 /* MODE3'))
    items = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", line.alias("line")).alias("x"))
    text = F.array_join(F.array_sort(F.collect_list("x")).getField("line"), "\n")
    # as many lines as an order has items
    return items.groupBy("l_orderkey").agg(text.alias("text")).select(F.col("l_orderkey").alias("target"), F.concat(F.lit("f"), (F.col("l_orderkey") % 13).cast("string"), F.lit(".c")).alias("relpath"), "text")


def _macros(spark: SparkSession, d: str) -> DataFrame:
    return definitions.macro_definitions(_functions(spark, d), _definitions(spark, d))


QUERIES["macro_definitions"] = _macros
SQL["macro_definitions"] = """
WITH defs AS (
  SELECT p_partkey AS id, (['MAX_', 'LEN', 'FLAG_', 'BUF_', 'MODE'])[p_size % 5 + 1] || (p_size % 11) AS name, 'f' || (p_partkey % 13) || CASE WHEN p_partkey % 13 < 5 THEN '.h' ELSE '.c' END AS path,
    CASE WHEN p_partkey % 17 > 0 THEN p_partkey % 10 ELSE 1000000000 END AS line, p_partkey % 3 AS v FROM part),
used AS (SELECT DISTINCT l_orderkey AS target, unnest(['MAX_' || (l_partkey % 12), 'LEN' || (l_partkey % 7), 'FLAG_' || (l_partkey % 13), 'BUF_' || (l_partkey % 9)]) AS name FROM lineitem),
kinds AS (SELECT DISTINCT name, target % 13 AS own FROM used WHERE length(name) >= 3),
ranked AS (SELECT k.name, own, id, v, row_number() OVER (PARTITION BY k.name, own ORDER BY path <> 'f' || own || '.c', NOT path LIKE '%.h', line, id) AS r FROM kinds k JOIN defs USING (name)),
firsts AS (SELECT name, own, id, v FROM ranked WHERE r = 1),
seconds AS (SELECT r.name, r.own, arg_min(r.id, r.r) AS id FROM ranked r JOIN firsts f ON f.name = r.name AND f.own = r.own AND f.v <> r.v WHERE r.name LIKE 'MAX%' OR r.name LIKE 'LEN%' OR r.name LIKE 'BUF%' GROUP BY ALL),
picks AS (SELECT name, own, id, false AS extra FROM firsts UNION ALL SELECT name, own, id, true FROM seconds),
placed AS (SELECT target, name, id, extra, row_number() OVER (PARTITION BY target ORDER BY name LIKE 'FLAG%', name, extra) AS place FROM used u JOIN picks p USING (name) WHERE p.own = u.target % 13)
SELECT target, CAST(place AS INTEGER) AS place, name, id, extra FROM placed WHERE place <= 16
"""
