"""Queries of graph files that are written from the tables first and read back by splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.session import scratch, table
from arborlake.sources import graphs

QUERIES, SQL = {}, {}


def _dot(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of DOT files: a node for each customer and order, an edge from each customer to each of their orders. Labels hold line ends, marks and escaped quotes."""
    text = lambda c: F.col(c).cast("string")
    customers = table(spark, d, "customer").select(F.concat(F.lit('"c'), text("c_custkey"), F.lit('" [label="CUSTOMER"\n NAME="'), "c_name", F.lit(';\n{" CODE="say \\"['), "c_mktsegment", F.lit('\\"" LINE_NUMBER="'), text("c_custkey"), F.lit('"];')).alias("value"))
    orders = table(spark, d, "orders").select(F.concat(F.lit("o"), text("o_orderkey"), F.lit(" [label=ORDER, CODE=\"a -> b\"]; c"), text("o_custkey"), F.lit(" -> o"), text("o_orderkey"), F.lit(' [ label = "Placed" ]')).alias("value"))
    path = scratch(spark)
    customers.unionByName(orders).write.text(path)
    return graphs.dot_rows(spark, path)


QUERIES["dot_import"] = _dot
SQL["dot_import"] = """SELECT 'node' AS what, 'c' || c_custkey AS id, NULL AS other, 'CUSTOMER' AS label, c_name || ';' || chr(10) || '{' AS name, 'say "[' || c_mktsegment || '"' AS code, CAST(c_custkey AS INTEGER) AS line FROM customer
UNION ALL SELECT 'node', 'o' || o_orderkey, NULL, 'ORDER', NULL, 'a -> b', NULL FROM orders
UNION ALL SELECT 'edge', 'c' || o_custkey, 'o' || o_orderkey, 'Placed', NULL, NULL, NULL FROM orders"""
