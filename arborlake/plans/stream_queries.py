"""Queries that pass a whole table through a stream or a file format and read what it leaves, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.session import scratch, table
from arborlake.sources import arrow_files
from arborlake.streaming import events, sink

QUERIES, SQL = {}, {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def _as_events(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), "value")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    # a stream reads folders or patterns, and the table may be one file
    return _as_events(spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]"))


@_query(
    "streamed_states",
    "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS value, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, max(event_id) AS last_seq FROM events GROUP BY user_id",
)
def _(spark, d):
    """The state of each user, by a stream into a keyed table."""
    place = scratch(spark)
    events.run_to_table(events.reduce_stream(_stream(spark, d)), f"{place}/table", f"{place}/progress", 8)
    return sink.read_table(spark, f"{place}/table")


@_query(
    "recent_events",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events),
k AS (SELECT user_id, string_agg(event_id || ':' || event_type, ',' ORDER BY event_id) AS recent FROM r WHERE p <= 20 GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS key, recent, n FROM k JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) USING (user_id)""",
)
def _(spark, d):
    """The last twenty events of each user."""
    both = F.transform(F.arrays_zip("seqs", "statuses"), lambda x: F.concat(x["seqs"].cast("string"), F.lit(":"), x["statuses"]))
    return events.recent_snapshot(_as_events(table(spark, d, "events")), 20).select("key", F.array_join(both, ",").alias("recent"), "n")


@_query("arrow_copy", "SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem")
def _(spark, d):
    """Line items written as Arrow files and four of their columns read."""
    place = scratch(spark)
    arrow_files.write_arrow(table(spark, d, "lineitem"), place)
    return arrow_files.read_arrow(spark, place, ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"]).withColumn("l_quantity", F.col("l_quantity").cast("double"))
