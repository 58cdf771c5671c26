"""Queries of facts about whole sources: each order stands for a source, each of its line items for a statement.

A statement's shape, names and numbers follow different columns, so sources differ from each other as orders do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import source_facts as sf
from arborlake.operators import waves
from arborlake.session import table

QUERIES, SQL = {}, {}

#: @ becomes one of three names, # another of them, and $ a number.
SHAPES = (
    "@ += length * itemsize;", "@ -= $;", "start = @;", "if (@ >= start) total++;", "if (@ == limit) return 0;", "return -1;", "char *@ = malloc($ * 8);", "@ = calloc($, sizeof(long));",
    "@ = realloc(@, $);", "if (!@) goto fail;", "if (@ == NULL) abort();", "memcpy(@, src, $);", "@[i] = 0;", "@->next = #;", "@ = safe_calloc($);", "fread(@, 1, $, in);",
    "temp = malloc(temp_size);", "if (i >= temp_size) grow();", "temp = realloc(temp, temp_size);", "if (temp) use(temp);", "@ = #;", "while (start <= @) step(@);", "log(@);", "@ += offset;",
)


def sources(spark: SparkSession, d: str) -> DataFrame:
    """(source, text) of every order that has a line item."""
    rows = table(spark, d, "lineitem")
    number = F.col("l_quantity").cast("int").cast("string")
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.pmod(F.col("l_partkey") + F.col("l_suppkey") * 5, F.lit(len(SHAPES))) + 1).cast("int"))
    name = lambda by: F.concat(F.lit("v"), F.pmod(by, F.lit(3)).cast("string"))
    line = F.replace(F.replace(F.replace(shape, F.lit("@"), name(F.col("l_partkey"))), F.lit("#"), name(F.col("l_suppkey"))), F.lit("$"), number)
    lines = rows.select(F.col("l_orderkey").alias("source"), F.struct("l_linenumber", line.alias("line")).alias("x"))
    # a source has as many lines as its order has items
    return lines.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("x")).getField("line"), "\n").alias("text"))


_LINES_SQL = (
    "shapes AS (SELECT [" + ", ".join("'" + s.replace("'", "''") + "'" for s in SHAPES) + "] AS s), "
    "l AS (SELECT l_orderkey AS k, l_linenumber AS n, replace(replace(replace(s[CAST((l_partkey + l_suppkey * 5) % 24 + 1 AS INT)], '@', 'v' || (l_partkey % 3)), '#', 'v' || (l_suppkey % 3)), '$', CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS line FROM lineitem, shapes), "
    "o AS (SELECT k, line, row_number() OVER (PARTITION BY k ORDER BY n, line) AS i FROM l), "
    "t AS (SELECT *, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS tail FROM o), "
    "src AS (SELECT k, string_agg(line, chr(10) ORDER BY i) AS text FROM o GROUP BY k)"
)

#: Patterns and names are typed out here, apart from those of the operator.
SQL["source_facts"] = rf"""
WITH {_LINES_SQL},
adv AS (
  SELECT k, i, regexp_extract(line, '\b([A-Za-z_]\w*)\s*(?:\+=|-=)\s*([^;]+);', 1) AS variable, regexp_extract(line, '\b([A-Za-z_]\w*)\s*(?:\+=|-=)\s*([^;]+);', 2) AS expression
  FROM o WHERE regexp_matches(line, '(\+=|-=)') AND regexp_matches(lower(line), '(\+=|-=).*(len|length|size|count|offset|index|<<|\*)')),
moved AS (SELECT k, variable, min(i) AS i FROM adv GROUP BY ALL),
saved AS (
  SELECT p.k, p.base, p.variable FROM (SELECT k, regexp_extract(line, '^(\w+) = (\w+);$', 1) AS base, regexp_extract(line, '^(\w+) = (\w+);$', 2) AS variable FROM o WHERE regexp_matches(line, '^\w+ = [a-z_]\w*;$')) p
  JOIN moved USING (k, variable)
  WHERE p.base <> p.variable AND EXISTS (SELECT 1 FROM o WHERE o.k = p.k AND regexp_matches(line, '^(if|while|for|assert)') AND (regexp_matches(line, '\b' || p.variable || '\s*>=\s*' || p.base || '\b') OR regexp_matches(line, '\b' || p.base || '\s*<=\s*' || p.variable || '\b')))),
accept AS (
  SELECT k, variable, regexp_extract(text, 'if\s*\(\s*' || variable || '\s*==\s*([A-Za-z_]\w*)\s*\)\s*\n?\s*return\b[\s\S]*?return\s+-1\s*;', 1) AS stop, i
  FROM moved JOIN src USING (k)),
first_accept AS (SELECT k, arg_min(variable, i) AS variable, arg_min(stop, i) AS stop FROM accept WHERE stop <> '' GROUP BY k),
raw AS (
  SELECT k, tail, regexp_extract(line, '([A-Za-z_]\w*)\s*=\s*(malloc|calloc|realloc)\s*\(([^;]+)\)\s*;', 1) AS variable, regexp_extract(line, '([A-Za-z_]\w*)\s*=\s*(malloc|calloc|realloc)\s*\(([^;]+)\)\s*;', 2) AS allocator,
         regexp_extract(line, '([A-Za-z_]\w*)\s*=\s*(malloc|calloc|realloc)\s*\(([^;]+)\)\s*;', 3) AS expression
  FROM t WHERE regexp_matches(line, '=\s*(malloc|calloc|realloc)\s*\(')),
used AS (
  SELECT * FROM raw
  WHERE regexp_matches(tail, '\b' || variable || '\s*\[|\b' || variable || '\s*->|\*\s*' || variable || '\b|(mem\w+|str\w+|snprintf|sprintf|fread|read|recv)\s*\(\s*' || variable || '\b')
    AND NOT regexp_matches(tail, 'if\s*\(\s*(!\s*)?' || variable || '\s*(==\s*NULL)?\s*\)')),
safe AS (SELECT k, variable, CAST(arg_max(size, i) AS BIGINT) AS size FROM (SELECT k, i, regexp_extract(line, '^(\w+) = safe_calloc\((\d+)\)', 1) AS variable, regexp_extract(line, '^(\w+) = safe_calloc\((\d+)\)', 2) AS size FROM o WHERE contains(line, 'safe_calloc')) GROUP BY ALL),
reads AS (SELECT k, regexp_extract(line, '^fread\((\w+), 1, (\d+),', 1) AS variable, CAST(regexp_extract(line, '^fread\((\w+), 1, (\d+),', 2) AS BIGINT) AS size FROM o WHERE line LIKE 'fread(%'),
grown AS (SELECT * FROM src WHERE contains(text, 'malloc(temp_size)') AND contains(text, 'realloc(temp, temp_size)')),
surface AS (SELECT * FROM src WHERE regexp_matches(text, '(?i)\b(parse|decode|load|read|seek|offset|length|size|count|header|object|packet|frame|token)\b')),
f AS (
  SELECT k, unnest(['state_or_pointer_advance_from_size_expression', 'pointer_advance_from_size_or_length']) AS fact_type, variable, expression, NULL AS base, NULL AS stop, NULL AS allocator, NULL AS allocation_size, NULL AS read_size FROM adv
  UNION ALL SELECT k, 'saved_base_lower_bound_guard', variable, NULL, base, NULL, NULL, NULL, NULL FROM saved
  UNION ALL SELECT k, 'exact_end_accept_else_error', variable, NULL, NULL, stop, NULL, NULL, NULL FROM first_accept
  UNION ALL SELECT k, 'raw_' || allocator || '_without_null_check_before_use', variable, expression, NULL, NULL, allocator, NULL, NULL FROM used
  UNION ALL SELECT k, 'safe_calloc_allocation_wrapper_used', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM src WHERE contains(text, 'safe_calloc')
  UNION ALL SELECT safe.k, 'bounded_read_within_safe_allocation', variable, NULL, NULL, NULL, NULL, safe.size, reads.size FROM safe JOIN reads USING (k, variable) WHERE reads.size < safe.size
  UNION ALL SELECT k, 'dynamic_buffer_growth_guard', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM grown WHERE contains(text, 'if (i >= temp_size)')
  UNION ALL SELECT k, 'unchecked_realloc_residual_risk', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM grown WHERE contains(text, 'temp = realloc(temp, temp_size)') AND NOT contains(text, 'if (temp)')
  UNION ALL SELECT k, unnest(['structured_input_or_state_machine_surface', 'parser_state_machine_surface']), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM surface
  UNION ALL SELECT k, 'length_offset_sensitive_operation', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM surface WHERE regexp_matches(text, '(?i)\b(length|len|size|count|offset|raw|buf|buffer)\b'))
SELECT k AS source, fact_type, variable, expression, base, stop, allocator, CAST(allocation_size AS BIGINT) AS allocation_size, CAST(read_size AS BIGINT) AS read_size FROM f
"""


def _source_facts(spark: SparkSession, d: str) -> DataFrame:
    return sf.source_facts(sources(spark, d), "text", ("source",)).drop("fact_id").withColumnRenamed("end", "stop")


QUERIES["source_facts"] = _source_facts


def _facts_by_type(spark: SparkSession, d: str) -> DataFrame:
    """How many sources and facts there are of each type."""
    return _source_facts(spark, d).groupBy("fact_type").agg(F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("facts"))


QUERIES["source_fact_counts"] = _facts_by_type
SQL["source_fact_counts"] = f"SELECT fact_type, count(DISTINCT source) AS sources, count(*) AS facts FROM ({SQL['source_facts']}) GROUP BY fact_type"


def _first_valid(spark: SparkSession, d: str) -> DataFrame:
    """Documents from the shortest on, checked against their labels until twelve sources have one of good quality."""
    good = table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("valid")).distinct()
    rows = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("size"))
    found = waves.first_valid(rows, [F.col("size"), F.col("doc_id")], lambda some: some.join(good, "doc_id", "left"), 12, "source")
    return found.select("doc_id", "place", "outcome")


QUERIES["first_valid_documents"] = _first_valid
SQL["first_valid_documents"] = """
WITH c AS (SELECT doc_id, source, row_number() OVER (ORDER BY length(text), doc_id) AS place, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS ok FROM documents),
f AS (SELECT source, min(place) AS first FROM c WHERE ok GROUP BY source),
s AS (SELECT CASE WHEN (SELECT count(*) FROM f) >= 12 THEN (SELECT max(first) FROM (SELECT first FROM f ORDER BY first LIMIT 12)) ELSE 9000000000 END AS stop)
SELECT doc_id, place, CASE WHEN place > stop THEN 'not_reached' WHEN place = first THEN 'selected' WHEN place > first THEN 'blocked' ELSE 'invalid' END AS outcome
FROM c LEFT JOIN f USING (source), s
"""
