"""Queries of facts that evidence packs show: events are items, those of one user a pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import pack_facts as p
from arborlake.plans.rule_queries import STATEMENTS_SQL, statements
from arborlake.session import table

QUERIES, SQL = {}, {}

#: Conclusions; @ becomes one of four names of what may be missing, or of something else.
CONCLUSIONS = (
    "The value of @ is missing.", "Critical facts are missing: the guard, and @, among others", "It seems that @ was checked. The rest is unknown", "All facts are there; @ too",
    "Not available here is\n@.", "We found nothing to say about @; unconfirmed remains the rest", "unknown, @", "@ cannot be told; it is absent",
)
NAMES = ("LINESIZE", "the buffer allocation", "the contentlen cap", "sockgetlinebuf", "the colour")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return p.pack_facts(statements(spark, d), ["user_id"], "code", "event_id")


def _digest(ids):
    return F.array_join(ids.cast("array<string>"), ",")


def _shown(spark: SparkSession, d: str) -> DataFrame:
    """The facts of each user's items."""
    return _facts(spark, d).select("user_id", "fact", "n", _digest(F.col("ids")).alias("ids"))


#: Every pattern is typed out here, apart from those of the operator, in the form of the other regex engine.
_FACTS_SQL = rf"""{STATEMENTS_SQL},
r(fact, pattern) AS (VALUES
  ('linesize_definition', '#\s*define\s+LINESIZE\b'), ('buf_allocation', '\bbuf\s*=\s*myalloc\s*\(\s*LINESIZE\s*\)'), ('contentlen_declaration', '\b(int|unsigned)\s+contentlen\s*=\s*0\b'),
  ('signed_contentlen_declaration', '\bint\s+contentlen\s*=\s*0\b'), ('unsigned_contentlen_declaration', '\bunsigned\s+contentlen\s*=\s*0\b'), ('signed_l_declaration', '\bint\s+l\s*=\s*0\b'),
  ('unsigned_l_declaration', '\bunsigned\s+l\s*=\s*0\b'), ('contentlen_cap', '(?i)\bif\s*\([^\n;]*contentlen[^\n;]*(linesize\s*\*|<=|>=|<|>)[^\n;]*\)'),
  ('upload_read_bound', '(?i)sockgetlinebuf\s*\([^;]*contentlen\s*-\s*l.*LINESIZE\s*-\s*1'), ('upload_unsafe_read_loop', '(?i)while\s*\(\s*\(\s*i\s*=\s*sockgetlinebuf\s*\([^;]*LINESIZE\s*-\s*1'),
  ('post_read_adjustment', '(?i)if\s*\(\s*i\s*>\s*\(?\s*contentlen\s*-\s*l\s*\)?\s*\)\s*i\s*=\s*\(?\s*contentlen\s*-\s*l'), ('contentlen_parse', '(?i)\bcontentlen\s*=\s*atoi|\bsscanf\s*\([^;]*contentlen'),
  ('decode_or_transform', '(?i)\bdecodeurl\s*\('), ('file_or_output_write', '(?i)\bfprintf\s*\([^;]*writable'), ('nul_write', '\bbuf\s*\[\s*i\s*\]\s*=\s*0\b')),
kinds AS (SELECT DISTINCT code FROM s),
hits AS (SELECT code, fact FROM kinds JOIN r ON regexp_matches(code, pattern)),
items AS (SELECT user_id, fact, event_id, row_number() OVER (PARTITION BY user_id, fact ORDER BY event_id) AS i FROM s JOIN hits USING (code)),
facts AS (SELECT user_id, fact, count(*) AS n, string_agg(event_id, ',' ORDER BY event_id) FILTER (i <= 4) AS ids FROM items GROUP BY ALL)"""

QUERIES["pack_facts"] = _shown
SQL["pack_facts"] = f"WITH {_FACTS_SQL} SELECT user_id, fact, n, ids FROM facts"


def _contradicted(spark: SparkSession, d: str) -> DataFrame:
    """Conclusions of each user that claim a shown fact to be missing."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))
    users = table(spark, d, "events").select("user_id").distinct()
    said = F.replace(pick(CONCLUSIONS, F.col("user_id")), F.lit("@"), pick(NAMES, F.floor(F.col("user_id") / 8)))
    found = p.contradicted_claims(users.select("user_id", said.alias("said")), _facts(spark, d), ["user_id"], "said")
    return found.select("user_id", "fact", "label", _digest(F.col("ids")).alias("ids"))


QUERIES["contradicted_claims"] = _contradicted
# five of the eight conclusions say that what they name is missing, and four of the five names speak of a fact
SQL["contradicted_claims"] = f"""WITH {_FACTS_SQL},
u AS (SELECT DISTINCT user_id, user_id % 8 AS form, (user_id // 8) % 5 AS name FROM events),
m(name, fact, label) AS (VALUES (0, 'linesize_definition', 'LINESIZE value/definition'), (1, 'buf_allocation', 'buf allocation/destination size'), (2, 'contentlen_cap', 'contentlen cap/range guard'), (3, 'upload_read_bound', 'upload read bound'))
SELECT user_id, fact, label, ids FROM u JOIN m USING (name) JOIN facts USING (user_id, fact) WHERE form IN (0, 1, 5, 6, 7)"""
