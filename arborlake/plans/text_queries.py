"""Queries of the scalar functions over code, numbers, lists and log text, on values made from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlake.functions import code_text, similarity, text
from arborlake.operators import evaluate, lookup, select, windows
from arborlake.plans.rule_queries import STATEMENTS_SQL, statements
from arborlake.session import table
from arborlake.streaming import events as stream

QUERIES, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_TAIL = ' /* a */ s = "x // y"; // end'
_COMMENT = "starts_with(code, '//')"


@_query(
    "comment_masking",
    f"""WITH {STATEMENTS_SQL}, c AS (SELECT event_id, code, code || ' /* a */ s = "x // y"; // end' AS whole FROM s)
SELECT event_id, CASE WHEN {_COMMENT} THEN repeat(' ', length(whole)) ELSE code || '         s = "x ' || repeat(' ', 13) END AS masked,
CASE WHEN {_COMMENT} THEN repeat(' ', length(whole)) ELSE code || '         s = "x // y"; ' || repeat(' ', 6) END AS stripped FROM c""",
)
def _(spark, d):
    whole = F.concat("code", F.lit(_TAIL))
    return statements(spark, d).select("event_id", code_text.masked(whole).alias("masked"), code_text.stripped(whole).alias("stripped"))


@_query(
    "file_definitions",
    "WITH p AS (SELECT p_partkey, p_size FROM part), u AS (SELECT p_partkey, 'macro' AS kind, 'MAX_' || p_partkey AS name, p_size || ' + 1' AS value, 1 AS line FROM p UNION ALL SELECT p_partkey, 'constant', 'limit' || p_partkey, CAST(p_size AS VARCHAR), 2 FROM p UNION ALL SELECT p_partkey, 'enum', 'ONE', '1', 3 FROM p UNION ALL SELECT p_partkey, 'enum', 'TWO', '', 3 FROM p) SELECT p_partkey, kind, name, value, CAST(line AS INTEGER) AS line FROM u",
)
def _(spark, d):
    """Definitions of a file for each part: a macro, a constant named like a size, and two enum values."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    source = F.concat(F.lit("#define MAX_"), key, F.lit(" "), size, F.lit(" + 1 // c\nstatic const int limit"), key, F.lit(" = "), size, F.lit(";\nenum { ONE = 1, TWO };\nint other = 3;\n"))
    found = table(spark, d, "part").select("p_partkey", F.explode(code_text.definitions(source)).alias("x"))
    return found.select("p_partkey", "x.kind", "x.name", "x.value", "x.line")


_CALLS = "list_filter(regexp_extract_all(code, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in text.NOT_CALLS) + "))"
_LITERALS = """regexp_extract_all(code, '("(?:\\\\.|[^"\\\\])*"|''(?:\\\\.|[^''\\\\])*''|\\b(?:0[xX][0-9A-Fa-f]+|[0-9]+(?:\\.[0-9]+)?)\\b)', 1)"""


@_query(
    "statement_parts",
    f"""WITH {STATEMENTS_SQL} SELECT event_id, array_to_string({_CALLS}, ' ') AS calls, array_to_string({_LITERALS}, ' ') AS literals,
regexp_replace(regexp_replace(code, '//[^\\n]*', ' ', 'g'), '"(?:\\\\.|[^"\\\\])*"', '""', 'g') AS blanked, regexp_matches(code, '(^|[^A-Za-z0-9_])v2([^A-Za-z0-9_]|$)') AS uses_v2,
array_to_string(regexp_extract_all(code, '(?m)^[ \\t]*#[ \\t]*define[ \\t]+([A-Za-z_]\\w*)', 1), ' ') AS macros FROM s""",
)
def _(spark, d):
    c = F.col("code")
    return statements(spark, d).select(
        "event_id", F.array_join(text.call_names(c), " ").alias("calls"), F.array_join(text.literals(c), " ").alias("literals"), text.blank_literals(c).alias("blanked"),
        text.whole_word(c, "v2").alias("uses_v2"), F.array_join(text.macros(c), " ").alias("macros"),
    )


@_query(
    "type_and_path_functions",
    """SELECT p_partkey, lower(p_mfgr_) AS canonical, 'a/' || p_partkey || '/x.c,' || p_partkey || '/x.c,x.c' AS suffixes, 'owner/r' || p_partkey AS repo, 'n_' || p_partkey || '.c' AS safe, 'h' || p_partkey || '.h' AS includes
FROM (SELECT p_partkey, 'Node' || (p_partkey % 5) AS p_mfgr_ FROM part)""",
)
def _(spark, d):
    key = F.col("p_partkey").cast("string")
    kind = F.concat(F.lit("const struct Node"), (F.col("p_partkey") % 5).cast("string"), F.lit(" *"))
    return table(spark, d, "part").select(
        "p_partkey", F.lower(text.canonical_type(kind)).alias("canonical"), F.array_join(text.suffix_candidates(F.concat(F.lit("a\\"), key, F.lit("/x.c"))), ",").alias("suffixes"),
        text.repo_key(F.concat(F.lit("https://Host/Owner/R"), key, F.lit(".git/"))).alias("repo"), text.safe_name(F.concat(F.lit("n @"), key, F.lit(".c"))).alias("safe"),
        F.array_join(text.includes(F.concat(F.lit('int x;\n # include "h'), key, F.lit('.h"\n'))), ",").alias("includes"),
    )


@_query(
    "number_and_time_functions",
    """SELECT o_orderkey, CAST((o_orderkey % 30) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59 AS DOUBLE) AS seconds,
CASE WHEN o_orderkey % 30 > 0 THEN (o_orderkey % 30) || 'h' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || 'm' || lpad(CAST(o_orderkey % 59 AS VARCHAR), 2, '0') || 's'
WHEN o_orderkey % 60 > 0 THEN (o_orderkey % 60) || 'm' || lpad(CAST(o_orderkey % 59 AS VARCHAR), 2, '0') || 's' ELSE (o_orderkey % 59) || 's' END AS shown,
CAST(o_orderkey AS BIGINT) AS parsed, CAST(o_custkey AS BIGINT) AS digits, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS DOUBLE) END AS number, o_orderkey % 3 = 0 AS yes,
CASE WHEN o_orderkey % 900 < 1 THEN '0 B' ELSE (o_orderkey % 900) || ' B' END AS bytes, (o_orderkey % 900) || '.0 KB' AS kilobytes FROM orders""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    h, m, s = k % 30, k % 60, k % 59
    as_text = lambda c: c.cast("string")
    total = (h * 3600 + m * 60 + s).cast("long")
    return table(spark, d, "orders").select(
        "o_orderkey", text.duration_seconds(F.concat(as_text(h), F.lit("h"), as_text(m), F.lit("m"), as_text(s), F.lit("s"))).alias("seconds"), text.format_seconds(total).alias("shown"),
        text.safe_int(F.concat(F.lit(" "), as_text(k), F.lit(" "))).alias("parsed"), text.first_digits(F.concat(F.lit("id "), as_text(F.col("o_custkey")), F.lit("/7"))).alias("digits"),
        text.numeric(F.when(k % 2 == 0, as_text(k)).otherwise(F.concat(F.lit("-"), as_text(k)))).alias("number"), text.truthy(F.when(k % 3 == 0, " Yes ").otherwise("no")).alias("yes"),
        text.format_bytes((k % 900).cast("long")).alias("bytes"), F.when(k % 900 > 0, text.format_bytes((k % 900 * 1024).cast("long"))).otherwise(F.lit("0.0 KB")).alias("kilobytes"),
    )


@_query(
    "list_and_text_functions",
    """SELECT n_nationkey, n_name || ',' || n_nationkey || ',x' AS items, n_name || ',b' AS short, 'a ' || n_name || ' b' AS line, 'body ' || n_name AS unfenced,
CASE WHEN length(n_name) * 10 <= 60 THEN repeat(n_name, 10) ELSE left(repeat(n_name, 10), 15) || chr(10) || '... <truncated> ...' || chr(10) || right(repeat(n_name, 10), 15) END AS cut FROM nation""",
)
def _(spark, d):
    name, key = F.col("n_name"), F.col("n_nationkey").cast("string")
    return table(spark, d, "nation").select(
        "n_nationkey", F.array_join(text.norm_list(F.concat(F.lit("['"), name, F.lit("'; "), key, F.lit(',"x", ]'))), ",").alias("items"), F.array_join(text.short_list(F.array(name, name, F.lit("b"), F.lit("c")), 2), ",").alias("short"),
        text.one_line(F.concat(F.lit(" a\n"), name, F.lit("\t b "))).alias("line"), text.strip_code_fence(F.concat(F.lit("```c\nbody "), name, F.lit("\n```"))).alias("unfenced"), text.truncate_middle(F.repeat(name, 10), 60).alias("cut"),
    )


@_query(
    "log_and_header_functions",
    """SELECT event_id, 'run' AS tag, 'u' || user_id AS who, CAST(value AS VARCHAR) || '=x' AS note, 2 AS limits, '{"a": [1, {"b": ' || user_id || '}]}' AS closed FROM events""",
)
def _(spark, d):
    e = table(spark, d, "events")
    user, value = F.col("user_id").cast("string"), F.col("value").cast("string")
    tag, fields = text.log_fields(F.concat(F.lit("run | who=u"), user, F.lit(" | note="), value, F.lit("=x | loose")))
    headers = F.create_map(F.lit("X-RateLimit-Limit"), user, F.lit("Retry-After"), F.lit("3"), F.lit("Content-Type"), F.lit("x"))
    return e.select("event_id", tag.alias("tag"), fields["who"].alias("who"), fields["note"].alias("note"), F.size(text.rate_limit_headers(headers)).alias("limits"), text.close_json(F.concat(F.lit('{"a": [1, {"b": '), user, F.lit(","))).alias("closed"))


@_query("log_lines", "SELECT 'done' AS tag, CAST(event_id AS VARCHAR) AS id, event_type AS kind FROM events")
def _(spark, d):
    lines = table(spark, d, "events").select(F.concat(F.lit("done | id="), F.col("event_id").cast("string"), F.lit(" | kind="), F.col("event_type")).alias("value"))
    bad = lines.limit(3).select(F.lit("nothing here").alias("value"))
    return stream.parse_log(lines.unionByName(bad)).select("tag", F.col("fields")["id"].alias("id"), F.col("fields")["kind"].alias("kind"))


@_query(
    "quota_projection",
    "SELECT event_id, greatest(20 - sum(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id), 0)::BIGINT AS left_ FROM events",
)
def _(spark, d):
    status = F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type"))
    return stream.quota_left(table(spark, d, "events").withColumn("status", status), ["user_id"], ["event_id"], 20).select("event_id", F.col("left").cast("long").alias("left_"))


@_query(
    "known_failures",
    "SELECT event_id, event_type <> 'click' AND event_type <> 'view' AND event_id % 1000 <= 500 AS still FROM events",
)
def _(spark, d):
    status = F.when(F.col("event_type") == "click", "ok").otherwise("failed")
    error = F.when(F.col("event_type") == "view", "Read timed out").otherwise("no such file")
    return table(spark, d, "events").select("event_id", lookup.known_failure(status, error, F.lit(1000) - F.col("event_id") % 1000, F.lit(1000), 500).alias("still"))


@_query("role_projection", "SELECT c_custkey, c_name FROM customer")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    return evaluate.project_rows(rows, "student", ["c_acctbal", "c_nationkey"])


@_query(
    "stage_first_call",
    "SELECT s_suppkey AS stage, min(l_orderkey) AS seq FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 45 GROUP BY s_suppkey",
)
def _(spark, d):
    calls = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("stage"), F.col("l_orderkey").alias("seq"))
    return evaluate.stage_calls(table(spark, d, "supplier").select(F.col("s_suppkey").alias("stage")), calls).select("stage", F.col("call.seq").alias("seq"))


@_query("size_scores", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_size % 3 = 1 THEN CAST(p_partkey AS DOUBLE) WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_partkey % 4) * 1000.0 END AS score FROM part")
def _(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", F.when(size % 3 == 0, size).alias("a"), F.when(size % 3 == 1, key).otherwise(0).alias("b"), (key % 4).alias("n"))
    return rows.select("p_partkey", select.size_score(["a", "b"], ["n"]).alias("score"))


@_query("label_spellings", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'vulnerable' WHEN 1 THEN 'fixed' WHEN 2 THEN 'fixed' ELSE 'odd-one' END AS label FROM events")
def _(spark, d):
    spelled = F.element_at(F.array(F.lit(" VULN "), F.lit("Non_Vulnerable"), F.lit("0"), F.lit("Odd_One")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", select.label_of(spelled).alias("label"))


@_query("last_n_statements", f"WITH {STATEMENTS_SQL} SELECT user_id, event_id, code FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2")
def _(spark, d):
    return windows.last_n(statements(spark, d).select("user_id", "event_id", "code"), ["user_id"], ["event_id"], 2)


@_query(
    "similarity_of_equal_texts",
    "SELECT conv_id, turn, 'match_exact' AS status FROM conversations",
)
def _(spark, d):
    c = table(spark, d, "conversations")
    return similarity.validate_targets(c.select("conv_id", "turn", F.col("text").alias("found"), F.col("text").alias("wanted"))).select("conv_id", "turn", "status")
