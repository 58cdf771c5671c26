"""Queries of the rule sets, over statements made from events: each event stands for one statement of a small C vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.functions import rules, text
from arborlake.operators import evaluate, inventory, rank
from arborlake.session import table

QUERIES, SQL = {}, {}

#: Statements that every rule can be seen on; @ becomes a name that depends on the user.
STATEMENTS = (
    "if (@ == NULL) return -1;", "int @ = 0;", "char @[16];", "@ = malloc(count * size);", "free(@);", "strcpy(@, name);", "memcpy(@, src, len);", "for (i = 0; i < n; i++)",
    "@->next = head;", "*@ = value;", "@[i] = 0;", "return 0;", "while (@ < end)", "@ += length * itemsize;", "sprintf(@ + 4, \"%s\", s);", "snprintf(@, 16, \"%d\", n);",
    "gets(@);", "size_t @ = (size_t) raw;", "unsigned int @ = (int) x;", "assert(@ != 0);", "if (len > capacity) goto fail;", "x == @;", "@ <= limit;", "@++;", "switch (@)",
    "do", "system(@);", "recv(sock, @, 64, 0);", "fgets(@, 16, in);", "call(@);", "// strcpy(@, b);", "@ = @ + 1;", "total = rows * cols * @;", "else if (@ >= max)", "vsprintf(@, fmt, args);",
    "int contentlen = 0;", "unsigned contentlen = 0;", "int l = 0;", "unsigned l = 0;", "contentlen = atoi(@);", "sscanf(@, \"%u\", &contentlen);", "if (contentlen > LINESIZE * 4)",
    "while ((i = sockgetlinebuf(&sock, buf, LINESIZE - 1)) > 0)", "while (l < contentlen && (i = sockgetlinebuf(&s, buf, (contentlen - l) > LINESIZE - 1 ? LINESIZE - 1 : contentlen - l)) > 0)",
    "if (i > (contentlen - l)) i = (contentlen - l);", "buf[i] = 0;", "decodeurl(buf, 1);", "fprintf(writable, \"%s\", buf);", "buf = myalloc(LINESIZE);", "#define LINESIZE 4096", "execve(@, argv, envp);",
    "@ -= offset;", "for (;;)", "return @ * 2;", "realloc(@, size);", "pthread_mutex_lock(&@);",
)

_NAME = "'v' || (user_id % 7)"
STATEMENTS_SQL = (
    "t AS (SELECT ["
    + ", ".join("'" + s.replace("'", "''") + "'" for s in STATEMENTS)
    + f"] AS all_), s AS (SELECT event_id, user_id, user_id % 40 AS doc, value, event_type, replace(all_[event_id % {len(STATEMENTS)} + 1], '@', {_NAME}) AS code FROM events, t)"
)


def statements(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, user_id, doc, value, event_type, code): a statement for each event; the statements of a doc are one source."""
    chosen = F.element_at(F.array(*map(F.lit, STATEMENTS)), (F.col("event_id") % len(STATEMENTS) + 1).cast("int"))
    code = F.replace(chosen, F.lit("@"), F.concat(F.lit("v"), (F.col("user_id") % 7).cast("string")))
    return table(spark, d, "events").select("event_id", "user_id", (F.col("user_id") % 40).alias("doc"), "value", "event_type", code.alias("code"))


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _m(pattern: str, c: str = "code") -> str:
    return f"regexp_matches({c}, '{pattern}')"


#: The kinds without look-around: a lone equals sign has neither another nor a comparison beside it.
KIND_SQL = (
    f"CASE WHEN {_m('^return\\b')} THEN 'ReturnStatement' WHEN {_m('^if\\s*\\(|^else\\s+if\\s*\\(|^switch\\s*\\(')} THEN 'Condition' WHEN {_m('^(for|while)\\s*\\(|^do\\b')} THEN 'Loop' "
    f"WHEN regexp_matches(' ' || code || ' ', '[^=!<>]=[^=]') THEN 'Assignment' WHEN {_m('[+*/%&|^-]=|\\+\\+|--')} THEN 'OperatorExpression' ELSE 'Statement' END"
)


@_query("statement_kinds", f"WITH {STATEMENTS_SQL} SELECT event_id, {KIND_SQL} AS kind FROM s")
def _(spark, d):
    return statements(spark, d).select("event_id", text.statement_kind(F.col("code")).alias("kind"))


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_CONDITION, _LOOP = f"(kind = 'Condition' OR {_m('^\\s*(if|while|for)\\s*\\(')})", f"(kind = 'Loop' OR {_m('^\\s*(for|while)\\s*\\(')})"
_BUFFER = f"list_has_any(names, {_list(rules.BUFFER_CALLS)})"
_RULES_SQL = (
    ("pointer_dereference", f"(contains(code, '->') OR {_m('(^|[=,(;\\s])\\*\\s*[A-Za-z_]\\w+')})"),
    ("pointer_arithmetic", f"({_m('\\b[A-Za-z_]\\w*\\s*(?:\\+\\+|--|\\+\\s*\\d+|-\\s*\\d+)')} AND NOT {_m('\\b(return|case)\\b')})"),
    ("array_indexing", _m("\\b[A-Za-z_]\\w*\\s*\\[[^\\]]+\\]")),
    ("buffer_io_or_copy_call", _BUFFER),
    ("unchecked_buffer_api", f"list_has_any(names, {_list(rules.UNBOUNDED_CALLS)})"),
    ("buffer_call_without_obvious_size", f"({_BUFFER} AND NOT {_m('(?i)\\b(size|len|length|count|sizeof|capacity|limit|max)\\b')})"),
    ("allocation_or_free", f"list_has_any(names, {_list(rules.ALLOCATION_CALLS)})"),
    ("size_length_arithmetic", f"({_m('(?i)\\b(size|len|length|count|nbytes|capacity|limit|width|height|rows|cols)\\b')} AND {_m('[+*/-]')})"),
    ("multiplication_size_computation", f"({_m('(?i)\\b(size|len|length|count|nbytes|capacity|rows|cols)\\b')} AND contains(code, '*'))"),
    ("bounds_check", f"({_CONDITION} AND {_m('(<=|>=|<|>)')} AND {_m('(?i)\\b(size|len|length|count|i|idx|index|n|rows|cols)\\b')})"),
    ("null_check", f"({_CONDITION} AND {_m('(==|!=)\\s*(NULL|nullptr|0)\\b|!\\s*[A-Za-z_]\\w+')})"),
    ("sanitizer_like_guard", f"({_CONDITION} AND ({_m('\\b(assert|abort|exit)\\s*\\(')} OR {_m('\\b(return|goto)\\b')}))"),
    ("loop_over_buffer_or_range", f"({_LOOP} AND ({_m('(?i)\\b(size|len|length|count|rows|cols|i|idx|index|n)\\b')} OR contains(code, '[')))"),
    ("integer_cast", _m(f"\\(\\s*{rules.INTEGER_TYPES}\\s*\\)")),
    ("signed_unsigned_conversion", f"({_m('\\bunsigned\\b')} AND {_m('\\bsigned\\b|\\bint\\b')})"),
    ("error_return", f"({_m('^\\s*return\\b')} AND {_m('\\b(-1|NULL|nullptr|false|0)\\b')})"),
    ("nearby_guard_not_seen", f"({_BUFFER} AND NOT regexp_matches(context || chr(10) || code, '\\b(if|assert)\\b'))"),
)
_BEFORE = "coalesce(array_to_string(list(code) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), chr(10)), '')"


@_query(
    "statement_rules",
    f"WITH {STATEMENTS_SQL}, k AS (SELECT event_id, code, {KIND_SQL} AS kind, {_BEFORE} AS context, regexp_extract_all(code, '\\b([A-Za-z_]\\w*)\\s*\\(', 1) AS names FROM s), "
    "r AS (SELECT event_id, code, unnest(list_filter([" + ", ".join(f"CASE WHEN {holds} THEN '{rule}' END" for rule, holds in _RULES_SQL) + "], lambda x: x IS NOT NULL)) AS rule FROM k) "
    "SELECT event_id, rule, code AS evidence FROM r",
)
def _(spark, d):
    """All seventeen rules, with up to three statements of the same user before as context."""
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-3, -1)
    rows = statements(spark, d).withColumns({"kind": text.statement_kind(F.col("code")), "context": F.array_join(F.collect_list("code").over(before), "\n")})
    return rules.tag_statements(rows, keep=("event_id",)).select("event_id", "rule", "evidence")


_ENRICHED = {n: p for n, p in rules.ENRICHMENT}
_ADVANCE_SQL = (
    f"({_m('\\b([A-Za-z_]\\w*)\\s*(?:\\+\\+|--|\\+=|-=)')} OR len(list_filter(list_zip(regexp_extract_all(code, '\\b([A-Za-z_]\\w*)\\s*=\\s*([A-Za-z_]\\w*)\\s*[+\\-]', 1), "
    "regexp_extract_all(code, '\\b([A-Za-z_]\\w*)\\s*=\\s*([A-Za-z_]\\w*)\\s*[+\\-]', 2)), lambda x: x[1] = x[2])) > 0)"
)


@_query(
    "enrichment_facts",
    f"WITH {STATEMENTS_SQL}, f AS (SELECT event_id, 'POINTER_ADVANCE' AS fact FROM s WHERE {_ADVANCE_SQL} "
    + " ".join(f"UNION ALL SELECT event_id, '{n}' FROM s WHERE {_m(p)}" for n, p in rules.ENRICHMENT if n != "POINTER_ADVANCE")
    + ") SELECT * FROM f",
)
def _(spark, d):
    return rules.pattern_facts(statements(spark, d), "code", keep=("event_id",))


@_query("risky_api_hits", f"WITH {STATEMENTS_SQL}, a(api, cwe) AS (VALUES {', '.join(f"('{a}', '{c}')" for a, c in rules.RISKY_APIS)}) SELECT event_id, api, cwe FROM s JOIN a ON regexp_matches(code, '\\b' || api || '\\s*\\(')")
def _(spark, d):
    return rules.risky_calls(statements(spark, d), "code", ("event_id",))


@_query("safety_statements", f"WITH {STATEMENTS_SQL} SELECT event_id FROM s WHERE " + " OR ".join(f"contains(lower(code), '{w}')" for w in rules.SAFETY_WORDS))
def _(spark, d):
    rows = statements(spark, d)
    return rows.where(rules.is_safety(F.col("code"))).select("event_id")


def _every(names) -> str:
    return " AND ".join(names)


@_query(
    "source_audit",
    f"WITH {STATEMENTS_SQL}, f AS (SELECT doc, "
    + ", ".join(f"bool_or({_m('(?i)' + p)}) AS {n}" for n, p in rules.AUDIT_FACTS)
    + ", " + _every(f"bool_or(contains(code, '{w}'))" for w in rules.AUDIT_WORDS) + " AS present FROM s GROUP BY doc) "
    f"SELECT *, CASE WHEN present AND {_every(rules.AUDIT_UNSAFE)} AND NOT contentlen_cap THEN 'unsafe' WHEN present AND {_every(rules.AUDIT_SAFE)} THEN 'safe' WHEN present THEN 'ambiguous' ELSE 'not_present' END AS verdict FROM f",
)
def _(spark, d):
    return rules.source_audit(statements(spark, d), "doc", "code")


@_query(
    "unbounded_calls",
    f"WITH {STATEMENTS_SQL}, u AS (SELECT * FROM s WHERE NOT (starts_with(ltrim(code), '//') OR starts_with(ltrim(code), '/*'))) "
    + " UNION ALL ".join(f"SELECT event_id, '{k}' AS kind, unnest(regexp_extract_all(code, '{p}', 1)) AS symbol FROM u" for k, p in rules.UNBOUNDED),
)
def _(spark, d):
    return rules.unbounded_calls(statements(spark, d), "code", ("event_id",))


_ADVANCES = "\\b([A-Za-z_]\\w*)\\s*(\\+=|-=)\\s*([^;]+);"


@_query(
    "size_advances",
    f"WITH {STATEMENTS_SQL}, x AS (SELECT event_id, " + ", ".join(f"unnest(regexp_extract_all(code, '{_ADVANCES}', {i})) AS {n}" for i, n in ((1, "variable"), (2, "op"), (3, "expression"))) + " FROM s) "
    "SELECT event_id, variable, op, trim(expression) AS expression FROM x WHERE " + " OR ".join(f"contains(lower(expression), '{w}')" for w in rules.SIZE_LIKE),
)
def _(spark, d):
    return rules.size_advances(statements(spark, d), "code", ("event_id",))


@_query(
    "evidence_fact_catalogue",
    f"WITH {STATEMENTS_SQL}, f AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS fact, event_id FROM s WHERE {_m('(?i)' + p)}" for n, p in rules.AUDIT_FACTS) + ") SELECT fact, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM f GROUP BY fact",
)
def _(spark, d):
    return rules.fact_catalogue(statements(spark, d), "code", tuple((n, f"(?i){p}") for n, p in rules.AUDIT_FACTS), "event_id")


#: Kinds and relations of items, by event type, so that every role occurs.
_KINDS = {"click": "target_statement", "view": "caller_function", "purchase": "codekg_macro", "signup": "codekg_semanticfact", "error": "deterministic_source_fact"}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " ELSE ['codekg_function', 'codekg_assignment', 'other', 'codekg_functionparameter'][event_id % 4 + 1] END"
_RELATION_SQL = "CASE WHEN event_id % 11 = 0 THEN 'callee_of' WHEN event_id % 13 = 0 THEN 'caller_of' ELSE '' END"
_FUNCTION_SQL = "'f' || (user_id % 5)"
_ITEMS_SQL = f"{STATEMENTS_SQL}, i AS (SELECT event_id, user_id, code, {_KIND_SQL} AS kind, {_RELATION_SQL} AS relation, {_FUNCTION_SQL} AS function FROM s)"


def items(spark: SparkSession, d: str) -> DataFrame:
    """Statements with a kind, a relation and a function each, as items of evidence."""
    rows = statements(spark, d)
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _KINDS.items()], F.element_at(F.array(*map(F.lit, ("codekg_function", "codekg_assignment", "other", "codekg_functionparameter"))), (F.col("event_id") % 4 + 1).cast("int")))
    relation = F.when(F.col("event_id") % 11 == 0, "callee_of").when(F.col("event_id") % 13 == 0, "caller_of").otherwise("")
    return rows.select("event_id", "user_id", "code", kind.alias("kind"), relation.alias("relation"), F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")).alias("function"))


_RISKY_SQL = "(" + " OR ".join(f"contains(lower(code), '{m}')" for m in inventory.RISKY_MARKS) + ")"


@_query(
    "evidence_roles",
    f"WITH {_ITEMS_SQL} SELECT event_id, CASE WHEN kind = 'deterministic_source_fact' THEN 'deterministic_source_fact' WHEN kind = 'target_statement' OR function = 'f1' THEN CASE WHEN {_RISKY_SQL} THEN 'target_risky_operation_or_guard' ELSE 'target_context' END "
    "WHEN relation LIKE '%caller%' OR kind = 'caller_function' THEN 'caller_context' WHEN relation LIKE '%callee%' OR kind = 'callee_function' THEN 'callee_context' WHEN kind LIKE '%global%' OR kind LIKE '%macro%' OR kind LIKE '%constant%' THEN 'definition_or_constant' "
    "WHEN kind LIKE '%semanticfact%' THEN 'semantic_fact' WHEN kind LIKE '%function%' THEN 'related_function_context' WHEN kind LIKE '%assignment%' OR kind LIKE '%call%' OR kind LIKE '%control%' THEN 'statement_context' ELSE 'supporting_context' END AS role FROM i",
)
def _(spark, d):
    return items(spark, d).select("event_id", inventory.evidence_role(F.col("kind"), F.col("relation"), F.col("function"), F.lit("f1"), F.col("code")).alias("role"))


_NOISE_SQL = f"(kind IN ('codekg_query_summary', 'codekg_functionparameter') OR {_m(inventory.NOISY_DECLARATION)} OR code IN ({', '.join(f"'{m}'" for m in inventory.NOISY_MARKS)}))"


@_query("noisy_items", f"WITH {_ITEMS_SQL} SELECT event_id, {_NOISE_SQL} AS noisy FROM i")
def _(spark, d):
    return items(spark, d).select("event_id", inventory.noisy(F.col("code"), F.col("kind")).alias("noisy"))


def _has(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_HINT_SQL = _has("code", rank.OPERATOR_HINTS)


@_query(
    "evidence_prompt_score",
    f"WITH {_ITEMS_SQL} SELECT event_id, CAST(CASE WHEN {_NOISE_SQL} THEN -100 ELSE CASE WHEN kind = 'deterministic_source_fact' THEN 90 ELSE 0 END + CASE WHEN function = 'f1' THEN 70 ELSE 0 END + CASE WHEN kind = 'target_statement' THEN 45 ELSE 0 END "
    "+ CASE WHEN contains(relation, 'caller') OR kind = 'caller_function' THEN 55 ELSE 0 END + CASE WHEN contains(relation, 'callee') OR kind = 'callee_function' THEN 45 ELSE 0 END + CASE WHEN kind = 'codekg_function' THEN 40 ELSE 0 END "
    f"+ CASE WHEN {_has('lower(code)', rank.SECURITY_TERMS)} THEN 30 ELSE 0 END + CASE WHEN {_HINT_SQL} THEN 25 ELSE 0 END + CASE WHEN {_m('\\b(v2|contentlen)\\b')} THEN 35 ELSE 0 END "
    f"- CASE WHEN kind = 'target_statement' AND function = 'f2' AND NOT {_HINT_SQL} AND NOT {_has('code', ('if', 'for', 'while'))} THEN 70 ELSE 0 END END AS INTEGER) AS score FROM i",
)
def _(spark, d):
    symbol = F.col("code").rlike(r"\b(v2|contentlen)\b")
    noise = inventory.noisy(F.col("code"), F.col("kind"))
    score = rank.prompt_score(F.col("kind"), F.col("relation"), F.col("function"), F.lit("f1"), F.col("code"), symbol, F.col("function") == "f2", noise)
    return items(spark, d).select("event_id", score.cast("int").alias("score"))


@_query(
    "proof_families",
    f"WITH {STATEMENTS_SQL} SELECT event_id, CASE " + " ".join(f"WHEN {_m(p, 'lower(code)')} THEN '{n}'" for n, p in inventory.PROOF_FAMILIES) + f" ELSE '{inventory.OTHER_FAMILY}' END AS family FROM s",
)
def _(spark, d):
    return statements(spark, d).select("event_id", inventory.proof_family(F.col("code")).alias("family"))


#: Obligations by order: five names of which two speak of missing guards and one speaks against the hypothesis.
_NAMES = ("source_value", "missing_domain_guard", "missing_guard_or_invariant", "unsafe_use", "positive_counter_evidence")
_OBLIGATIONS_SQL = (
    f"o AS (SELECT o_custkey AS h, o_orderkey AS id, {_list(_NAMES)}[o_orderkey % 5 + 1] AS name, o_orderpriority < '4' AS required, o_orderkey % 5 = 4 AS against, "
    "CASE o_orderstatus WHEN 'F' THEN 'proven' WHEN 'O' THEN CASE WHEN o_totalprice > 300000 THEN 'refuted' ELSE 'proven' END END AS result FROM orders)"
)


def _obligations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = o.select(F.col("o_custkey").alias("hypothesis_id"), F.col("o_orderkey").alias("obligation_id"), name.alias("name"), (F.col("o_orderpriority") < "4").alias("required"), F.when(F.col("o_orderkey") % 5 == 4, "refutes_hypothesis").alias("polarity"))
    result = F.when(F.col("o_orderstatus") == "F", "proven").when(F.col("o_orderstatus") == "O", F.when(F.col("o_totalprice") > 300000, "refuted").otherwise("proven"))
    return rows, o.select(F.col("o_custkey").alias("hypothesis_id"), F.col("o_orderkey").alias("obligation_id"), result.alias("result")).where("result IS NOT NULL")


@_query(
    "proof_ledger",
    f"WITH {_OBLIGATIONS_SQL}, j AS (SELECT *, NOT against AND coalesce(result, '') = 'proven' AS supports, coalesce(result, '') = CASE WHEN against THEN 'proven' ELSE 'refuted' END AS refutes FROM o), "
    "a AS (SELECT h, count(*) FILTER (required) AS required, count(*) FILTER (required AND supports) AS proven, count(*) FILTER (required AND NOT supports) AS open, bool_or(refutes AND (required OR against)) AS refuted, "
    "bool_or(supports AND name LIKE 'missing%') AS guard FROM j GROUP BY h) "
    "SELECT h AS hypothesis_id, required, proven, open, refuted, CASE WHEN refuted THEN 'refuted' WHEN required > 0 AND proven = required THEN CASE WHEN c_nationkey % 2 = 0 THEN 'confirmed_source_level_vulnerability' ELSE 'confirmed_reachable_vulnerability' END "
    "WHEN proven >= 3 AND guard THEN 'high_signal_incomplete' ELSE 'incomplete' END AS tier FROM a JOIN customer ON c_custkey = h",
)
def _(spark, d):
    """A hypothesis for each customer, an obligation for each order."""
    family = F.when(F.col("c_nationkey") % 2 == 0, evaluate.SOURCE_LEVEL_FAMILY).otherwise("allocation_lifetime")
    hypotheses = table(spark, d, "customer").select(F.col("c_custkey").alias("hypothesis_id"), family.alias("family"), F.lit("source_level").alias("boundary"))
    return evaluate.ledger(*_obligations(spark, d), hypotheses)


_STATUSES = (*evaluate.UNSUPPORTED_STATUSES, "confirmed_vulnerability")


@_query(
    "hypothesis_downgrade",
    f"WITH h AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'confirmed_vulnerability' ELSE 'insufficient_evidence' END AS status, CASE p_size % 3 WHEN 0 THEN 'confirmed_reachable_vulnerability' ELSE 'incomplete' END AS tier, "
    f"{_list(_STATUSES)}[p_partkey % {len(_STATUSES)} + 1] AS rec, CASE WHEN p_retailprice > 1200 THEN 'weakens' ELSE 'none' END AS effect, p_partkey % 4 = 0 AS concrete FROM part), "
    f"w AS (SELECT *, rec IN ({', '.join(f"'{s}'" for s in evaluate.UNSUPPORTED_STATUSES)}) AND (status = 'confirmed_vulnerability' OR effect = 'weakens') AS wants, tier LIKE 'confirmed%' AS strong FROM h) "
    "SELECT id AS hypothesis_id, CASE WHEN NOT wants THEN status WHEN strong AND NOT concrete THEN 'confirmed_vulnerability' ELSE rec END AS status, "
    f"CASE WHEN NOT wants OR (strong AND NOT concrete) THEN tier WHEN rec IN ({', '.join(f"'{s}'" for s in evaluate.REFUTING_STATUSES)}) THEN 'refuted' WHEN strong THEN 'high_signal_incomplete' ELSE tier END AS tier FROM w",
)
def _(spark, d):
    """A hypothesis and a finding for each part."""
    p = table(spark, d, "part")
    status, tier = F.when(F.col("p_size") % 2 == 0, evaluate.CONFIRMED).otherwise("insufficient_evidence"), F.when(F.col("p_size") % 3 == 0, evaluate.CONFIRMED_TIERS[1]).otherwise("incomplete")
    recommended = F.element_at(F.array(*map(F.lit, _STATUSES)), (F.col("p_partkey") % len(_STATUSES) + 1).cast("int"))
    findings = p.select(F.col("p_partkey").alias("hypothesis_id"), F.lit(1).alias("seq"), recommended.alias("recommended"), F.when(F.col("p_retailprice") > 1200, "weakens").otherwise("none").alias("effect"), (F.col("p_partkey") % 4 == 0).alias("concrete"))
    return evaluate.downgrade(p.select(F.col("p_partkey").alias("hypothesis_id"), status.alias("status"), tier.alias("tier")), findings)
