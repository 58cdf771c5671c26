"""Queries of the tabular operators over the test tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import rules, text
from arborlake.operators import evaluate, rank, select, windows
from arborlake.session import table

QUERIES, SQL = {}, {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("idx", "code"))


LINES = "l AS (SELECT doc_id, lang, source, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS idx, unnest(string_split(text, chr(10))) AS code FROM documents)"
#: Patterns that mean the same to both regex engines.
FACTS = (("SHOUT", "[A-Z]{4,}!!"), ("NUMBER", "[0-9]{4,}"), ("LICENSE", "(?i)licen[sc]e"), ("SECRET", "token|api_key|password"), ("MAIL", "[a-z0-9.]+@[a-z0-9.]+"), ("MARK", "[#$%&*]{3}"))


@_query("statement_facts", f"WITH {LINES}, f AS (" + " UNION ALL ".join(f"SELECT doc_id, idx, '{n}' AS fact FROM l WHERE regexp_matches(code, '{p}')" for n, p in FACTS) + ") SELECT * FROM f")
def _(spark, d):
    return rules.pattern_facts(_lines(spark, d), "code", FACTS, ("doc_id", "idx"))


@_query("document_verdict", f"WITH {LINES} SELECT doc_id, " + ", ".join(f"bool_or(regexp_matches(code, '{p}')) AS {n.lower()}" for n, p in FACTS) + ", CASE WHEN bool_or(regexp_matches(code, '[0-9]{4,}')) AND bool_or(regexp_matches(code, '[#$%&*]{3}')) THEN 'suspicious' ELSE 'clear' END AS verdict FROM l GROUP BY doc_id")
def _(spark, d):
    return rules.verdict(_lines(spark, d), "doc_id", "code", tuple((n.lower(), p) for n, p in FACTS), ("number", "mark"))


@_query("identifier_extract", "WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)', 1), lambda x: NOT regexp_matches(x, '^[A-Z][A-Z0-9_]+$') AND x NOT IN (" + ", ".join(f"'{w}'" for w in text.NOT_CALLS) + ")))) AS ids FROM documents) SELECT doc_id, CAST(len(ids) AS INTEGER) AS n, md5(array_to_string(ids, ' ')) AS digest FROM w")
def _(spark, d):
    ids = text.identifiers(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(ids).alias("n"), F.md5(F.array_join(F.array_sort(ids), " ")).alias("digest"))


@_query("code_normalize", r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', ' ', 'g'), '//[^\n]*', ' ', 'g'), '\s+', ' ', 'g')) AS code FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.normalize_code(F.col("text")).alias("code"))


@_query("stable_ids", "SELECT p_partkey, substr(sha1(p_brand || '|' || p_type || '|' || p_partkey), 1, 16) AS id, CAST('0x' || substr(sha1(CAST(p_partkey AS VARCHAR)), 1, 15) AS BIGINT) % 16 AS bucket, regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.stable_id(F.col("p_brand"), F.col("p_type"), F.col("p_partkey")).alias("id"), text.hash_bucket(F.col("p_partkey"), 16).alias("bucket"), text.safe_name(F.col("p_name")).alias("safe"))


@_query("gold_statement_split", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, ';\s+', ';' || chr(10), 'g'), '\n+'), lambda p: regexp_replace(p, '^[ \t\r\n''"\[\]]+|[ \t\r\n''"\[\]]+$', '', 'g')), lambda p: p <> '') AS parts FROM documents) SELECT doc_id, CAST(len(parts) AS INTEGER) AS n, md5(array_to_string(parts, chr(10))) AS digest FROM s""")
def _(spark, d):
    parts = text.gold_statements(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(parts).alias("n"), F.md5(F.array_join(parts, "\n")).alias("digest"))


@_query("exact_content_match", f"WITH {LINES}, b AS (SELECT item_id, sha256(trim(unnest(string_split(text, chr(10))))) AS h FROM benchmark) SELECT DISTINCT item_id, doc_id, idx FROM l JOIN b ON sha256(trim(code)) = h")
def _(spark, d):
    bench = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("line")).select("item_id", F.sha2(F.trim("line"), 256).alias("h"))
    return _lines(spark, d).withColumn("h", F.sha2(F.trim("code"), 256)).join(bench, "h").select("item_id", "doc_id", "idx").distinct()


_EVIDENCE = rf"{LINES}, e AS (SELECT source, doc_id * 1000 + idx AS evidence_id, lang AS role, md5(concat_ws('|', coalesce(lang, ''), coalesce(source, ''), lower(trim(regexp_replace(coalesce(code, ''), '\s+', ' ', 'g'))))) AS key, length(code) % 100 AS score, code AS text FROM l)"


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("source", (F.col("doc_id") * 1000 + F.col("idx")).alias("evidence_id"), F.col("lang").alias("role"), rank.dedupe_key(F.col("lang"), F.col("source"), F.col("code")).alias("key"), (F.length("code") % 100).alias("score"), F.col("code").alias("text"))


_CURATED = _EVIDENCE + """, a AS (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY score DESC, evidence_id) AS c FROM e WHERE score >= 20),
b AS (SELECT *, row_number() OVER (PARTITION BY source, role ORDER BY score DESC, evidence_id) AS r FROM a WHERE c = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, evidence_id) AS place FROM b WHERE r <= CASE role WHEN 'en' THEN 10 WHEN 'fr' THEN 4 ELSE 6 END)"""


@_query("evidence_quota_topk", f"WITH {_CURATED} SELECT source, evidence_id, role, score, CAST(place AS INTEGER) AS place FROM k WHERE place <= 20")
def _(spark, d):
    return rank.curate(_evidence(spark, d), ["source"], 20, {"en": 10, "fr": 4}, 6, 20).select("source", "evidence_id", "role", "score", "place")


@_query("evidence_omitted", f"WITH {_CURATED}, o AS (SELECT * FROM e WHERE evidence_id NOT IN (SELECT evidence_id FROM k WHERE place <= 20)) SELECT source, CASE WHEN trim(text) = '' THEN 'empty_text' WHEN score < 20 THEN 'low_relevance' ELSE 'duplicate_or_limit' END AS reason, count(*) AS n FROM o GROUP BY ALL")
def _(spark, d):
    rows = _evidence(spark, d)
    return rank.omitted(rows, rank.curate(rows, ["source"], 20, {"en": 10, "fr": 4}, 6, 20), ["source"])


@_query("evidence_ranking", "SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 100 ELSE 50 END + CASE WHEN contains(lower(text), 'the') THEN 35 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 35 ELSE 0 END + CASE WHEN text <> '' THEN 15 ELSE 0 END AS INTEGER) AS score FROM documents")
def _(spark, d):
    weight = F.when(F.col("lang") == "en", 100).otherwise(50)
    return table(spark, d, "documents").select("doc_id", rank.evidence_score(weight, F.col("text"), ["the", "license"]).alias("score"))


@_query("category_budget_topk", "WITH a AS (SELECT user_id % 20 AS g, event_type AS category, CAST(value * 100 AS BIGINT) AS score, event_id, row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY CAST(value * 100 AS BIGINT) DESC, event_id) AS p FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY CASE category WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, score DESC, event_id) AS place FROM a WHERE p <= CASE category WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 4 END) SELECT g, category, event_id, CAST(place AS INTEGER) AS place FROM b WHERE place <= 10")
def _(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 20).alias("g"), F.col("event_type").alias("category"), F.round(F.col("value") * 100).cast("long").alias("score"), "event_id")
    return rank.category_budget(rows, ["g"], {"click": 3, "view": 2}, 4, 10, ["click", "error"], "event_id").select("g", "category", "event_id", "place")


@_query("definition_rank", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'signup' DESC, event_type = 'error' DESC, value DESC, event_id) AS p FROM events) WHERE p = 1")
def _(spark, d):
    rows = table(spark, d, "events")
    return rank.best_definition(rows, ["user_id"], [F.desc(F.col("event_type") == "signup"), F.desc(F.col("event_type") == "error"), F.desc("value")], "event_id").select("user_id", "event_id", "event_type")


@_query("best_candidate", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS p FROM events) WHERE p = 1")
def _(spark, d):
    return rank.stable_top(table(spark, d, "events"), ["user_id"], [F.col("value")], "event_id", ["event_id", "value"])


@_query("boosted_capsules", "WITH b(kind, obligation, boost) AS (VALUES ('click', 'reach', 30), ('view', 'reach', 10), ('click', 'guard', 5), ('error', 'guard', 40)), j AS (SELECT e.user_id % 10 AS g, obligation, event_id AS evidence_id, event_type AS role, event_id % 50 AS key, event_id % 97 + boost AS total FROM events e JOIN b ON b.kind = e.event_type), c AS (SELECT *, row_number() OVER (PARTITION BY g, obligation, key ORDER BY total DESC, role, evidence_id) AS p FROM j), k AS (SELECT *, row_number() OVER (PARTITION BY g, obligation ORDER BY total DESC, role, evidence_id) AS place FROM c WHERE p = 1) SELECT g, obligation, evidence_id, total, CAST(place AS INTEGER) AS place FROM k WHERE place <= 4")
def _(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 10).alias("g"), F.col("event_type").alias("kind"), F.col("event_type").alias("role"), F.col("event_id").alias("evidence_id"), (F.col("event_id") % 50).alias("key"), (F.col("event_id") % 97).alias("score"))
    boosts = spark.createDataFrame([("click", "reach", 30), ("view", "reach", 10), ("click", "guard", 5), ("error", "guard", 40)], "kind string, obligation string, boost int")
    return rank.boosted(rows, boosts, ["g"], 4).select("g", "obligation", "evidence_id", "total", "place")


@_query("staged_pack", "WITH s AS (SELECT l_suppkey % 10 AS g, l_partkey AS evidence_id, 0 AS stage FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_suppkey % 10, l_partkey, 1 FROM lineitem WHERE l_linestatus = 'O'), f AS (SELECT g, evidence_id, min(stage) AS stage FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY stage, evidence_id) AS place FROM f) SELECT g, evidence_id, CAST(stage AS INTEGER) AS stage, CAST(place AS INTEGER) AS place FROM k WHERE place <= 40")
def _(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("g"), F.col("l_partkey").alias("evidence_id"), "l_returnflag", "l_linestatus")
    stages = [rows.where(w).select("g", "evidence_id") for w in ("l_returnflag = 'R'", "l_linestatus = 'O'")]
    return rank.staged_pack(stages, ["g"], "evidence_id", 40)


CATEGORIES = [("writes", "[A-Z]{4,}!!", 5), ("uses", "[0-9]{4,}", 3), ("sinks", "[#$%&*]{3}", 4)]


@_query("variable_categories", f"WITH {LINES}, c AS (" + " UNION ALL ".join(f"SELECT source, doc_id * 1000 + idx AS id, '{c}' AS category, {n} AS most FROM l WHERE regexp_matches(code, '{p}')" for c, p, n in CATEGORIES) + "), k AS (SELECT *, row_number() OVER (PARTITION BY source, category ORDER BY id) AS p FROM c) SELECT source, id, category FROM k WHERE p <= most")
def _(spark, d):
    rows = _lines(spark, d).select("source", (F.col("doc_id") * 1000 + F.col("idx")).alias("id"), "code")
    return rank.categorize(rows, "code", CATEGORIES, ["source"], "id").select("source", "id", "category")


@_query("table_search_page", "SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(concat_ws(' ', p_partkey, p_name, p_brand, p_type, p_size)), 'brand') ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 20 OFFSET 40")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return rank.table_page(rows, "brand", "p_size", True, 40, 20, "p_partkey").select("p_partkey", "p_name", "p_size")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("idx"), F.col("o_orderkey").alias("sample_id"), F.col("c_mktsegment").alias("project"),
        F.when(F.col("c_nationkey") % 3 > 0, F.concat(F.lit("u"), (F.col("c_nationkey") % 5).cast("string"))).otherwise(" ").alias("project_url"),
        F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(F.col("o_orderpriority")).alias("commit_id"), (F.col("c_custkey") % 40).cast("string").alias("filepath"),
        (F.col("c_custkey") % 7).cast("string").alias("func_name"), (F.col("o_orderstatus") == "F").alias("is_vulnerable"), F.round(F.col("o_totalprice")).cast("long").alias("size"),
    )


SAMPLES = "s AS (SELECT o_orderkey AS seq, o_orderkey AS sample_id, c_mktsegment AS project, CASE WHEN c_nationkey % 3 > 0 THEN 'u' || (c_nationkey % 5) ELSE NULL END AS url, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS commit_id, CAST(c_custkey % 40 AS VARCHAR) AS filepath, CAST(c_custkey % 7 AS VARCHAR) AS func_name, o_orderstatus = 'F' AS is_vulnerable, CAST(round(o_totalprice) AS BIGINT) AS size FROM orders JOIN customer ON o_custkey = c_custkey)"


@_query("project_summary", f"WITH {SAMPLES} SELECT project, arg_min(url, seq) FILTER (url IS NOT NULL) AS project_url, count(*) AS samples, count(*) FILTER (is_vulnerable) AS vulnerable, count(*) FILTER (NOT is_vulnerable) AS safe, count(DISTINCT commit_id) AS commits, count(DISTINCT filepath) AS files FROM s GROUP BY project")
def _(spark, d):
    return select.project_stats(_samples(spark, d))


@_query("group_project_commit", f"WITH {SAMPLES} SELECT coalesce(url, project) AS project_key, coalesce(commit_id, 'unknown_commit') AS commit_key, count(*) AS n, min(sample_id) AS first_id FROM s GROUP BY ALL")
def _(spark, d):
    return select.by_project_commit(_samples(spark, d))


@_query("vuln_fixed_pairs", f"WITH {SAMPLES}, f AS (SELECT coalesce(url, project) AS k, filepath, func_name, arg_min(sample_id, seq) AS fixed_id FROM s WHERE NOT is_vulnerable GROUP BY ALL) SELECT s.sample_id AS vulnerable_id, f.fixed_id FROM s JOIN f ON f.k = coalesce(s.url, s.project) AND f.filepath = s.filepath AND f.func_name = s.func_name WHERE is_vulnerable")
def _(spark, d):
    return select.fixed_pairs(_samples(spark, d))


@_query("curriculum_select", f"WITH {SAMPLES}, p AS (SELECT project, filepath, func_name, arg_max(sample_id, seq) FILTER (is_vulnerable) AS vulnerable_id, arg_max(sample_id, seq) FILTER (NOT is_vulnerable) AS fixed_id, min(seq) AS q, min(size) AS size FROM s GROUP BY ALL HAVING count(*) FILTER (is_vulnerable) > 0 AND count(*) FILTER (NOT is_vulnerable) > 0) SELECT project, vulnerable_id, fixed_id, size FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY size, q) AS r FROM p) WHERE r = 1 ORDER BY size, q LIMIT 3")
def _(spark, d):
    rows = _samples(spark, d).withColumn("label", select.label_of(F.col("is_vulnerable")))
    rows = rows.withColumn("label", F.when(F.col("is_vulnerable"), "vulnerable").otherwise("fixed"))
    return select.curriculum(rows, ["project", "filepath", "func_name"], ["size"], "project", 3).select("project", "vulnerable_id", "fixed_id", "size")


@_query("train_test_split", f"WITH {SAMPLES}, b AS (SELECT project FROM s GROUP BY project HAVING count(DISTINCT is_vulnerable) = 2 ORDER BY project LIMIT 3) SELECT sample_id, CASE WHEN project IN (SELECT project FROM b) AND row_number() OVER (PARTITION BY project, is_vulnerable ORDER BY size, sample_id) = 1 THEN 'test' ELSE 'train' END AS split FROM s")
def _(spark, d):
    return select.train_test_split(_samples(spark, d), 3, [F.asc("size"), F.asc("sample_id")]).select("sample_id", "split")


@_query("challenge_quota", f"WITH {SAMPLES} SELECT project, is_vulnerable, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY project, is_vulnerable ORDER BY size, sample_id) AS p FROM s) WHERE p <= 5")
def _(spark, d):
    return select.quota(_samples(spark, d), ["project", "is_vulnerable"], [F.asc("size"), F.asc("sample_id")], 5).select("project", "is_vulnerable", "sample_id")


@_query("sample_selection", f"WITH {SAMPLES}, a AS (SELECT * FROM s WHERE lower(project) NOT IN ('building') AND url IS NOT NULL), v AS ((SELECT * FROM a WHERE is_vulnerable ORDER BY seq LIMIT 50) UNION ALL SELECT * FROM a WHERE NOT is_vulnerable), p AS (SELECT project FROM v GROUP BY project ORDER BY count(*), project LIMIT 2) SELECT sample_id, project FROM v WHERE project IN (SELECT project FROM p) ORDER BY seq LIMIT 400")
def _(spark, d):
    return select.pick_samples(_samples(spark, d), exclude=["building"], need_url=True, vulnerable=50, projects=2, limit=400).select("sample_id", "project")


@_query("candidate_exclusion_reason", "SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice > 300000 THEN 'too_large' END AS reason FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    reason = select.exclusion_reason([("negative", F.col("c_acctbal") < 0), ("pending", F.col("o_orderstatus") == "P"), ("too_large", F.col("o_totalprice") > 300000)])
    return rows.select("o_orderkey", reason.alias("reason"))


@_query("project_exclusion", "SELECT DISTINCT p_type AS project, CASE WHEN regexp_matches(lower(p_type), '^.*steel$') THEN '*STEEL' WHEN contains(lower(p_type), 'promo') THEN 'promo' END AS excluded_by FROM part")
def _(spark, d):
    return select.excluded_projects(table(spark, d, "part").select(F.col("p_type").alias("project")).distinct(), ["*STEEL", "promo"])


@_query("inventory_lookup", "WITH t AS (SELECT n_name AS k, n_nationkey AS v FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_nationkey + 100 FROM nation) SELECT s_suppkey, CAST(coalesce((SELECT v FROM t WHERE k = s_name), (SELECT v FROM t WHERE k = CAST(s_nationkey AS VARCHAR))) AS INTEGER) AS v FROM supplier")
def _(spark, d):
    nations = table(spark, d, "nation")
    known = nations.select(F.col("n_name").alias("k"), F.col("n_nationkey").alias("v")).unionByName(nations.select(F.col("n_nationkey").cast("string").alias("k"), (F.col("n_nationkey") + 100).alias("v")))
    return select.lookup(table(spark, d, "supplier"), known, ["s_name", "s_nationkey"], "k", ["v"]).select("s_suppkey", "v")


@_query("seeded_shuffle", "SELECT p_partkey, row_number() OVER (ORDER BY sha1(p_partkey || '|7'), p_partkey) AS place FROM part")
def _(spark, d):
    order = [F.sha1(F.concat_ws("|", F.col("p_partkey").cast("string"), F.lit("7"))), F.col("p_partkey")]
    return windows.global_rank(select.shuffle(table(spark, d, "part").select("p_partkey"), "p_partkey", 7), order)


def _predictions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 3 == 0).alias("is_vulnerable"), "lang")
    labels = table(spark, d, "labels").select(
        F.col("doc_id").alias("sample_id"), (F.col("quality") == 1).alias("is_vulnerable"),
        F.when(F.col("doc_id") % 7 == 0, "inconclusive").when(F.col("quality") == 1, "vulnerable").otherwise("non_vulnerable").alias("decision_status"),
        F.when(F.col("doc_id") % 11 == 0, "bad json").otherwise("").alias("parse_error"),
    )
    return docs, labels


OUTCOMES = "o AS (SELECT d.doc_id AS sample_id, d.doc_id % 3 = 0 AS truth, l.quality = 1 AS pred, CASE WHEN l.doc_id IS NULL THEN 'MISSING' WHEN l.doc_id % 7 = 0 OR l.doc_id % 11 = 0 THEN 'INVALID' WHEN d.doc_id % 3 = 0 AND l.quality = 1 THEN 'TP' WHEN d.doc_id % 3 <> 0 AND l.quality <> 1 THEN 'TN' WHEN l.quality = 1 THEN 'FP' ELSE 'FN' END AS outcome, d.lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
_COUNTS = ", ".join(f"count(*) FILTER (outcome = '{n}') AS {n.lower()}" for n in ("TP", "TN", "FP", "FN", "INVALID", "MISSING"))
_DIV = "CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE {e} END"


def _div(a: str, b: str, e: str = "0.0") -> str:
    return _DIV.format(a=a, b=b, e=e)


def _rate_sql(e: str) -> str:
    return f"{_div('(tp + tn)', '(tp + tn + fp + fn)', e)} AS accuracy, {_div('tp', '(tp + fp)', e)} AS precision, {_div('tp', '(tp + fn)', e)} AS recall, {_div('(2 * tp)', '(2 * tp + fp + fn)', e)} AS f1"


@_query("outcomes", f"WITH {OUTCOMES} SELECT sample_id, truth, CASE WHEN pred IS NULL THEN 'none' WHEN pred THEN 'yes' ELSE 'no' END AS pred, outcome FROM o")
def _(spark, d):
    rows = evaluate.outcomes(*_predictions(spark, d))
    return rows.withColumn("pred", F.when(F.col("pred").isNull(), "none").when(F.col("pred"), "yes").otherwise("no"))


@_query("binary_metrics_strict", f"WITH {OUTCOMES}, c AS (SELECT {_COUNTS} FROM o) SELECT c.*, tp + tn + fp + fn AS n_valid, tp + tn + fp + fn + invalid + missing AS n_total, {_rate_sql('0.0')}, {_div('tn', '(tn + fp)')} AS specificity, {_div('(tp + tn)', '(tp + tn + fp + fn + invalid + missing)')} AS accuracy_all, {_div('fp', '(fp + tn)')} AS false_positive_rate, {_div('fn', '(fn + tp)')} AS false_negative_rate, ({_div('tp', '(tp + fn)')} + {_div('tn', '(tn + fp)')}) / 2 AS balanced_accuracy FROM c")
def _(spark, d):
    return evaluate.binary_metrics(evaluate.outcomes(*_predictions(spark, d)))


@_query("binary_metrics_compat", f"WITH {OUTCOMES}, c AS (SELECT count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND NOT pred) AS tn, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn FROM o WHERE pred IS NOT NULL) SELECT c.*, {_rate_sql('0.0')} FROM c")
def _(spark, d):
    return evaluate.compatible_metrics(evaluate.outcomes(*_predictions(spark, d)))


@_query("live_metrics_null_denominator", f"WITH r AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'failed' WHEN event_type = 'signup' THEN 'inconclusive' WHEN event_type = 'error' THEN 'skipped' ELSE 'completed' END AS state FROM events), c AS (SELECT count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state = 'inconclusive') AS inconclusive, count(*) FILTER (state = 'completed' AND user_id % 2 = 0 AND value > 50) AS tp, count(*) FILTER (state = 'completed' AND user_id % 2 <> 0 AND NOT value > 50) AS tn, count(*) FILTER (state = 'completed' AND user_id % 2 <> 0 AND value > 50) AS fp, count(*) FILTER (state = 'completed' AND user_id % 2 = 0 AND NOT value > 50) AS fn FROM r) SELECT c.*, {_rate_sql('NULL')} FROM c")
def _(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "error").when(kind == "signup", "abstain").when(kind == "error", "skipped_repo").otherwise("done")
    rows = table(spark, d, "events").select(status.alias("status"), F.lit(None).cast("boolean").alias("forced"), (F.col("value") > 50).alias("pred"), (F.col("user_id") % 2 == 0).alias("truth"))
    return evaluate.live_metrics(rows)


@_query("submission_score", f"WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS correct FROM labels JOIN documents USING (doc_id) WHERE lang = 'en') SELECT c.*, {_div('correct', 'n')} AS accuracy FROM c")
def _(spark, d):
    rows = table(spark, d, "labels")
    return evaluate.submission_score(rows.select(F.col("doc_id").alias("sample_id"), F.col("quality").alias("label")), rows.join(table(spark, d, "documents").where("lang = 'en'"), "doc_id", "left_semi").select(F.col("doc_id").alias("sample_id"), F.col("toxic").alias("prediction")))


@_query("usage_summary", f"WITH u AS (SELECT conv_id % 5 AS g, length(text) AS p, CASE WHEN role = 'user' THEN NULL ELSE turn END AS c, role = 'user' AS e FROM conversations), a AS (SELECT g, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(c, 0)) AS BIGINT) AS completion_tokens, CAST(sum(p + coalesce(c, 0)) AS BIGINT) AS total_tokens, CAST(sum(p * 2) AS BIGINT) AS cost, bool_and(e) AS estimated, count(*) AS n FROM u GROUP BY g) SELECT a.*, {_div('total_tokens', 'n')} AS avg_tokens, {_div('cost', 'n')} AS avg_cost FROM a")
def _(spark, d):
    rows = table(spark, d, "conversations").select(
        (F.col("conv_id") % 5).alias("g"), F.length("text").alias("prompt_tokens"), F.when(F.col("role") != "user", F.col("turn")).alias("completion_tokens"),
        (F.length("text") + F.when(F.col("role") != "user", F.col("turn")).otherwise(0)).alias("total_tokens"), (F.length("text") * 2).alias("cost"), (F.col("role") == "user").alias("estimated"),
    )
    return evaluate.usage_summary(rows, ["g"])


@_query("runtime_rollup", f"WITH a AS (SELECT event_type, count(*) AS n, CAST(sum(event_id % 100) AS BIGINT) AS seconds, max(event_id % 100) AS most_seconds FROM events GROUP BY event_type) SELECT a.*, {_div('seconds', 'n')} AS avg_seconds, {_div('(n * 60)', 'seconds')} AS per_minute FROM a")
def _(spark, d):
    return evaluate.runtime_rollup(table(spark, d, "events").select("event_type", (F.col("event_id") % 100).alias("seconds")), ["event_type"])


@_query("projection_grid", "WITH s AS (SELECT count(*) AS per_sample, count(DISTINCT user_id) AS per_project FROM events) SELECT CAST(a AS INTEGER) AS samples, CAST(b AS INTEGER) AS projects, per_sample * a + per_project * b AS seconds FROM s, (SELECT unnest([5, 10, 50, 100]) AS a), (SELECT unnest([5, 50, 100]) AS b)")
def _(spark, d):
    one = table(spark, d, "events").agg(F.count(F.lit(1)).alias("per_sample"), F.countDistinct("user_id").alias("per_project"))
    return evaluate.projection_grid(one, [5, 10, 50, 100], [5, 50, 100])


@_query("proof_gate", "WITH c AS (SELECT l_orderkey AS h, count(*) AS n, count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)) AS missing FROM lineitem GROUP BY ALL) SELECT o_orderkey AS hypothesis_id, coalesce(n, 0) > 0 AND coalesce(missing, 0) = 0 AND o_orderstatus <> 'P' AS passes FROM orders LEFT JOIN c ON h = o_orderkey")
def _(spark, d):
    cited = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("hypothesis_id")).agg(F.collect_list("l_partkey").alias("cited"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("hypothesis_id"), F.when(F.col("o_orderstatus") == "P", " ").otherwise("x").alias("claim")).join(cited, "hypothesis_id", "left")
    rows = rows.withColumn("cited", F.coalesce("cited", F.array().cast("array<bigint>")))
    return evaluate.proof_gate(rows, ["claim"], table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("evidence_id"))).select("hypothesis_id", "passes")


@_query("registry_violations", "SELECT p_partkey AS kg_id, unnest(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'no_registry' END, CASE WHEN p_partkey % 5 = 0 THEN 'no_label' END, CASE WHEN p_partkey % 7 = 0 THEN 'no_graph' END], lambda x: x IS NOT NULL)) AS violation FROM part")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("kg_id"))
    return evaluate.registry_check(p, *[p.where(f"kg_id % {n} <> 0") for n in (3, 5, 7)])


@_query("id_leaks", "SELECT p_partkey, p_name AS kg_id FROM part WHERE contains(lower(p_name), 'steel') OR contains(lower(p_name), '7')")
def _(spark, d):
    return evaluate.leaks(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("kg_id")), ["steel", "7"])


@_query("hypothesis_dedupe", "SELECT signature, score, seq FROM (SELECT l_partkey AS signature, CAST(l_quantity AS BIGINT) AS score, l_orderkey * 10 + l_linenumber AS seq, row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_quantity AS BIGINT) DESC, l_orderkey * 10 + l_linenumber) AS p FROM lineitem) WHERE p = 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("signature"), F.col("l_quantity").cast("long").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return evaluate.dedupe_hypotheses(rows)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))


EVENTS = "e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"


@_query("prev_statement", "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def _(spark, d):
    return windows.previous(table(spark, d, "conversations"), ["conv_id"], ["turn"], "turn", "previous").select("conv_id", "turn", "previous")


@_query("last_def_use", "WITH x AS (SELECT *, last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS d FROM events) SELECT user_id, d AS definition, event_id AS use FROM x WHERE event_type <> 'view' AND d IS NOT NULL AND d <> event_id")
def _(spark, d):
    rows = table(spark, d, "events").withColumns({"defines": F.col("event_type").isin("signup", "error"), "uses": F.col("event_type") != "view"})
    return windows.def_use(rows, ["user_id"], ["ts", "event_id"], "event_id", "defines", "uses")


@_query("asof_declaration", "WITH d AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id, ts) SELECT e.event_id, d.event_id AS asof_decl FROM events e ASOF LEFT JOIN d ON d.user_id = e.user_id AND d.ts <= e.ts")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    declared = rows.where("event_type IN ('signup', 'error')").groupBy("user_id", "ts").agg(F.max("event_id").alias("decl"))
    return windows.as_of(rows.drop("event_type"), declared, ["user_id"], "ts", ["decl"]).select("event_id", "asof_decl")


@_query("preceding_context3", "SELECT conv_id, turn, coalesce(array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS context FROM conversations")
def _(spark, d):
    rows = windows.preceding_context(table(spark, d, "conversations"), ["conv_id"], ["turn"], "turn", 3)
    return rows.select("conv_id", "turn", F.array_join(F.transform("context", lambda x: x.cast("string")), ",").alias("context"))


@_query("sliding_request_usage", f"WITH {EVENTS} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS minute, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS hour, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day FROM e")
def _(spark, d):
    return windows.trailing_counts(_events(spark, d), ["user_id"], "at", {"minute": 60, "hour": 3600, "day": 86400}).select("event_id", "minute", "hour", "day")


@_query("required_wait", f"WITH {EVENTS}, u AS (SELECT *, count(*) OVER h AS n1, min(sec) OVER h AS f1, count(*) OVER g AS n2, min(sec) OVER g AS f2 FROM e WINDOW h AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW), g AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)) SELECT event_id, greatest(CASE WHEN n1 >= 2 THEN f1 + 3600 - sec + 1 ELSE 0 END, CASE WHEN n2 >= 4 THEN f2 + 86400 - sec + 1 ELSE 0 END, 0) AS wait FROM u")
def _(spark, d):
    return windows.required_wait(_events(spark, d), ["user_id"], "at", {3600: 2, 86400: 4}).select("event_id", "wait")


@_query("latest_per_key_ttl", f"WITH {EVENTS} SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) AS p, max(sec) OVER () AS now FROM e) WHERE p = 1 AND now - sec <= 86400 AND event_type <> 'error'")
def _(spark, d):
    rows = _events(spark, d)
    now = rows.agg(F.max("at").alias("now"))
    fresh = (F.col("now") - F.col("at") <= 86400) & (F.col("event_type") != "error")
    return windows.latest(rows.crossJoin(F.broadcast(now)), ["user_id"], ["at", "event_id"], fresh).select("user_id", "event_id", "event_type")


@_query("running_totals", "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM conversations")
def _(spark, d):
    rows = table(spark, d, "conversations").withColumn("n", F.length("text"))
    return windows.running_total(rows, ["conv_id"], ["turn"], "n", "so_far").select("conv_id", "turn", "so_far")


@_query("recent_calls", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p <= 20")
def _(spark, d):
    return windows.last_n(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id")


@_query("progress_eta", f"WITH {EVENTS}, p AS (SELECT event_id, row_number() OVER w AS done, sec - first_value(sec) OVER w AS elapsed FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)) SELECT event_id, done, round(CASE WHEN elapsed > 0 THEN done * 60.0::DOUBLE / elapsed END, 6) AS rate, round(CASE WHEN elapsed > 0 THEN greatest(100 - done, 0) * 60.0::DOUBLE / (done * 60.0::DOUBLE / elapsed) END, 3) AS eta FROM p")
def _(spark, d):
    return windows.progress(_events(spark, d), ["user_id"], ["at", "event_id"], "at", 100).select("event_id", "done", F.round("rate", 6).alias("rate"), F.round("eta", 3).alias("eta"))


@_query("stage_timeline", f"WITH {EVENTS}, t AS (SELECT user_id, event_id % 4 AS stage, min(sec) FILTER (event_type = 'view') AS started, max(sec) FILTER (event_type = 'purchase') AS done FROM e WHERE event_type IN ('view', 'purchase') GROUP BY ALL) SELECT *, CASE WHEN done >= started THEN done - started END AS seconds FROM t")
def _(spark, d):
    rows = _events(spark, d).where("event_type IN ('view', 'purchase')").select("user_id", (F.col("event_id") % 4).alias("stage"), F.when(F.col("event_type") == "view", "start").otherwise("done").alias("kind"), "at")
    return windows.stage_timeline(rows, ["user_id"])


@_query("next_boundary", "SELECT event_id, min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS boundary FROM events")
def _(spark, d):
    rows = table(spark, d, "events").withColumn("marks", F.col("event_type") == "signup")
    return windows.next_boundary(rows, ["user_id"], ["event_id"], "event_id", "marks", "boundary").select("event_id", "boundary")


@_query("overlay_range_join", "SELECT point_id, span_id, CAST(place AS INTEGER) AS place FROM (SELECT l_orderkey * 10 + l_linenumber AS point_id, p_partkey * 100 + p_size AS span_id, row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY p_size, p_partkey) AS place FROM lineitem JOIN part ON p_partkey % 200 = l_partkey % 200 AND l_quantity BETWEEN p_size AND p_size + 10) WHERE place <= 3")
def _(spark, d):
    points = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), (F.col("l_partkey") % 200).alias("k"), F.col("l_quantity").alias("at"))
    spans = table(spark, d, "part").select((F.col("p_partkey") * 100 + F.col("p_size")).alias("span_id"), "p_partkey", (F.col("p_partkey") % 200).alias("k"), F.col("p_size").alias("a"), (F.col("p_size") + 10).alias("b"))
    return windows.range_join(points, spans, "k", "at", "a", "b", 3, [F.asc("a"), F.asc("p_partkey")], "point_id").select("point_id", "span_id", "place")


@_query("nearest_declaration", "WITH d AS (SELECT user_id, event_id FROM events WHERE event_type = 'signup') SELECT u.event_id AS use_id, coalesce(max(d.event_id) FILTER (d.event_id <= u.event_id), min(d.event_id)) AS decl_id FROM events u LEFT JOIN d ON d.user_id = u.user_id WHERE u.event_type = 'error' GROUP BY u.event_id")
def _(spark, d):
    rows = table(spark, d, "events")
    uses = rows.where("event_type = 'error'").select("user_id", F.col("event_id").alias("use_id"), F.col("event_id").alias("line"))
    declared = rows.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("decl_id"), F.col("event_id").alias("decl_line"))
    return windows.nearest_declaration(uses, declared, ["user_id"], "use_id", "line")


@_query("state_snapshot", "SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS value, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, max(event_id) AS last_seq FROM events GROUP BY user_id")
def _(spark, d):
    from arborlake.streaming.events import snapshot

    return snapshot(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), "value")).select(F.col("key").alias("user_id"), "status", "value", "n", "errors", "last_seq")


@_query("scalar_functions", r"""SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&') AS html, lower(regexp_extract(regexp_replace(trim(url), '(?:\.git)?/*$', ''), '([^/:]+/[^/:]+)$', 1)) AS key, TRY_CAST(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS BIGINT) AS digits, CASE WHEN length(url) <= 40 THEN url ELSE substr(url, 1, 5) || chr(10) || '... <truncated> ...' || chr(10) || right(url, 5) END AS middle FROM pages""")
def _(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", text.html_unescape(F.col("html")).alias("html"), text.repo_key(F.col("url")).alias("key"), text.first_digits(F.col("url")).alias("digits"), text.truncate_middle(F.col("url"), 40).alias("middle"))


@_query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id % 2 = 0 AS yes FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), text.truthy((F.col("user_id") + 1) % 2).alias("yes"))


@_query("dataset_counts", "SELECT count(*) AS n, count(DISTINCT source) AS projects, count(DISTINCT md5(text)) AS functions, count(*) FILTER (lang = 'en') AS labelled FROM documents")
def _(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("projects"), F.countDistinct(F.md5("text")).alias("functions"), F.count_if(F.col("lang") == "en").alias("labelled"))
