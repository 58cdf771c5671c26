"""Queries of inventories, sinks, source graphs, similarity and the learned baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import similarity, text
from arborlake.operators import baseline, inventory
from arborlake.operators import graph as g
from arborlake.plans.graph_queries import GRAPH_SQL, star
from arborlake.plans.table_queries import SAMPLES, _samples
from arborlake.session import table
from arborlake.sources import code, corpus, graphs

QUERIES, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@_query("unique_projects", f"WITH {SAMPLES} SELECT coalesce(url, project) AS project_key, min(project) AS project, count(*) AS samples, count(DISTINCT func_name) AS functions, count(DISTINCT commit_id) AS commits FROM s GROUP BY ALL")
def _(spark, d):
    return inventory.unique_projects(_samples(spark, d))


@_query("candidate_stats", f"WITH {SAMPLES} SELECT project, count(*) AS samples, count(*) FILTER (is_vulnerable) AS vulnerable, count(DISTINCT filepath) AS files, count(DISTINCT func_name) AS functions, CAST(sum(size) AS BIGINT) AS total_size, round(avg(size), 6) AS avg_size, max(size) AS largest FROM s GROUP BY project")
def _(spark, d):
    return inventory.candidate_stats(_samples(spark, d)).withColumn("avg_size", F.round("avg_size", 6))


@_query("registry_rollup", "SELECT c_mktsegment AS project, count(*) AS entries, count(DISTINCT c_nationkey % 4) AS labels, count(*) FILTER (c_custkey % 3 = 0) AS train, count(*) FILTER (c_custkey % 3 = 1) AS test FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    split = F.when(F.col("c_custkey") % 3 == 0, "train").when(F.col("c_custkey") % 3 == 1, "test").otherwise("other")
    return inventory.registry_rollup(table(spark, d, "customer").select(F.col("c_mktsegment").alias("project"), (F.col("c_nationkey") % 4).alias("label"), split.alias("split")), ["train", "test"])


@_query("scan_order", "SELECT s_suppkey AS idx, row_number() OVER (ORDER BY coalesce(CASE WHEN s_nationkey % 4 > 0 THEN s_nationkey END, 1000000000000), CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END, s_name, s_suppkey) AS place FROM supplier")
def _(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("project"), F.when(F.col("s_nationkey") % 4 > 0, F.col("s_nationkey")).alias("samples"), F.when(F.col("s_suppkey") % 3 == 0, "https://GitHub.com/x").alias("project_url"))
    return inventory.scan_order(rows).select("idx", "place")


@_query("candidate_loader", "WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS pair, l_partkey AS v, l_suppkey + 1000000 AS f, l_quantity AS q FROM lineitem WHERE l_returnflag <> 'R'), r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN q > 40 THEN 2 WHEN q > 20 THEN 1 ELSE 0 END, q, pair) AS n FROM p QUALIFY n <= 100), x AS (SELECT n, 0 AS side, v AS sample_id FROM r UNION ALL SELECT n, 1, f FROM r), m AS (SELECT sample_id, min(n * 2 + side) AS at1 FROM x GROUP BY sample_id) SELECT sample_id, CAST(row_number() OVER (ORDER BY at1) AS INTEGER) AS place FROM m")
def _(spark, d):
    pairs = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair"), F.col("l_partkey").alias("vulnerable_id"), (F.col("l_suppkey") + 1_000_000).alias("fixed_id"), F.col("l_quantity").alias("q"), "l_returnflag")
    usable = F.when(F.col("q") > 40, False).when(F.col("q") > 20, None).otherwise(True)
    return inventory.load_candidates(pairs, F.col("l_returnflag") == "R", inventory.candidate_order(usable, F.col("q"), F.col("pair")), 100)


@_query("inventory_summary", "SELECT count(*) AS repos, count(*) FILTER (n_nationkey % 3 = 0) AS usable, count(*) FILTER (n_nationkey % 3 = 1) AS failed, count(*) FILTER (n_nationkey % 3 = 2) AS unknown, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM (SELECT n_name FROM nation WHERE n_nationkey % 3 = 1 ORDER BY n_name LIMIT 5)) AS failures FROM nation")
def _(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_name").alias("repo_key"), F.when(F.col("n_nationkey") % 3 == 0, True).when(F.col("n_nationkey") % 3 == 1, False).alias("repo_usable"))
    return inventory.inventory_summary(rows, 5).withColumn("failures", F.array_join("failures", ","))


@_query("inventory_keys", "WITH t AS (SELECT s_suppkey, s_nationkey AS v, unnest([s_name, 'HTTP://X/' || s_nationkey, lower(s_name), 'http://x/' || s_nationkey]) AS key FROM supplier) SELECT key, CAST(arg_min(v, s_suppkey) AS INTEGER) AS v FROM t GROUP BY key")
def _(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("project"), F.concat(F.lit("HTTP://X/"), F.col("s_nationkey").cast("string")).alias("project_url"), F.col("s_nationkey").alias("v")).coalesce(1)
    return corpus.load_inventory(rows, ["v"])


@_query("index_upsert", "SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE p_size END AS n FROM part ORDER BY n, key LIMIT 100")
def _(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("n"))
    return graphs.upsert(rows, rows.where("key % 2 = 0").withColumn("n", F.col("n") + 100), "key", ["n", "key"], 100)


@_query("graph_manifest", f"WITH {GRAPH_SQL} SELECT 'node' AS kind, type, CAST(count(*) AS DOUBLE) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, CAST(count(*) AS DOUBLE) FROM edges GROUP BY type UNION ALL SELECT 'quality', 'mean_degree', round(avg(c), 6) FROM (SELECT count(*) AS c FROM ways GROUP BY node)")
def _(spark, d):
    return graphs.manifest(star(spark, d)).withColumn("n", F.round("n", 6))


@_query("flat_properties", """SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS properties_json FROM nation""")
def _(spark, d):
    return graphs.flatten(table(spark, d, "nation"), ["n_nationkey"])


@_query("visual_subset", f"WITH {GRAPH_SQL} SELECT id, type FROM nodes ORDER BY CASE type WHEN 'Region' THEN 0 WHEN 'Supplier' THEN 1 ELSE 2 END, id LIMIT 60")
def _(spark, d):
    return inventory.visual_subset(star(spark, d).nodes.select("id", "type"), ["Region", "Supplier"], 60)


@_query("compact_result", f"WITH {GRAPH_SQL}, n AS (SELECT src AS target, dst AS node, edge_id FROM edges WHERE type = 'HAS_CUSTOMER'), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY node) AS p, row_number() OVER (PARTITION BY target ORDER BY edge_id) AS q FROM n) SELECT target, string_agg(node, ',' ORDER BY node) FILTER (p <= 10) AS nodes, string_agg(edge_id, ',' ORDER BY edge_id) FILTER (q <= 12) AS edges, string_agg('n ' || node, ',' ORDER BY node) FILTER (p <= 3) AS snippets FROM k GROUP BY target")
def _(spark, d):
    rows = star(spark, d).edges.where("type = 'HAS_CUSTOMER'").select(F.col("src").alias("target"), F.col("dst").alias("node"), F.concat(F.lit("n "), F.col("dst")).alias("code"), "edge_id")
    out = inventory.compact_result(rows.drop("edge_id"), rows.select("target", "edge_id"), 3, 10, 12)
    return out.select("target", *[F.array_join(c, ",").alias(c) for c in ("nodes", "edges", "snippets")])


@_query("sample_listing", "SELECT d.doc_id AS sample_id, CASE WHEN d.doc_id % 5 = 0 THEN 'skipped' WHEN l.doc_id IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'failed' ELSE 'completed' END AS state, CASE WHEN d.doc_id % 5 <> 0 AND l.toxic = 0 THEN l.quality END AS prediction, d.lang AS truth FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(spark, d):
    samples = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 5 == 0).alias("skipped"), F.col("lang").alias("truth"))
    predictions = table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), F.when(F.col("toxic") == 1, "failed").otherwise("completed").alias("status"), F.col("quality").alias("prediction"))
    return inventory.list_samples(samples, predictions, "admin")


@_query("secret_mask", """SELECT conv_id, turn, '{"role":"' || role || '","api_token":"***"}' AS masked FROM conversations""")
def _(spark, d):
    row = F.to_json(F.struct("role", F.md5("text").alias("api_token")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.mask_secrets(row).alias("masked"))


C_FILES = [
    ("src/list.c", '#include "list.h"\n#define MAX 16\nstruct list { int length; char *items[16]; };\nint total;\nint push(struct list *l, char *item) {\n  if (l == NULL || l->length >= MAX) return -1;\n  l->items[l->length] = item;\n  l->length = l->length + 1;\n  total = total + 1;\n  return 0;\n}\n'),
    ("src/main.c", '#include <stdio.h>\nint read_all(char *path, struct list *l) {\n  char buffer[64];\n  FILE *in = fopen(path, "r");\n  while (fgets(buffer, 64, in)) {\n    char *copy = strdup(buffer);\n    if (push(l, copy) < 0) break;\n  }\n  fclose(in);\n  return total;\n}\nint main(int argc, char **argv) { struct list l; return read_all(argv[1], &l); }\n'),
]


def _code_graph(spark: SparkSession) -> g.Graph:
    return code.build_graph(spark.createDataFrame(C_FILES, "path string, text string"))


@_query("code_graph_types")
def _(spark, d):
    """Node and edge types of the graph built from two small source files."""
    graph = _code_graph(spark)
    return g.type_counts(graph.nodes).unionByName(g.type_counts(graph.edges))


@_query("code_security_context")
def _(spark, d):
    """What is needed to inspect every function of the two files, in one job."""
    graph = _code_graph(spark)
    targets = graph.nodes.where("type = 'Function' AND defined").select(F.col("id").alias("target"), "name")
    return g.summarize_context(graph, g.security_context(graph, targets)[0])


@_query("code_risk_slice")
def _(spark, d):
    graph = _code_graph(spark)
    targets = graph.nodes.where("type = 'Function' AND defined").select(F.col("id").alias("target"), "name")
    return g.risk_slice(graph, targets)[1]


@_query("target_validation")
def _(spark, d):
    """Each turn against itself, spaced anew, or with its first word gone."""
    c = table(spark, d, "conversations")
    wanted = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.regexp_replace("text", " ", "  ")).otherwise(F.regexp_replace("text", r"^\S+\s*", ""))
    return similarity.validate_targets(c.select("conv_id", "turn", F.col("text").alias("found"), wanted.alias("wanted"))).select("conv_id", "turn", "status", "similarity")


@_query("statement_matching")
def _(spark, d):
    """Lines of each turn against those of the same turn with every other line changed."""
    c = table(spark, d, "conversations").withColumn("sample_id", F.concat_ws("-", "conv_id", "turn"))
    lines = F.transform(F.split("text", r"(?<=\.)\s+"), lambda x, i: F.when(i % 2 == 0, x).otherwise(F.reverse(x)))
    return similarity.match_statements(c.select("sample_id", F.regexp_replace("text", r"\.\s+", ".\n").alias("changed_statements")), c.select("sample_id", lines.alias("statements")))


@_query("tfidf_baseline")
def _(spark, d):
    """Quality of labelled documents, learned from those of even ids and predicted for all documents."""
    documents = table(spark, d, "documents").select("doc_id", F.col("text").alias("code"))
    rows = table(spark, d, "labels").join(documents, "doc_id").select("doc_id", "code", F.col("quality").alias("label"))
    model = baseline.fit(rows.where("doc_id % 2 = 0"))
    return baseline.predict(model, documents).drop("code")


def corpus_view(spark: SparkSession, d: str) -> DataFrame:
    """Documents read through the corpus schema."""
    return corpus.normalize(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("repo_name"), F.col("text").alias("code"), F.col("lang").alias("file"), (F.col("doc_id") % 2).alias("label")))


@_query("corpus_counts", "SELECT count(*) AS rows, count(DISTINCT source) AS projects, count(DISTINCT source || '|' || lang) AS functions, count(*) FILTER (doc_id % 2 = 1) AS vulnerable, count(*) FILTER (doc_id % 2 = 0) AS safe FROM documents")
def _(spark, d):
    return corpus.counts(corpus_view(spark, d).withColumn("func_name", F.lit("f")))
