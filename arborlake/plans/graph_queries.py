"""Graph queries over the star-schema graph, with recursive SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators import graph as g
from arborlake.operators import relation
from arborlake.session import table, written

NODES_SQL = """SELECT 'R' || r_regionkey AS id, 'Region' AS type FROM region UNION ALL SELECT 'N' || n_nationkey, 'Nation' FROM nation
UNION ALL SELECT 'C' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 'S' || s_suppkey, 'Supplier' FROM supplier
UNION ALL SELECT 'O' || o_orderkey, 'Order' FROM orders UNION ALL SELECT 'P' || p_partkey, 'Part' FROM part"""
LINKS_SQL = """SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 'HAS_NATION' AS type FROM nation
UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'HAS_CUSTOMER' FROM customer UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'HAS_SUPPLIER' FROM supplier
UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 'PLACED' FROM orders UNION ALL SELECT 'O' || l_orderkey, 'P' || l_partkey, 'CONTAINS' FROM lineitem
UNION ALL SELECT 'S' || l_suppkey, 'P' || l_partkey, 'SUPPLIES' FROM lineitem"""
GRAPH_SQL = f"""nodes AS (SELECT DISTINCT * FROM ({NODES_SQL})),
edges AS (SELECT substr(sha1(src || '|' || type || '|' || dst), 1, 16) AS edge_id, * FROM (SELECT DISTINCT * FROM ({LINKS_SQL})) e
  WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.src) AND EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.dst)),
ways AS (SELECT src AS node, dst AS other, edge_id, type FROM edges UNION ALL SELECT dst, src, edge_id, type FROM edges)"""


def star(spark: SparkSession, sf_dir: str) -> g.Graph:
    """The star-schema graph of a data folder."""
    return g.star_graph({t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders", "part", "lineitem")})


def saved(spark: SparkSession, sf_dir: str, *types: str) -> g.Graph:
    """The same, or with only the edges of some types, written out for queries that go over the edges more than once.

    An edge's id follows from what it connects, so it is not written but made again where a query shows it.
    """
    graph = star(spark, sf_dir)
    edges = graph.edges.where(F.col("type").isin(*types)) if types else graph.edges
    edges = written(edges.select("src", "dst", "type"))
    return g.Graph(graph.nodes, edges.select(g.edge_id(F.col("src"), F.col("type"), F.col("dst")).alias("edge_id"), "src", "dst", "type"))


def _targets(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "target string, node string")


def _all(graph: g.Graph, *types: str) -> DataFrame:
    """Every node of the types as a target of its own."""
    return graph.nodes.where(F.col("type").isin(*types)).select(F.col("id").alias("target"), F.col("id").alias("node"))


def call_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts within two steps of every customer, in one job."""
    graph = saved(spark, sf_dir, "PLACED", "CONTAINS")
    return g.neighborhood(graph.edges, _all(graph, "Customer"), 2, ("PLACED", "CONTAINS"), "out")


def _from_all(f, *types: str, edges: tuple[str, ...] = ()):
    """A query that runs f(edges, targets) for all nodes of the types, over edges of some types or all."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = saved(spark, sf_dir, *edges)
        return f(graph.edges, _all(graph, *types))

    return run


def _bfs(seeds: str, depth: int, ways: str, types: str = "") -> str:
    kind = f" AND w.type IN ({types})" if types else ""
    return f"""r(target, node, depth) AS ({seeds} UNION SELECT r.target, w.other, r.depth + 1 FROM r JOIN {ways} w ON w.node = r.node{kind} WHERE r.depth < {depth}),
m AS (SELECT target, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY target, node)"""


_OUT = "(SELECT src AS node, dst AS other, edge_id, type FROM edges)"
_IN = "(SELECT dst AS node, src AS other, edge_id, type FROM edges)"
_CALLS = "'PLACED', 'CONTAINS'"
_CUSTOMERS = "SELECT id, id, 0 FROM nodes WHERE type = 'Customer'"
_TWO = "SELECT * FROM (VALUES ('C1', 'C1', 0), ('S3', 'S3', 0))"


def _two(spark: SparkSession) -> DataFrame:
    return _targets(spark, "C1", "S3")


def _d2(spark: SparkSession, sf_dir: str) -> tuple[g.Graph, DataFrame]:
    graph = saved(spark, sf_dir)
    return graph, g.neighborhood(graph.edges, _two(spark), 2)


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, reached = _d2(spark, sf_dir)
    nodes, edges = g.limited_induced(graph.edges, reached, 40)
    return nodes.groupBy("target").agg(F.count(F.lit(1)).alias("n_nodes")).join(edges.groupBy("target").agg(F.count(F.lit(1)).alias("n_edges")), "target", "left").select("target", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def _path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([("C1", "S3"), ("C2", "C3"), ("R0", "P5"), ("O1", "R1")], "source string, goal string")
    return g.path_lengths(saved(spark, sf_dir).edges, pairs, 4)


#: Weights of the star graph's edges, in hundredths; other types weigh 180.
STAR_WEIGHTS = {"PLACED": 100, "CONTAINS": 85, "SUPPLIES": 175}


def _relation_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of the cheapest relation from each region to every node that it reaches."""
    graph = saved(spark, sf_dir)
    regions = graph.nodes.where("type = 'Region'").select(F.col("id").alias("source"), F.lit(None).cast("string").alias("goal"))
    return relation.relation_costs(graph.edges, regions, STAR_WEIGHTS, parents=False).select("source", "node", "cost")


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that a nation has as suppliers, else customers of that name anywhere, one step on."""
    graph = saved(spark, sf_dir)
    nodes = graph.nodes.select("id", "name", F.when(F.col("type") == "Supplier", "LocalVariable").when(F.col("type") == "Customer", "GlobalVariable").otherwise(F.col("type")).alias("type"))
    home = graph.edges.where("type = 'HAS_SUPPLIER'").select(F.col("dst").alias("id"), F.col("src").alias("function"))
    nodes = nodes.join(home, "id", "left")
    names = nodes.where("type IN ('LocalVariable', 'GlobalVariable')").select(F.col("id").alias("target"), F.coalesce("function", F.lit("N0")).alias("function"), F.col("name").alias("symbol"))
    return g.neighborhood(graph.edges, g.variable_seeds(nodes, names), 1)


WEIGHTS = {"Region": 220, "Nation": 180, "Customer": 150, "Supplier": 140, "Order": 110}


def _trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, reached = _d2(spark, sf_dir)
    return g.trim(graph, reached.select("target", "node"), 50, WEIGHTS)


def _calls_d2(spark: SparkSession, sf_dir: str) -> tuple[g.Graph, DataFrame]:
    """What every customer and every order reach in two steps over orders and parts, with only the edges of those steps."""
    graph = saved(spark, sf_dir, "PLACED", "CONTAINS")
    return graph, g.neighborhood(graph.edges, _all(graph, "Customer", "Order"), 2, direction="out")


def _limited_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, reached = _calls_d2(spark, sf_dir)
    nodes, edges = g.limited_induced(graph.edges, reached, 40)
    return nodes.groupBy("target").agg(F.count(F.lit(1)).alias("n_nodes")).join(edges.groupBy("target").agg(F.count(F.lit(1)).alias("n_edges")), "target", "left").select("target", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def _trim_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, reached = _calls_d2(spark, sf_dir)
    return g.trim(graph, reached.select("target", "node"), 50, WEIGHTS)


def _path_lengths_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from every order's customer to each part of the order."""
    edges = saved(spark, sf_dir, "PLACED", "CONTAINS").edges
    placed = edges.where("type = 'PLACED'").select(F.col("src").alias("source"), F.col("dst").alias("order"))
    held = edges.where("type = 'CONTAINS'").select(F.col("src").alias("order"), F.col("dst").alias("goal"))
    return g.path_lengths(edges, placed.join(held, "order").select("source", "goal"), 4, direction="out")


def _components_of_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star(spark, sf_dir)
    hub = g.degree(graph.edges).join(graph.nodes.select("id", "type"), "id")
    return hub.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("ends"), F.max("degree").alias("most"))


QUERIES = {
    "call_neighborhood": call_neighborhood,
    "node_type_counts": lambda s, d: g.type_counts(star(s, d).nodes),
    "edge_type_counts": lambda s, d: g.type_counts(star(s, d).edges),
    "degree_top_nodes": lambda s, d: g.top_degree(star(s, d), 25),
    "degree_by_type": _components_of_calls,
    "edge_dedup": lambda s, d: star(s, d).edges.where("type = 'SUPPLIES'").select("edge_id", "src", "dst"),
    "dangling_edge_filter": lambda s, d: g.make_graph(star(s, d).nodes.where("type <> 'Part'"), star(s, d).edges).edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")),
    "neighborhood_d1": _from_all(lambda edges, targets: g.neighborhood(edges, targets, 1), "Customer", "Supplier"),
    "neighborhood_d2": lambda s, d: _d2(s, d)[1],
    "neighborhood_edges_d2": lambda s, d: (lambda x: g.neighborhood_edges(x[0].edges, x[1], 2))(_d2(s, d)),
    "neighborhood_induced_d2": lambda s, d: (lambda x: g.induced_edges(x[0].edges, x[1]))(_d2(s, d)),
    "neighborhood_limited": _limited,
    "call_neighborhood_in": _from_all(lambda edges, targets: g.neighborhood(edges, targets, 2, ("PLACED", "CONTAINS"), "in"), "Part", edges=("PLACED", "CONTAINS")),
    "callers": _from_all(lambda edges, targets: g.callers(edges, targets, ("PLACED", "CONTAINS")), "Part", "Order", edges=("PLACED", "CONTAINS")),
    "callees": _from_all(lambda edges, targets: g.callees(edges, targets, ("PLACED", "CONTAINS")), "Customer", "Order", "Part", edges=("PLACED", "CONTAINS")),
    "incident_edges": _from_all(g.incident_edges, "Customer", "Nation"),
    "variable_flow_fallback": _flow,
    "shortest_path_length": _path_lengths,
    "relation_costs": _relation_costs,
    "slice_trim_topk": _trim,
    # the same operators from whole tables of targets, which recursive SQL is too slow for
    "neighborhood_d2_all": lambda s, d: _calls_d2(s, d)[1],
    "neighborhood_edges_d2_all": lambda s, d: (lambda x: g.neighborhood_edges(x[0].edges, x[1], 2, direction="out"))(_calls_d2(s, d)),
    "neighborhood_induced_d2_all": lambda s, d: (lambda x: g.induced_edges(x[0].edges, x[1], F.col("depth") < 2))(_calls_d2(s, d)),
    "neighborhood_limited_all": _limited_all,
    "slice_trim_topk_all": _trim_all,
    "shortest_path_length_all": _path_lengths_all,
}

_WEIGHT_SQL = "CASE n.type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 20 END"
_WITH = f"WITH RECURSIVE {GRAPH_SQL}"
SQL = {
    "call_neighborhood": f"{_WITH}, {_bfs(_CUSTOMERS, 2, _OUT, _CALLS)} SELECT * FROM m",
    "node_type_counts": f"WITH {GRAPH_SQL} SELECT type, count(*) AS n FROM nodes GROUP BY type",
    "edge_type_counts": f"WITH {GRAPH_SQL} SELECT type, count(*) AS n FROM edges GROUP BY type",
    "degree_top_nodes": f"WITH {GRAPH_SQL} SELECT node AS id, count(*) AS degree FROM ways GROUP BY node ORDER BY degree DESC, id LIMIT 25",
    "degree_by_type": f"WITH {GRAPH_SQL}, d AS (SELECT node, count(*) AS degree FROM ways GROUP BY node) SELECT type, count(*) AS n, CAST(sum(degree) AS BIGINT) AS ends, max(degree) AS most FROM d JOIN nodes ON id = node GROUP BY type",
    "edge_dedup": "SELECT substr(sha1(src || '|SUPPLIES|' || dst), 1, 16) AS edge_id, src, dst FROM (SELECT DISTINCT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst FROM lineitem) WHERE src IN (SELECT 'S' || s_suppkey FROM supplier) AND dst IN (SELECT 'P' || p_partkey FROM part)",
    "dangling_edge_filter": f"WITH {GRAPH_SQL} SELECT type, count(*) AS n FROM edges WHERE src NOT LIKE 'P%' AND dst NOT LIKE 'P%' GROUP BY type",
    "neighborhood_d1": f"""{_WITH}, {_bfs("SELECT id, id, 0 FROM nodes WHERE type IN ('Customer', 'Supplier')", 1, 'ways')} SELECT * FROM m""",
    "neighborhood_d2": f"{_WITH}, {_bfs(_TWO, 2, 'ways')} SELECT * FROM m",
    "neighborhood_edges_d2": f"{_WITH}, {_bfs(_TWO, 2, 'ways')} SELECT DISTINCT m.target, w.edge_id FROM m JOIN ways w ON w.node = m.node WHERE m.depth < 2",
    "neighborhood_induced_d2": f"{_WITH}, {_bfs(_TWO, 2, 'ways')} SELECT a.target, e.edge_id, e.src, e.dst, e.type FROM edges e JOIN m a ON a.node = e.src JOIN m b ON b.node = e.dst AND b.target = a.target",
    "neighborhood_limited": f"{_WITH}, {_bfs(_TWO, 2, 'ways')}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY depth, node) AS p FROM m) WHERE p <= 40), x AS (SELECT a.target, count(*) AS c FROM edges e JOIN k a ON a.node = e.src JOIN k b ON b.node = e.dst AND b.target = a.target GROUP BY a.target) SELECT k.target, count(*) AS n_nodes, coalesce(any_value(x.c), 0) AS n_edges FROM k LEFT JOIN x ON x.target = k.target GROUP BY k.target",
    "call_neighborhood_in": f"""{_WITH}, {_bfs("SELECT id, id, 0 FROM nodes WHERE type = 'Part'", 2, _IN, _CALLS)} SELECT * FROM m""",
    "callers": f"WITH {GRAPH_SQL} SELECT DISTINCT dst AS target, src AS node FROM edges WHERE (dst LIKE 'P%' OR dst LIKE 'O%') AND type IN ({_CALLS})",
    "callees": f"WITH {GRAPH_SQL} SELECT DISTINCT src AS target, dst AS node FROM edges WHERE (src LIKE 'C%' OR src LIKE 'O%' OR src LIKE 'P%') AND type IN ({_CALLS})",
    "incident_edges": f"WITH {GRAPH_SQL} SELECT DISTINCT node AS target, edge_id FROM ways WHERE node LIKE 'C%' OR node LIKE 'N%'",
    "variable_flow_fallback": f"""WITH {GRAPH_SQL}, w AS (SELECT 'S' || s_suppkey AS target, 'N' || s_nationkey AS function, s_name AS symbol FROM supplier UNION ALL SELECT 'C' || c_custkey, 'N0', c_name FROM customer),
l AS (SELECT w.target, 'S' || s_suppkey AS node FROM w JOIN supplier ON s_name = w.symbol AND 'N' || s_nationkey = w.function),
s AS (SELECT * FROM l UNION SELECT w.target, 'C' || c_custkey FROM w JOIN customer ON c_name = w.symbol WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.target = w.target))
SELECT target, node, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT target, node, 0 AS depth FROM s UNION ALL SELECT s.target, ways.other, 1 FROM s JOIN ways ON ways.node = s.node) GROUP BY target, node""",
    "shortest_path_length": f"""{_WITH}, p(source, goal) AS (VALUES ('C1', 'S3'), ('C2', 'C3'), ('R0', 'P5'), ('O1', 'R1')),
r(target, node, depth) AS (SELECT source, source, 0 FROM p UNION SELECT r.target, w.other, r.depth + 1 FROM r JOIN ways w ON w.node = r.node WHERE r.depth < 4)
SELECT p.source, p.goal, CAST(min(r.depth) AS INTEGER) AS length FROM p JOIN r ON r.target = p.source AND r.node = p.goal GROUP BY p.source, p.goal""",
    "slice_trim_topk": f"""{_WITH}, {_bfs(_TWO, 2, 'ways')}, d AS (SELECT node, count(*) AS degree FROM ways GROUP BY node),
s AS (SELECT m.target, m.node, CAST(CASE WHEN m.node = m.target THEN 10000 ELSE {_WEIGHT_SQL} + least(40, coalesce(d.degree, 0)) END AS BIGINT) AS score FROM m JOIN nodes n ON n.id = m.node LEFT JOIN d ON d.node = m.node)
SELECT target, node, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, node) AS p FROM s) WHERE p <= 50""",
}

# sixteen rounds of relaxing every edge reach the end of every path of at most sixteen edges, and no path here is longer
SQL["relation_costs"] = (
    f"WITH {GRAPH_SQL}, w AS (SELECT node, other, CASE type WHEN 'PLACED' THEN 100 WHEN 'CONTAINS' THEN 85 WHEN 'SUPPLIES' THEN 175 ELSE 180 END AS weight FROM ways), "
    "d0 AS (SELECT id AS source, id AS node, 0 AS cost FROM nodes WHERE type = 'Region'), "
    + ", ".join(
        f"d{i + 1} AS (SELECT source, node, min(cost) AS cost FROM (SELECT * FROM d{i} UNION ALL SELECT source, other, cost + weight FROM d{i} JOIN w USING (node)) GROUP BY ALL)" for i in range(16)
    )
    + " SELECT source, node, CAST(cost AS BIGINT) AS cost FROM d16"
)
