"""Graph operators on small graphs that pin the surprising cases."""

import pytest

from arborlake.operators import graph as g


@pytest.fixture(scope="module")
def triangle(spark):
    nodes = spark.createDataFrame([(i, "Function", i) for i in "abcd"], "id string, type string, name string")
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("c", "d", "CALLS"), ("a", "b", "CALLS"), ("a", "zz", "CALLS")], "src string, dst string, type string")
    return g.make_graph(nodes, edges)


def seeds(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "target string, node string")


def pairs(graph, df):
    ends = {r["edge_id"]: r["src"] + r["dst"] for r in graph.edges.collect()}
    return {ends[r["edge_id"]] for r in df.collect()}


def test_make_graph_drops_copies_and_dangling_edges(triangle):
    assert triangle.edges.count() == 4


def test_seeds_outside_the_graph_are_left_out(spark, triangle):
    reached = g.neighborhood(triangle.edges, seeds(spark, "a", "absent"), 1, nodes=triangle.nodes)
    assert {(r["target"], r["node"]) for r in reached.collect()} == {("a", "a"), ("a", "b"), ("a", "c")}
    assert g.neighborhood(triangle.edges, seeds(spark, "absent"), 2, nodes=triangle.nodes).count() == 0


def test_boundary_edges_are_not_followed(spark, triangle):
    reached = g.neighborhood(triangle.edges, seeds(spark, "a"), 1)
    assert {(r["node"], r["depth"]) for r in reached.collect()} == {("a", 0), ("b", 1), ("c", 1)}
    # b-c lies between two nodes of full depth
    assert pairs(triangle, g.neighborhood_edges(triangle.edges, reached, 1)) == {"ab", "ca"}
    assert pairs(triangle, g.induced_edges(triangle.edges, reached)) == {"ab", "bc", "ca"}


def test_directions_and_types(spark, triangle):
    out = g.neighborhood(triangle.edges, seeds(spark, "c"), 1, ("CALLS",), "out")
    assert {r["node"] for r in out.collect()} == {"c", "a", "d"}
    assert {r["node"] for r in g.neighborhood(triangle.edges, seeds(spark, "c"), 3, ("OTHER",)).collect()} == {"c"}
    with pytest.raises(ValueError):
        g.adjacency(triangle.edges, "up")
    assert g.neighborhood(triangle.edges, seeds(spark, "c"), 0).count() == 1


def test_many_targets_in_one_job(spark, triangle):
    reached = g.neighborhood(triangle.edges, seeds(spark, "a", "d"), 2)
    assert {(r["target"], r["node"]) for r in reached.collect() if r["target"] == "d"} == {("d", "d"), ("d", "c"), ("d", "b"), ("d", "a")}


def test_degree_counts_a_loop_twice(spark):
    edges = spark.createDataFrame([("x", "x", "T"), ("x", "y", "T")], "src string, dst string, type string")
    assert {r["id"]: r["degree"] for r in g.degree(edges).collect()} == {"x": 3, "y": 1}


def test_shortest_path(spark, triangle):
    wanted = spark.createDataFrame([("a", "d"), ("d", "b"), ("a", "a"), ("a", "nowhere")], "source string, goal string")
    path = g.shortest_paths(triangle.edges, wanted, 5).collect()
    by = {}
    for r in path:
        by.setdefault((r["source"], r["goal"]), []).append((r["step"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in by.items()} == {("a", "d"): ["a", "c", "d"], ("d", "b"): ["d", "c", "b"], ("a", "a"): ["a"]}
    assert all((r["edge_id"] is None) == (r["step"] == 0) for r in path)


def test_trim_keeps_the_target(spark, triangle):
    nodes = spark.createDataFrame([("d", n) for n in "abcd"], "target string, node string")
    kept = g.trim(triangle, nodes, 2).collect()
    assert [(r["node"], r["score"]) for r in sorted(kept, key=lambda r: -r["score"])] == [("d", 10_000), ("c", 223)]


def test_variable_seeds_fall_back_to_globals(spark):
    nodes = spark.createDataFrame([("l", "LocalVariable", "x", "f"), ("g", "GlobalVariable", "x", None), ("y", "GlobalVariable", "y", None)], "id string, type string, name string, function string")
    wanted = spark.createDataFrame([("t1", "f", "x"), ("t2", "h", "x"), ("t3", "f", "y"), ("t4", "f", "none")], "target string, function string, symbol string")
    assert {(r["target"], r["node"]) for r in g.variable_seeds(nodes, wanted).collect()} == {("t1", "l"), ("t2", "g"), ("t3", "y")}


def test_defined_function_first(spark):
    nodes = spark.createDataFrame([("a", "Function", "f", False), ("b", "Function", "f", True), ("c", "Function", "h", False)], "id string, type string, name string, defined boolean")
    found = g.find_functions(nodes, spark.createDataFrame([("f",), ("h",)], "name string"))
    assert {(r["name"], r["target"]) for r in found.collect()} == {("f", "b"), ("h", "c")}


def test_overlay_limits(spark):
    nodes = spark.createDataFrame([("s", "Statement", "x"), ("o1", "JoernCPGNode", "call"), ("o2", "JoernCPGNode", "literal"), ("o3", "JoernCPGNode", "method call")], "id string, type string, name string")
    edges = spark.createDataFrame([("o1", "s", "JOERN_OVERLAY"), ("s", "o2", "JOERN_OVERLAY"), ("o3", "s", "JOERN_OVERLAY"), ("o1", "o3", "JOERN_AST"), ("o1", "o2", "JOERN_AST")], "src string, dst string, type string")
    graph = g.make_graph(nodes, edges)
    kept, among = g.overlay(graph, seeds(spark, "s"), limit=2)
    assert {r["node"] for r in kept.collect()} == {"o3", "o1"}
    assert [(r["src"], r["dst"]) for r in among.collect()] == [("o1", "o3")]
