"""Steps of neighbourhoods of many targets: by shuffle the same as by broadcast, and with fewer exchanges."""

import random

from pyspark.sql import functions as F

from arborlake.operators import graph as g


def made(spark):
    r = random.Random(5)
    pairs = sorted({(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(90)})
    edges = spark.createDataFrame([(f"e{i}", a, b, "CALLS") for i, (a, b) in enumerate(pairs)], "edge_id string, src string, dst string, type string")
    nodes = spark.createDataFrame([(f"n{i}", "Function" if i % 3 else "File") for i in range(40)], "id string, type string")
    return g.Graph(nodes, edges), nodes.select(F.col("id").alias("target"), F.col("id").alias("node"))


def rows(df, *columns):
    return sorted(tuple(x) for x in df.select(*columns).collect())


def exchanges(df):
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_large_tables_give_what_small_ones_give(spark, monkeypatch):
    graph, targets = made(spark)
    small = {}
    for direction in ("out", "both"):
        reached = g.neighborhood(graph.edges, targets, 2, direction=direction)
        small[direction] = rows(reached, "target", "node", "depth"), rows(g.neighborhood_edges(graph.edges, reached, 2, direction=direction), "target", "edge_id"), rows(g.induced_edges(graph.edges, reached), "target", "edge_id", "src", "dst")
    scores = rows(g.slice_scores(graph, reached), "target", "node", "score")
    monkeypatch.setattr(g, "is_small", lambda df, most=0: False)
    monkeypatch.setattr(g, "broadcast_if_small", lambda df, most=0: df)
    for direction, (nodes, followed, induced) in small.items():
        reached = g.neighborhood(graph.edges, targets, 2, direction=direction)
        assert rows(reached, "target", "node", "depth") == nodes
        assert rows(g.neighborhood_edges(graph.edges, reached, 2, direction=direction), "target", "edge_id") == followed
        assert rows(g.induced_edges(graph.edges, reached, F.col("depth") < 2), "target", "edge_id", "src", "dst") == induced
    assert rows(g.slice_scores(graph, reached), "target", "node", "score") == scores
    # edges followed one way are not compared with each other
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(g.neighborhood_edges(graph.edges, reached, 2, direction="out")) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
