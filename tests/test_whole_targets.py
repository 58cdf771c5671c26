"""The graph queries from whole tables of targets, against brute force over the smallest tables."""

from collections import defaultdict

import pytest

from arborlake.plans import catalog, graph_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def brute(spark):
    graph = graph_queries.star(spark, SF)
    kinds = {r["id"]: r["type"] for r in graph.nodes.select("id", "type").collect()}
    edges = [tuple(r) for r in graph.edges.where("type IN ('PLACED', 'CONTAINS')").select("src", "dst", "edge_id").collect()]
    out, degree = defaultdict(list), defaultdict(int)
    for a, b, e in edges:
        out[a].append((b, e))
        degree[a] += 1
        degree[b] += 1
    reached = {}
    for t in (n for n, k in kinds.items() if k in ("Customer", "Order")):
        depth, front = {t: 0}, [t]
        for step in (1, 2):
            front = sorted({b for n in front for b, _ in out[n]} - depth.keys())
            depth.update(dict.fromkeys(front, step))
        reached[t] = depth
    return kinds, out, degree, reached


def got(spark, name):
    return sorted(tuple(r) for r in catalog.queries()[name](spark, SF).collect())


def test_neighborhoods(spark, brute):
    kinds, out, degree, reached = brute
    assert got(spark, "neighborhood_d2_all") == sorted((t, n, d) for t, m in reached.items() for n, d in m.items())
    edges = {(t, e) for t, m in reached.items() for n, d in m.items() if d < 2 for _, e in out[n]}
    assert got(spark, "neighborhood_edges_d2_all") == sorted(edges)
    induced = sorted((t, e, n, b) for t, m in reached.items() for n in m for b, e in out[n] if b in m)
    assert [r[:4] for r in got(spark, "neighborhood_induced_d2_all")] == induced
    limited = []
    for t, m in reached.items():
        first = set(sorted(m, key=lambda n: (m[n], n))[:40])
        limited.append((t, len(first), sum(b in first for n in first for b, _ in out[n])))
    assert got(spark, "neighborhood_limited_all") == sorted(limited)


def test_trim_and_paths(spark, brute):
    kinds, out, degree, reached = brute
    trimmed = []
    for t, m in reached.items():
        score = {n: 10_000 if n == t else graph_queries.WEIGHTS.get(kinds[n], 20) + min(40, degree[n]) for n in m}
        trimmed += [(t, n, score[n]) for n in sorted(score, key=lambda n: (-score[n], n))[:50]]
    assert got(spark, "slice_trim_topk_all") == sorted(trimmed)
    paths = [(t, n, 2) for t, m in reached.items() if kinds[t] == "Customer" for n, d in m.items() if d == 2]
    assert got(spark, "shortest_path_length_all") == sorted(paths)


def test_calls_come_from_their_edges_alone(spark):
    from arborlake.operators import graph as g
    from arborlake.plans import code_queries

    d, columns = "/root/testdata/sf0.001", ["edge_id", "src", "dst", "type"]
    whole, calls = code_queries.graph(spark, d), code_queries.calls_graph(spark, d)
    assert sorted(calls.edges.select(columns).collect()) == sorted(whole.edges.where(whole.edges["type"].isin(*g.CALL_EDGES)).select(columns).collect())
    assert sorted(x["id"] for x in calls.nodes.collect()) == sorted(x["target"] for x in code_queries.functions_of(whole).collect())
