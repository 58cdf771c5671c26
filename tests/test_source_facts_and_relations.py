"""Facts about sources, cheapest relations, waves and JSON spans on small cases."""

import heapq
import random

import pytest


def facts_of(spark, text):
    from arborlake.functions.source_facts import source_facts

    rows = source_facts(spark.createDataFrame([(1, text)], "id int, code string"), "code").collect()
    return [{k: v for k, v in r.asDict().items() if v is not None and k != "id"} for r in rows]


PARSER = """static int parse(const char *raw, const char *end) {
    const char *base = raw;
    base = raw;
    while (raw >= base) {
        raw += length * itemsize;
    }
    if (raw == end)
        return 0;
    return -1;
}"""


def test_facts_of_a_parser(spark):
    found = facts_of(spark, PARSER)
    assert [f["fact_type"] for f in found] == [
        "state_or_pointer_advance_from_size_expression", "pointer_advance_from_size_or_length", "saved_base_lower_bound_guard", "saved_base_lower_bound_guard",
        "exact_end_accept_else_error", "structured_input_or_state_machine_surface", "parser_state_machine_surface", "length_offset_sensitive_operation",
    ]
    assert [f["fact_id"] for f in found] == [f"AUTO-SF-{i:02d}" for i in range(1, 9)]
    assert found[0] == {"fact_id": "AUTO-SF-01", "fact_type": "state_or_pointer_advance_from_size_expression", "variable": "raw", "expression": "length * itemsize"}
    assert found[2]["base"] == "base" and found[2]["variable"] == "raw" and found[4]["end"] == "end"


@pytest.mark.parametrize(
    ("code", "found"),
    [
        ("p = malloc(n);\nmemcpy(p, q, n);", True), ("p = malloc(n);\nif (!p) return;\nmemcpy(p, q, n);", False), ("p = malloc(n);\nif (p == NULL) return;\np[0] = 1;", False),
        ("p = malloc(n);\np->next = 0;", True), ("p = malloc(n);\nfree(p);", False), ("p = malloc(n);" + " " * 1200 + "p[0] = 1;", False), ("p = malloc(n);" + " " * 1100 + "p[0] = 1;", True),
        ("p = malloc(n);\np[0] = 1;" + " " * 1200 + "if (!p) return;", True), ("char *p = malloc(strlen(s) + 1);\nstrcpy(p, s);", True), ("pp = malloc(n);\np[0] = 1;", False), ("", False),
    ],
)
def test_uses_before_a_check(spark, code, found):
    assert any(f["fact_type"] == "raw_malloc_without_null_check_before_use" for f in facts_of(spark, code)) == found


def test_facts_of_allocations(spark):
    found = facts_of(spark, "b = safe_calloc(16);\nb = safe_calloc(64);\nfread(b, 1, 32, f);\nfread(b, 1, 64, f);\nx = realloc(x,\n  n);\n*x = 0;\nx = calloc(1, n);\nread(x, 1);")
    by = [(f["fact_type"], f.get("variable"), f.get("allocation_size"), f.get("read_size"), f.get("expression")) for f in found if "surface" not in f["fact_type"]]
    assert by == [
        ("raw_calloc_without_null_check_before_use", "x", None, None, "1, n"), ("raw_realloc_without_null_check_before_use", "x", None, None, "x, n"),
        ("safe_calloc_allocation_wrapper_used", None, None, None, None), ("bounded_read_within_safe_allocation", "b", 64, 32, None),
    ]
    grown = "temp = malloc(temp_size); if (i >= temp_size) { temp = realloc(temp, temp_size); }"
    kinds = lambda code: {f["fact_type"] for f in facts_of(spark, code)}
    assert {"dynamic_buffer_growth_guard", "unchecked_realloc_residual_risk"} <= kinds(grown)
    assert "unchecked_realloc_residual_risk" not in kinds(grown + " if (!temp) return;")
    assert kinds("int x = 1;") == set() and facts_of(spark, None) == []


def dijkstra(ways, source):
    best, heap = {}, [(0, source)]
    while heap:
        d, node = heapq.heappop(heap)
        if node in best:
            continue
        best[node] = d
        for other, w in ways.get(node, ()):
            heapq.heappush(heap, (d + w, other))
    return best


def test_relations_against_dijkstra(spark):
    from arborlake.operators import relation

    r = random.Random(4)
    kinds = ["DEF_USE", "CALLS", "AST_CHILD", "JOERN_EDGE", "OTHER"]
    weight = {"DEF_USE": 85, "CALLS": 100, "AST_CHILD": 165, "JOERN_EDGE": 200, "OTHER": 180}
    edges = [(f"e{i}", f"n{r.randrange(40)}", f"n{r.randrange(40)}", r.choice(kinds)) for i in range(55)] + [(f"c{i}", f"c{i}", f"c{i + 1}", "DEF_USE") for i in range(12)]
    ways = {}
    for _, a, b, k in edges:
        ways.setdefault(a, []).append((b, weight[k]))
        ways.setdefault(b, []).append((a, weight[k]))
    table = spark.createDataFrame(edges, "edge_id string, src string, dst string, type string")
    sources = ["n0", "n7", "c0"]
    pairs = spark.createDataFrame([(s, None) for s in sources], "source string, goal string")
    found = {(x["source"], x["node"]): x["cost"] for x in relation.relation_costs(table, pairs).collect()}
    assert found == {(s, n): d for s in sources for n, d in dijkstra(ways, s).items()}

    wanted = [("n0", "n9"), ("n1", "n9"), ("n2", "n9"), ("c0", "c12"), ("c0", "n0"), ("n3", "n3"), ("x", "n9")]
    steps = {}
    for x in relation.relation_paths(table, spark.createDataFrame(wanted, "source string, goal string")).collect():
        steps.setdefault((x["source"], x["goal"]), []).append(x)
    by_id = {e[0]: e for e in edges}
    for s, g in wanted:
        cost = dijkstra(ways, s).get(g)
        path = sorted(steps.get((s, g), []), key=lambda x: x["step"])
        if cost is None or s == g:
            assert not path
            continue
        assert [x["step"] for x in path] == list(range(len(path))) and path[0]["from_node"] == s and path[-1]["to_node"] == g
        assert all(a["to_node"] == b["from_node"] for a, b in zip(path, path[1:]))
        assert {x["cost"] for x in path} == {cost} and sum(weight[by_id[x["edge_id"]][3]] for x in path) == cost
        assert all({by_id[x["edge_id"]][1], by_id[x["edge_id"]][2]} == {x["from_node"], x["to_node"]} for x in path)
