"""Source text to graph, and retrieval over it."""

import pytest
from pyspark.sql import functions as F

from arborlake.operators import graph as g
from arborlake.sources import code

SAMPLE = r'''
#include <string.h>
#include "own.h"
#define LIMIT 10
/* a comment { with ; marks */
struct Ragged { int length; char *data; };
int total = 0;
int helper(char *p) { if (p == NULL) return -1; return p[0]; }
int count_rows(char *raw, int length) {
    int i, rows = 0; // trailing
    struct Ragged *self = make(raw, "a;b{");
    for (i = 0; i < length; i++) {
        if (raw[i] == '\n') { rows = rows + 1; }
    }
    self->length = rows;
    total = total + self->length;
    helper(raw);
    strcpy(self->data, raw);
    return rows;
}
'''
SHADOW = "int len;\nvoid f(void) { int x; x = 1; use(x); { int x; x = 2; use(x); } int len = 3; use(len); p->len; }\nvoid q(void) { x == y; g(len); }\n"


@pytest.fixture(scope="module")
def graph(spark):
    return code.build_graph(spark.createDataFrame([("sample.c", SAMPLE), ("shadow.c", SHADOW), ("empty.c", ""), ("null.c", None)], "path string, text string"))


@pytest.fixture(scope="module")
def linked(graph):
    nodes = graph.nodes.select("id", F.concat_ws(":", "type", F.coalesce("name", "code")).alias("what"), "function")
    a = nodes.select(F.col("id").alias("src"), F.col("what").alias("from"), F.col("function").alias("in"))
    b = nodes.select(F.col("id").alias("dst"), F.col("what").alias("to"))
    return {(r["type"], r["in"], r["from"], r["to"]) for r in graph.edges.join(a, "src").join(b, "dst").collect()}


def test_parse_is_not_fooled_by_strings_and_comments(graph):
    names = {r["name"] for r in graph.nodes.where("type = 'Function' AND defined").collect()}
    assert names == {"helper", "count_rows", "f", "q"}
    assert graph.nodes.where("type = 'Function' AND NOT defined").count() == 4  # make, strcpy, use, g
    assert {r["name"] for r in graph.nodes.where("type = 'Field'").collect()} == {"length", "data"}
    assert {r["name"] for r in graph.nodes.where("type = 'GlobalVariable'").collect()} == {"total", "len"}
    assert {r["name"] for r in graph.nodes.where("type = 'Include'").collect()} == {"string.h", "own.h"}
    assert graph.nodes.where("type = 'Comment'").count() == 2


def test_edges(linked):
    has = lambda *e: any(all(x is None or x == y for x, y in zip(e, found, strict=True)) for found in linked)
    assert has("CALLS", "count_rows", "Function:count_rows", "Function:helper")
    assert has("CALLS", "count_rows", None, "Function:strcpy")
    assert has("DEFINES_FIELD", "count_rows", "Assignment:self->length = rows", "Field:length")
    assert has("USES_FIELD", "count_rows", None, "Field:length")
    assert has("USES_GLOBAL", "count_rows", None, "GlobalVariable:total")
    assert has("DEFINES_GLOBAL", "count_rows", None, "GlobalVariable:total")
    assert has("HAS_TYPE", "count_rows", "LocalVariable:self", "Struct/Class:Ragged")
    assert has("DEF_USE", "count_rows", "Assignment:rows = rows + 1", "Assignment:self->length = rows")
    assert has("HAS_SEMANTIC_FACT", "helper", "Condition:if (p == NULL)", "SemanticFact:null_check")
    # the parameter hides nothing of the field, and the field is no variable
    assert not has("USES_GLOBAL", None, None, "GlobalVariable:length")


def test_scopes(graph, linked):
    # a local of that name hides the global, a member of that name is none of it
    assert not any(t == "USES_GLOBAL" and fn == "f" for t, fn, _, _ in linked)
    assert any(t == "USES_GLOBAL" and fn == "q" for t, fn, _, _ in linked)
    uses = graph.nodes.where("function = 'f' AND code LIKE 'use(x)%' AND type = 'Statement'").select("id")
    assert graph.edges.join(uses, F.col("src") == F.col("id")).where("type = 'USES_VARIABLE'").select("dst").distinct().count() >= 1
    # a comparison counts as a definition of nothing known, and gives no edge
    assert not any(t == "DEFINES_VARIABLE" and fn == "q" for t, fn, _, _ in linked)


def test_security_context_of_the_sample(spark, graph):
    targets = g.find_functions(graph.nodes, spark.createDataFrame([("count_rows",), ("missing",)], "name string"))
    assert [r["name"] for r in targets.collect()] == ["count_rows"]
    nodes, edges = g.security_context(graph, targets.select("target", "name"))
    assert nodes.count() > 20 and edges.count() > 20
    summary = g.summarize_context(graph, nodes).first()
    assert {"count_rows", "helper", "strcpy", "make"} <= set(summary["functions"])
    assert summary["facts"] >= summary["guards"] > 0
    small, _ = g.security_context(graph, targets.select("target", "name"), max_nodes=5)
    assert small.count() == 5
    kept, among = g.risk_slice(graph, targets.select("target", "name"), ["null"])
    assert 0 < kept.count() < nodes.count() and among.count() > 0
    facts = g.semantic_facts(graph, targets.select("target", "name"))
    assert facts.count() > 3
    assert g.quality(graph).first().asDict()["unresolved_calls"] == 4


def test_files_by_name_and_suffix(spark, graph):
    found = {r["path"]: r["target"] for r in g.find_files(graph.nodes, spark.createDataFrame([("sample.c",), ("mple.c",), ("x/sample.c",)], "path string")).collect()}
    assert set(found) == {"sample.c"}
    context = g.file_context(graph, spark.createDataFrame([("t", found["sample.c"])], "target string, file string"))
    assert context.count() >= 8


def test_scan_tree(spark, tmp_path):
    for name, text in (("a.c", "int a;"), ("build/b.c", "int b;"), ("c.min.js", "x"), ("d.txt", "d"), ("sub/E.H", "int e;"), ("big.c", "x" * 200)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files, skipped = code.scan_tree(spark, str(tmp_path), 100)
    assert [r["path"] for r in files.collect()] == ["a.c", "sub/E.H"]
    assert {(r["path"], r["reason"]) for r in skipped.collect()} == {("build/b.c", "inside skipped folder"), ("c.min.js", "skipped suffix"), ("big.c", "too large")}
