"""What operators make on the way grows with their input, not with the square of a group."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from arborlake.operators import graph as g
from arborlake.operators import inventory, lookup, symbols, windows
from arborlake.sources import outline_graph


def most_rows(spark, make):
    """The rows of make(), and the most rows that one step of its plan made."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = make()
        rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            at = todo.pop()
            made = at.metrics().get("numOutputRows")
            most = max(most, made.get().value()) if made.isDefined() else most
            todo += [at.children().apply(i) for i in range(at.children().size())]
        return rows, most
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="module")
def crowd(spark):
    """300 functions of one name, in one file, with 300 facts and 300 statements of that name."""
    n = spark.range(300)
    node = lambda prefix, kind, function, name: n.select(F.format_string(prefix + "%03d", "id").alias("id"), F.lit(kind).alias("type"), F.lit(name).alias("name"), F.lit(function).cast("string").alias("function"), F.lit("if (memcpy)").alias("code"))
    nodes = node("f", "Function", "f", "f").unionByName(node("k", "SemanticFact", "f", "bounds_check")).unionByName(node("s", "Condition", "f", None)).unionByName(node("x", "CallExpression", "f", "call"))
    edges = n.select(F.format_string("s%03d", "id").alias("src"), F.format_string("k%03d", "id").alias("dst"), F.lit("HAS_SEMANTIC_FACT").alias("type"))
    made = g.make_graph(nodes, edges)
    return g.Graph(made.nodes.localCheckpoint(), made.edges.localCheckpoint())


@pytest.fixture(scope="module")
def targets(spark):
    return spark.range(300).select(F.format_string("f%03d", "id").alias("target"), F.lit("f").alias("name")).localCheckpoint()


@pytest.mark.parametrize("find", [lookup.guards, lookup.facts, lambda *a: lookup.statement_search(*a[:3], limit=a[3])])
def test_first_rows_of_a_name_are_kept_before_the_targets(spark, crowd, targets, find):
    rows, most = most_rows(spark, lambda: find(crowd, targets, ["memcpy"], 3))
    assert len(rows) == 900 and {r["node"][1:] for r in rows} == {"000", "001", "002"}
    assert most < 5_000


def test_only_different_places_meet_spans(spark):
    points = spark.range(300).select(F.col("id").alias("point"), F.lit(1).alias("k"), (F.col("id") % 3).alias("at")).localCheckpoint()
    spans = spark.range(300).select(F.col("id").alias("span"), F.lit(1).alias("k"), F.lit(1).alias("a"), F.lit(2).alias("b")).localCheckpoint()
    rows, most = most_rows(spark, lambda: windows.range_join(points, spans, "k", "at", "a", "b", 2, [F.asc("a"), F.asc("span")], "point"))
    assert {(r["point"], r["span"], r["place"]) for r in rows} == {(p, s, s + 1) for p in range(300) if p % 3 for s in (0, 1)}
    assert most < 5_000


def test_equal_pairs_follow_their_ids(spark):
    rows = [(7, 4, 9), (7, 2, 8), (7, 3, 5)]
    found = []
    for order in (rows, rows[::-1]):
        pairs = spark.createDataFrame(order, "pair int, vulnerable_id int, fixed_id int").coalesce(1)
        found.append({(r["sample_id"], r["place"]) for r in inventory.load_candidates(pairs, F.lit(False), [F.asc("pair")], 2).collect()})
    assert found[0] == found[1] == {(2, 1), (8, 2), (3, 3), (5, 4)}


def sent(df):
    """The most rows that one exchange of the plan sends."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        most, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            at = todo.pop()
            made = at.metrics().get("shuffleRecordsWritten")
            most = max(most, made.get().value()) if made.isDefined() else most
            todo += [at.children().apply(i) for i in range(at.children().size())]
        return most
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_facts_of_a_name_meet_its_functions_without_an_exchange(spark, crowd, targets):
    facts = g.semantic_facts(crowd, targets)
    # 300 facts, the 300 statements they are about, and the function itself
    assert facts.count() == facts.distinct().count() == 300 * 601
    assert sent(facts) < 10_000


def test_a_target_of_several_names_has_its_facts_once(spark):
    nodes = spark.createDataFrame([("k1", "SemanticFact", "f"), ("k2", "SemanticFact", "h"), ("s", "Statement", "f")], "id string, type string, function string")
    edges = spark.createDataFrame([("s", "k1", "HAS_SEMANTIC_FACT"), ("s", "k2", "HAS_SEMANTIC_FACT")], "src string, dst string, type string")
    wanted = spark.createDataFrame([("t", "f"), ("t", "h"), ("t", "h"), ("u", "h"), ("v", None)], "target string, name string")
    found = sorted((r["target"], r["node"]) for r in g.semantic_facts(g.make_graph(nodes, edges), wanted).collect())
    assert found == [("t", "k1"), ("t", "k2"), ("t", "s"), ("t", "t"), ("u", "k2"), ("u", "s"), ("u", "u"), ("v", "v")]


@pytest.fixture
def rows_written(monkeypatch):
    """Rows of each table that is written on the way."""
    rows, real = [], g.written

    def count(df):
        out = real(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(g, "written", count)
    monkeypatch.setattr(lookup, "written", count)
    return rows


@pytest.fixture(scope="module")
def hub(spark):
    """100 functions that call one, which calls another; a line of two more after it."""
    n = spark.range(100).select(F.format_string("f%03d", "id").alias("id"))
    nodes = n.unionByName(spark.createDataFrame([(i,) for i in ("h", "y", "z")], "id string")).withColumn("type", F.lit("Function"))
    edges = n.select(F.col("id").alias("src"), F.lit("h").alias("dst")).unionByName(spark.createDataFrame([("h", "y"), ("y", "z")], "src string, dst string")).withColumn("type", F.lit("CALLS"))
    made = g.make_graph(nodes, edges)
    return g.Graph(made.nodes.localCheckpoint(), made.edges.localCheckpoint())


def test_many_sources_of_one_goal_are_one_search(spark, hub, rows_written):
    pairs = hub.nodes.select(F.col("id").alias("source"), F.lit("z").alias("goal"))
    lengths = {r["source"]: r["length"] for r in g.path_lengths(hub.edges, pairs).collect()}
    assert lengths == {f"f{i:03d}": 3 for i in range(100)} | {"h": 2, "y": 1, "z": 0}
    assert max(rows_written) <= 103


@pytest.mark.parametrize(("direction", "most"), [("both", None), ("out", 2), ("in", 1)])
def test_lengths_are_those_of_the_paths(spark, hub, direction, most):
    few = spark.createDataFrame([("f001", "z"), ("f001", "f002"), ("z", "h"), ("y", "y"), ("h", "f003"), ("h", "none")], "source string, goal string")
    paths = g.shortest_paths(hub.edges, few, most, direction=direction).groupBy("source", "goal").agg(F.max("step").alias("length"))
    of = lambda df: {(r["source"], r["goal"], r["length"]) for r in df.collect()}
    assert of(g.path_lengths(hub.edges, few, most, direction=direction)) == of(paths)


def test_nearest_nodes_keep_to_their_limit_on_the_way(spark, hub, rows_written):
    targets = hub.nodes.select(F.col("id").alias("target"))
    found = {(r["target"], r["node"], r["depth"]) for r in lookup.reached_set(hub, targets, 3, 5).collect()}
    assert max(rows_written) <= 103 * 10
    order = F.row_number().over(Window.partitionBy("target").orderBy("depth", "node"))
    whole = g.neighborhood(hub.edges, targets.withColumn("node", F.col("target")), 3).withColumn("p", order).where("p <= 5")
    assert found == {(r["target"], r["node"], r["depth"]) for r in whole.collect()}


def test_guards_meet_one_row_of_their_function(spark):
    rows = [("f", "a", 1, True, False), ("f", "b", 2, False, True), ("f", "c", 2, True, True), ("f", "d", 3, True, False), (None, "e", 1, True, False), (None, "x", 4, False, True), ("h", "y", 1, True, False)]
    statements = spark.createDataFrame(rows, "function string, id string, line int, guard boolean, sink boolean")
    found = lookup.guard_dominance(statements, F.col("guard"), F.col("sink"))
    assert {(r["function"], r["id"]) for r in found.collect()} == {("f", "a"), ("f", "c"), (None, "e")}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_bodies_send_no_rows_of_their_product(spark, crowd, targets):
    """300 functions of one name and one file, whose 300 facts and 300 macros each of them has."""
    n = spark.range(300)
    id_ = lambda prefix: F.format_string(prefix + "%03d", "id")
    other = n.select(id_("m").alias("id"), F.lit("GlobalVariable").alias("type"), F.lit("v").alias("name"), F.lit(None).cast("string").alias("function"), F.lit(None).cast("string").alias("code"))
    nodes = crowd.nodes.unionByName(other).unionByName(spark.createDataFrame([("file", "File", "a.c", None, None)], other.schema))
    held = n.select(F.lit("file").alias("src"), F.explode(F.array(F.struct(id_("f").alias("dst"), F.lit("FILE_HAS_FUNCTION").alias("type")), F.struct(id_("m").alias("dst"), F.lit("FILE_HAS_GLOBAL").alias("type")))).alias("x")).select("src", "x.*")
    made = g.make_graph(nodes, crowd.edges.select("src", "dst", "type").unionByName(held))
    graph = g.Graph(made.nodes.localCheckpoint(), made.edges.localCheckpoint())
    body = g.function_body(graph, targets.withColumn("node", F.col("target")), ["memcpy"])
    assert sent(body) < 20_000
    # itself, its file, 300 macros, 300 facts and the statements that they are about
    assert body.count() == body.distinct().count() == 300 * 902
    kept, edges = g.risk_slice(graph, targets, ["memcpy"])
    assert sent(edges) < 20_000
    plain = g.induced_edges(graph.edges, kept.localCheckpoint())
    assert edges.count() == plain.count() > 300 * 299 and edges.exceptAll(plain.select(edges.columns)).isEmpty()


def test_bodies_of_several_names_and_shared_nodes(spark):
    """A target of two names, a function in two files, and a fact that its file holds as well; each row once."""
    nodes = [(i, t, n, f, "memcpy") for i, t, n, f in [("f", "Function", "f", "f"), ("h", "Function", "h", "h"), ("F1", "File", "1", None), ("F2", "File", "2", None), ("kf", "SemanticFact", "b", "f"), ("kh", "SemanticFact", "b", "h"), ("m", "GlobalVariable", "m", None), ("s", "Statement", None, "f")]]
    links = [("F1", "f", "FILE_HAS_FUNCTION"), ("F2", "f", "FILE_HAS_FUNCTION"), ("F1", "h", "FILE_HAS_FUNCTION"), ("F1", "kh", "FILE_HAS_GLOBAL"), ("F1", "m", "FILE_HAS_GLOBAL"), ("F2", "m", "FILE_HAS_GLOBAL"), ("f", "s", "FUNCTION_HAS_STATEMENT"), ("s", "kf", "HAS_SEMANTIC_FACT"), ("h", "kh", "SEMANTICALLY_RELATED"), ("kf", "m", "SEMANTICALLY_RELATED"), ("kh", "m", "DEF_USE")]
    graph = g.make_graph(spark.createDataFrame(nodes, "id string, type string, name string, function string, code string"), spark.createDataFrame(links, "src string, dst string, type string"))
    functions = spark.createDataFrame([("f", "f", "f"), ("h", "h", "h"), ("x", "f", "f"), ("x", "h", "h")], "target string, node string, name string")
    got = sorted((r["target"], r["node"]) for r in g.function_body(graph, functions, ["memcpy"]).collect())
    of = {"f": "F1 F2 f kf kh m s", "h": "F1 h kh m", "x": "F1 F2 f h kf kh m s"}
    assert got == [(t, n) for t, all_ in of.items() for n in all_.split()]
    kept, edges = g.risk_slice(graph, functions.where("target <> 'x'").select("target", "name"), ["memcpy"])
    plain = g.induced_edges(graph.edges, kept)
    assert edges.exceptAll(plain.select(edges.columns)).isEmpty() and plain.select(edges.columns).exceptAll(edges).isEmpty() and edges.count() > 0


def test_statements_are_read_once_for_all_names_of_a_function(spark):
    """100 statements, of which one holds a name, meet 100 requests: only what holds a request's name goes on."""
    n = spark.range(100)
    statements = n.select(F.lit("a.c").alias("file"), F.lit(0).alias("fn"), F.col("id").cast("int").alias("idx"), F.col("id").cast("int").alias("line"), F.format_string("int v%d = 1;", "id").alias("code")).localCheckpoint()
    requests = n.select(F.format_string("r%d", "id").alias("request"), F.lit("a.c").alias("file"), F.lit(0).alias("fn"), F.format_string("v%d", "id").alias("symbol"), F.lit(None).cast("int").alias("source_line")).localCheckpoint()
    variables = n.select(F.lit("a.c").alias("file"), F.lit(0).alias("fn"), F.format_string("v%d", "id").alias("name"), F.col("id").cast("int").alias("line")).localCheckpoint()
    found = symbols.variable_statements(statements, variables, requests)
    assert sent(found) < 1_000
    assert {(r["request"], r["place"], r["idx"]) for r in found.collect()} == {(f"r{i}", p, idx) for i in range(100) for p, idx in ((1, -1), (2, i))}


def test_edges_are_distinct_before_they_are_multiplied(spark):
    """Calls to functions of a name go through no exchange after they met them, and edges of shared statement ids stay one each."""
    calls = "".join(f" n{i}();\n" for i in range(5))
    same = "int f(int a) {\n int v = a;\n}\n"
    files = [(f"a{i:02}.c", "".join(f"int n{j}(void) {{\n{calls}}}\n" for j in range(5))) for i in range(20)] + [("x.c", same + same), ("x.c", same), ("y:z.c", same)]
    graph = outline_graph.build(spark.createDataFrame(files, "path string, text string"))
    assert sent(graph.edges) < 5_000
    rows = graph.edges.select("src", "dst", "type")
    assert rows.count() == rows.distinct().count() and graph.edges.where("type = 'CALLS' AND src LIKE 'function:a%'").count() == 100 * 100


def test_edges_of_files_join_nothing(spark):
    """What stands in a file is linked by one exchange, by the file, and by windows over it; statements know their function."""
    files = spark.createDataFrame([("a.c", "int f(int a) {\n int v = a;\n g(v);\n}\n")], "path string, text string")
    plan = outline_graph.file_links(outline_graph.scanned(files))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
