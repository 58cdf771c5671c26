"""Streams, selection, evaluation, ranking, the baseline and the query front end."""

import json

import pytest
from pyspark.sql import functions as F

from arborlake.operators import baseline, evaluate, rank, select, windows
from arborlake.operators import graph as g
from arborlake.plans import query_text
from arborlake.streaming import events, sink

EVENTS = [("a", 1, "start", None), ("b", 2, "start", 1.0), ("a", 3, "error", 2.0), ("a", 5, None, 4.0), ("b", 4, "done", None), ("a", 6, "done", None)]


def test_stream_reduces_to_the_batch_snapshot(spark, tmp_path):
    for i in range(3):
        lines = [json.dumps(dict(zip(("key", "seq", "status", "value"), e, strict=True))) for e in EVENTS[2 * i : 2 * i + 2]]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join([*lines, "{bad"]))
    stream = events.reduce_stream(events.read_events(spark, str(tmp_path / "in")).where("key IS NOT NULL"))
    events.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["key"]: r.asDict() for r in sink.read_table(spark, str(tmp_path / "out")).collect()}
    batch = {r["key"]: r.asDict() for r in events.snapshot(spark.createDataFrame(EVENTS, events.EVENT_SCHEMA)).collect()}
    assert got == batch
    assert got["a"] == {"key": "a", "status": "done", "value": 4.0, "n": 4, "errors": 1, "last_seq": 6}


def test_log_stream_and_quota(spark):
    rows = spark.createDataFrame([("RUN | a=1",), ("no fields",), ("",)], "value string")
    assert [(r["tag"], r["fields"]) for r in events.parse_log(rows).collect()] == [("RUN", {"a": "1"})]
    calls = spark.createDataFrame([("k", 1, "completed"), ("k", 2, "started"), ("k", 3, "error"), ("k", 4, "completed")], "k string, seq int, status string")
    assert [r["left"] for r in events.quota_left(calls, ["k"], ["seq"], 2).orderBy("seq").collect()] == [1, 1, 0, 0]


def test_metrics_without_decisions(spark):
    samples = spark.createDataFrame([("a", True), ("b", False)], "sample_id string, is_vulnerable boolean")
    predictions = spark.createDataFrame([("a", True, "inconclusive", None), ("b", False, "ok", "bad json")], "sample_id string, is_vulnerable boolean, decision_status string, parse_error string")
    m = evaluate.binary_metrics(evaluate.outcomes(samples, predictions)).first()
    assert (m["n_valid"], m["invalid"], m["f1"], m["accuracy_all"]) == (0, 2, 0.0, 0.0)
    rows = spark.createDataFrame([("inconclusive", None, None, True), ("skipped", None, True, True), ("done", None, True, None)], "status string, forced boolean, pred boolean, truth boolean")
    live = evaluate.live_metrics(rows).first()
    assert (live["inconclusive"], live["skipped"], live["completed"], live["f1"], live["accuracy"]) == (1, 1, 1, None, None)
    forced = evaluate.live_metrics(spark.createDataFrame([("inconclusive", True, None, True)], "status string, forced boolean, pred boolean, truth boolean")).first()
    assert (forced["completed"], forced["tp"], forced["f1"]) == (1, 1, 1.0)


def test_outcomes(spark):
    samples = spark.createDataFrame([(str(i), i % 2 == 0) for i in range(6)], "sample_id string, is_vulnerable boolean")
    predictions = spark.createDataFrame([("0", True, "", ""), ("1", False, "", ""), ("2", False, "", ""), ("3", True, "", ""), ("4", True, "error", "")], "sample_id string, is_vulnerable boolean, decision_status string, parse_error string")
    got = {r["sample_id"]: r["outcome"] for r in evaluate.outcomes(samples, predictions).collect()}
    assert got == {"0": "TP", "1": "TN", "2": "FN", "3": "FP", "4": "INVALID", "5": "MISSING"}


def test_curriculum(spark):
    size = {"big": 100, "mid": 10, "small": 2}
    rows = [(f"{p}-{label[0]}", p, label, n, i * 2 + j) for i, (p, n) in enumerate(size.items()) for j, label in enumerate(("vulnerable", "fixed"))]
    df = spark.createDataFrame(rows, "sample_id string, project string, label string, files int, seq int")
    got = select.curriculum(df, ["project"], ["files"], limit=2).collect()
    assert [(r["vulnerable_id"], r["fixed_id"]) for r in got] == [("small-v", "small-f"), ("mid-v", "mid-f")]


def test_pairs(spark):
    rows = spark.createDataFrame([(10, "10", "p", None, "f.c", "g", True, 11.0, 0), (11, "11", "q", None, "f.c", "g", False, None, 1), (1, "1", "p", " ", "f.c", "g", False, None, 2)], "idx long, sample_id string, project string, project_url string, filepath string, func_name string, is_vulnerable boolean, fixed_func_idx double, seq long")
    assert [tuple(r) for r in select.fixed_pairs(rows, pair_by="fixed_idx").collect()] == [("10", "11")]
    assert [tuple(r) for r in select.fixed_pairs(rows).collect()] == [("10", "1")]


def test_labels_and_scores(spark):
    labels = spark.createDataFrame([("Vuln",), ("non_vulnerable",), ("maybe",), ("1",)], "x string").select(select.label_of(F.col("x"))).collect()
    assert [r[0] for r in labels] == ["vulnerable", "fixed", "maybe", "vulnerable"]
    scores = spark.createDataFrame([(0, 5, 2), (9, 5, 2), (None, None, None)], "a int, b int, c int").select(select.size_score(["a"], ["b", "c"])).collect()
    assert [r[0] for r in scores] == [7000.0, 9.0, None]
    assert [r["p"] for r in select.shuffle(spark.range(20).withColumnRenamed("id", "p"), "p", 1).collect()] != list(range(20))


def test_equal_scores_break_by_id(spark):
    rows = spark.createDataFrame([("g", f"e{i}", "r", f"k{i % 3}", 50) for i in range(9)], "g string, evidence_id string, role string, key string, score int")
    assert [r["evidence_id"] for r in rank.curate(rows, ["g"], other=2).orderBy("place").collect()] == ["e0", "e1"]


def test_window_bounds_are_inclusive(spark):
    rows = spark.createDataFrame([("u", 0), ("u", 60), ("u", 121)], "u string, at long")
    got = windows.trailing_counts(rows, ["u"], "at", {"minute": 60}).orderBy("at").collect()
    assert [r["minute"] for r in got] == [1, 2, 1]
    wait = windows.required_wait(rows, ["u"], "at", {60: 2}).orderBy("at").collect()
    assert [r["wait"] for r in wait] == [0, 1, 0]


def test_def_use_of_one_statement(spark):
    rows = spark.createDataFrame([("v", 1, True, False), ("v", 2, True, True), ("v", 3, False, True)], "v string, s int, d boolean, u boolean")
    got = windows.def_use(rows, ["v"], ["s"], "s", "d", "u").collect()
    assert [(r["definition"], r["use"]) for r in got] == [(2, 3)]


def test_as_of(spark):
    left = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("k", 3, "c"), ("z", 9, "d")], "k string, t int, x string")
    right = spark.createDataFrame([("k", 3, "r3"), ("k", 4, "r4")], "k string, t int, v string")
    got = {r["x"]: r["asof_v"] for r in windows.as_of(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {"a": None, "b": "r4", "c": "r3", "d": None}


def test_registry_and_privacy(spark):
    one = spark.createDataFrame([("k", 1)], "kg_id string, secret int")
    assert [r["violation"] for r in evaluate.registry_check(one, one, one.where("false"), one).collect()] == ["no_label"]
    assert evaluate.project_rows(one, "student", ["secret"]).columns == ["kg_id"] and evaluate.project_rows(one, "admin", ["secret"]).columns == ["kg_id", "secret"]


def test_baseline_learns(spark, tmp_path):
    rows = [(f"void f{i}(char *d) {{ strcpy(d, s{i}); }}" if i % 3 else f"void f{i}(char *d) {{ if (n) strncpy(d, s{i}, n); }}", int(i % 3 > 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "code string, label int")
    model = baseline.fit(df, max_iter=50)
    baseline.save(model, str(tmp_path / "m"))
    scored = baseline.predict(baseline.load(str(tmp_path / "m")), df.unionByName(spark.createDataFrame([(None, 0)], "code string, label int")))
    assert scored.where("label = prediction").count() >= 60 and scored.where("probability < 0 OR probability > 1").count() == 0


@pytest.mark.parametrize(
    ("raw", "kind", "args"),
    [
        ("", "security_context", {}),
        ('callers("f")', "callers", {"target_function": "f"}),
        ("variable_flow(f, symbol='a,b', depth=9)", "variable_flow", {"target_function": "f", "symbol": "a,b", "depth": 9}),
        ("risk_slice(target_function=f, risk_terms=['x', \"y z\"])", "risk_slice", {"target_function": "f", "risk_terms": ["x", "y z"]}),
        ("kind=callees function=g", "callees", {"target_function": "g"}),
        ("show security context for function parse_it", "security_context", {"target_function": "parse_it"}),
    ],
)
def test_query_parser(raw, kind, args):
    q = query_text.parse(raw)
    assert (q.kind, q.args) == (kind, args)


def test_query_checks():
    check = lambda text: query_text.check(query_text.parse(text), text)
    assert check("SELECT * FROM nodes").status == "invalid_query"
    assert check("<function>").status == "invalid_query"
    assert check("nonsense(f)").status == "invalid_query"
    assert check("shortest_path(source_node=a)").error == "missing target_node"
    assert check("function_context(f, depth=99)").args["depth"] == 6
    # 0 stands for the default
    assert check("function_context(f, depth=0)").args["depth"] == 2
    assert check("call_neighborhood(f, direction=up)").status == "invalid_query"
    q = query_text.check(query_text.parse_contract({"query_type": "evidence_slice", "args": {"target": "f", "risk_terms": "a, b", "target_statement": "x"}}))
    assert (q.kind, q.args) == ("security_context", {"target_function": "f", "risk_terms": ["a", "b"]})


def test_queries_run(spark):
    nodes = spark.createDataFrame([("a", "Function", "f", "f", "x.c"), ("b", "Function", "h", "h", "x.c"), ("file", "File", "x.c", None, "x.c"), ("v", "LocalVariable", "n", "f", "x.c")], "id string, type string, name string, function string, file string")
    graph = g.make_graph(nodes, spark.createDataFrame([("a", "b", "CALLS"), ("file", "a", "FILE_HAS_FUNCTION"), ("a", "v", "FUNCTION_HAS_LOCAL")], "src string, dst string, type string"))
    ids = lambda text: {r["node"] for r in query_text.execute(spark, graph, text)[1].collect()}
    assert ids("callees(f)") == {"a", "b"} and ids("callers(h)") == {"a", "b"}
    assert ids("call_neighborhood(f, depth=1)") == {"a", "b"} and ids("function_context(f, depth=1)") == {"a", "b", "file", "v"}
    assert ids("file_context(file=x.c, depth=1)") == {"file", "a"} and ids("variable_flow(f, symbol=n, depth=1)") == {"v", "a"}
    assert ids("shortest_path(source_node=file, target_node=b)") == {"file", "a", "b"} and {"a", "b", "v"} <= ids("security_context(f)")
    assert {"a", "v"} <= ids("risk_slice(f)") and ids("semantic_facts(f)") == {"a"}
    statuses = [q.status for q in query_text.execute_batch(spark, graph, ["callers(f)", "callers(f)", "callers(nobody)", "", "callees(f)"], 4)]
    assert statuses == ["ok", "duplicate", "no_results", "invalid_query", "over_budget"]
