"""Corpus and graph sources and sinks."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborlake.operators import graph as g
from arborlake.sources import corpus, graphs


def test_formats(spark, tmp_path):
    rows = [{"id": "1", "project": "p", "target": "1"}, {"id": "2", "project": "q", "target": "0"}]
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(rows[0]), "{bad", json.dumps(rows[1])]))
    (tmp_path / "b.json").write_text(json.dumps(rows))
    (tmp_path / "c.json").write_text(json.dumps({"rows": rows}))
    (tmp_path / "d.csv").write_text("id,project,target\n1,p,1\n2,q,0\n")
    (tmp_path / "e.tsv").write_text("id\tproject\ttarget\n1\tp\t1\n2\tq\t0\n")
    table = pa.Table.from_pylist(rows)
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as sink, pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    with pa.OSFile(str(tmp_path / "g.arrow"), "wb") as sink, pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "h.parquet"))
    for name in ("a.jsonl", "b.json", "c.json", "d.csv", "e.tsv", "f.arrow", "g.arrow", "h.parquet"):
        got = corpus.load_samples(spark, str(tmp_path / name))
        assert sorted((r["sample_id"], r["project"], r["is_vulnerable"]) for r in got.collect()) == [("1", "p", True), ("2", "q", False)], name
    with pytest.raises(ValueError):
        corpus.read(spark, "x.docx")
    assert corpus.read_many(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "d.csv")]).count() == 4


def test_aliases_and_missing_values(spark):
    rows = spark.createDataFrame(
        [(7, "demo", "f", "body", [1], "CVE-1; CVE-2", float("nan"), {"k": "v"}), (8, " ", None, "int g(int x) { }", [0], "", 3.0, {})],
        "idx int, Project string, function_name string, func_before string, label array<int>, cve string, fixed_func_idx double, meta map<string,string>",
    )
    got = {r["idx"]: r for r in corpus.normalize(rows).collect()}
    assert got[7]["project"] == "demo" and got[7]["cve_list"] == ["CVE-1", "CVE-2"] and got[7]["is_vulnerable"] and got[7]["sample_id"] == "7"
    assert json.loads(got[7]["extras"])["meta"] == {"k": "v"}
    assert got[8]["project"] == "unknown_project" and got[8]["func_name"] == "g" and not got[8]["is_vulnerable"]
    url = corpus.normalize(spark.createDataFrame([("https://x.org/own/name.git/", "1")], "repo_url string, vulnerable string")).first()
    assert url["project"] == "name" and url["is_vulnerable"] and url["func_name"] == "unknown_function"


def test_smoke_and_counts(spark):
    assert corpus.counts(corpus.smoke_samples(spark)).first().asDict() == {"rows": 2, "projects": 1, "functions": 1, "vulnerable": 1, "safe": 1}


def test_inventory(spark):
    rows = spark.createDataFrame([("Own", "https://X/Own", 5), ("own", None, 6)], "project string, project_url string, size int")
    got = {r["key"]: r["size"] for r in corpus.load_inventory(rows, ["size"]).collect()}
    assert got == {"Own": 5, "https://X/Own": 5, "own": 5, "https://x/own": 5}


def test_tree_stats(spark):
    lines = [("r", "100644 blob abc 120\tsrc/a.c"), ("r", "100644 blob abd 50\tREADME"), ("r", "040000 tree abe -\tsrc")]
    got = corpus.tree_stats(spark.createDataFrame(lines, "repo_key string, line string")).first().asDict()
    assert got == {"repo_key": "r", "files": 2, "source_files": 1, "bytes": 170, "source_bytes": 120, "largest": "src/a.c"}


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([("a", "Function", "f<1>", "x & y"), ("b", "File", "b.c", None)], "id string, type string, label string, code string")
    return g.make_graph(nodes, spark.createDataFrame([("b", "a", "FILE_HAS_FUNCTION")], "src string, dst string, type string"))


def test_graph_round_trip(spark, graph, tmp_path):
    for form in ("parquet", "json"):
        graphs.write(graph, str(tmp_path / form), form)
        back = graphs.read(spark, str(tmp_path / form), form)
        assert {r["id"] for r in back.nodes.collect()} == {"a", "b"} and back.edges.count() == 1
    assert [(r["kind"], r["type"], r["n"]) for r in graphs.manifest(graph).collect()][0] == ("edge", "FILE_HAS_FUNCTION", 1.0)
    graphs.write_csv(graph, str(tmp_path / "csv"))
    row = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv/nodes")).where("id = 'a'").first()
    assert json.loads(row["properties_json"]) == {"code": "x & y"}


def test_graphml(spark, graph, tmp_path):
    graphs.write_graphml(graph, str(tmp_path / "ml"))
    back = graphs.read_graphml(spark, str(tmp_path / "ml"))
    assert {(r["id"], r["label"], r["code"]) for r in back.nodes.collect()} == {("cpg:a", "f<1>", "x & y"), ("cpg:b", "b.c", None)}
    assert [(r["src"], r["dst"], r["type"]) for r in back.edges.collect()] == [("cpg:b", "cpg:a", "JOERN_FILE_HAS_FUNCTION")]
    assert graphs.read_graphml(spark, str(tmp_path / "ml"), max_nodes=1).edges.count() == 0


def test_dot(spark, tmp_path):
    text = 'digraph "g" {\nnode [shape=box];\n"1" [label="METHOD" NAME="f;{" LINE_NUMBER="3"]\n2 [label=CALL CODE="a -> \\"b\\""];\n"1" -> "2" [ label = "AST"];\n2 -> 9 [label=CFG]\n}'
    (tmp_path / "x.dot").write_text(text)
    got = graphs.read_dot(spark, str(tmp_path))
    assert {(r["id"], r["label"], r["name"], r["line_start"], r["code"]) for r in got.nodes.collect()} == {("cpg:1", "METHOD", "f;{", 3, None), ("cpg:2", "CALL", None, None, 'a -> "b"')}
    assert [(r["src"], r["dst"], r["type"]) for r in got.edges.collect()] == [("cpg:1", "cpg:2", "JOERN_AST")]


def test_upsert_and_metrics(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 0)], "key string, n int")
    assert [tuple(r) for r in graphs.upsert(old, new, "key", ["n"], 2).collect()] == [("c", 0), ("a", 1)]
    assert [tuple(r) for r in graphs.metric_rows(spark.range(1).select(F.lit(1).alias("n"), F.lit(0.5).alias("f1")), "strict").collect()] == [("strict", "n", "1"), ("strict", "f1", "0.5")]
