"""Graph sources and sinks: Parquet and JSON folders, CSV, GraphML and DOT import and export, manifests, result indexes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.operators.graph import Graph, degree, edge_id, type_counts
from arborlake.session import checkpoint
from arborlake.sources.dot_files import statements

MAX_NODES, MAX_EDGES = 6_000, 24_000


def write(graph: Graph, path: str, form: str = "parquet") -> None:
    """nodes, edges and manifest as folders; Parquet by type, or JSON lines."""
    for name, rows in (("nodes", graph.nodes), ("edges", graph.edges)):
        out = rows.write.mode("overwrite")
        out.partitionBy("type").parquet(f"{path}/{name}") if form == "parquet" else out.json(f"{path}/{name}")
    manifest(graph).write.mode("overwrite").json(f"{path}/manifest")


def read(spark: SparkSession, path: str, form: str = "parquet") -> Graph:
    """What write() wrote."""
    load = spark.read.parquet if form == "parquet" else spark.read.json
    return Graph(load(f"{path}/nodes"), load(f"{path}/edges"))


def manifest(graph: Graph) -> DataFrame:
    """(kind, type, n) of nodes and edges by falling count and type, and the mean degree."""
    parts = [type_counts(rows).select(F.lit(kind).alias("kind"), "type", F.col("n").cast("double").alias("n")) for kind, rows in (("node", graph.nodes), ("edge", graph.edges))]
    mean = degree(graph.edges).agg(F.avg("degree").alias("n")).select(F.lit("quality").alias("kind"), F.lit("mean_degree").alias("type"), "n")
    return parts[0].unionByName(parts[1]).unionByName(mean).orderBy("kind", F.desc("n"), "type")


def flatten(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep as text, blanks for nulls, and every other column in one JSON text."""
    rest = [c for c in rows.columns if c not in keep]
    props = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in keep], props.alias("properties_json"))


def write_csv(graph: Graph, path: str) -> None:
    """nodes and edges as CSV with their properties as JSON text."""
    for name, rows, keep in (("nodes", graph.nodes, ["id", "type", "label"]), ("edges", graph.edges, ["edge_id", "src", "dst", "type"])):
        flatten(rows, keep).write.mode("overwrite").option("header", "true").option("escape", '"').csv(f"{path}/{name}")


def write_graphml(graph: Graph, path: str) -> None:
    """One GraphML file in a folder, for a graph that fits a viewer. Elements are made in parallel and written in order by one task."""
    text = lambda c: F.regexp_replace(F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\n]", " ")
    data = lambda names: F.concat(*[F.concat(F.lit(f'<data key="{c}">'), text(c), F.lit("</data>")) for c in names])
    attrs = [c for c in graph.nodes.columns if c != "id"]
    nodes = graph.nodes.select(F.lit(1).alias("part"), F.col("id").alias("k"), F.concat(F.lit('<node id="'), text("id"), F.lit('">'), data(attrs), F.lit("</node>")).alias("value"))
    edges = graph.edges.select(F.lit(2).alias("part"), F.col("edge_id").alias("k"), F.concat(F.lit('<edge id="'), text("edge_id"), F.lit('" source="'), text("src"), F.lit('" target="'), text("dst"), F.lit('">'), data(["type"]), F.lit("</edge>")).alias("value"))
    keys = "".join(f'<key id="{escape(c)}" for="all" attr.name="{escape(c)}" attr.type="string"/>' for c in dict.fromkeys([*attrs, "type"]))
    spark = graph.nodes.sparkSession
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit("").alias("k"), F.lit(f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">').alias("value"))
    tail = spark.range(1).select(F.lit(3).alias("part"), F.lit("").alias("k"), F.lit("</graph></graphml>").alias("value"))
    head.unionByName(nodes).unionByName(edges).unionByName(tail).coalesce(1).sortWithinPartitions("part", "k").select("value").write.mode("overwrite").text(path)


def _capped(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> Graph:
    nodes = nodes.dropDuplicates(["id"]).orderBy("id").limit(max_nodes)
    ends = nodes.select("id")
    edges = edges.distinct().join(ends, F.col("src") == F.col("id"), "left_semi").join(ends, F.col("dst") == F.col("id"), "left_semi")
    edges = edges.orderBy("src", "dst", "type").limit(max_edges)
    return Graph(nodes, edges.select(edge_id(F.col("src"), F.col("type"), F.col("dst")).alias("edge_id"), "src", "dst", "type"))


def _alias(data: str, *names: str):
    """The value of the first of several data keys that has one, in any case."""
    of = lambda n: F.try_element_at(F.transform(F.filter(F.col(data), lambda d: F.lower(d["_key"]) == n.lower()), lambda d: d["_VALUE"]), F.lit(1))
    return F.coalesce(*[of(n) for n in names])


def read_graphml(spark: SparkSession, path: str, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES, prefix: str = "cpg:", files: str = "*") -> Graph:
    """An exported GraphML graph, of one file or of the files under a folder whose names fit `files`, attributes under any of their usual names; the first max_nodes ids and max_edges edges among them."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    some = lambda tag, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", files).option("rowTag", tag).format("xml").load(path)
    nodes, edges = some("node", f"_id string, {data}"), some("edge", f"_id string, _source string, _target string, {data}")
    kind = F.coalesce(_alias("data", "labelV", "label", "type"), F.lit("UNKNOWN"))
    n = nodes.select(
        F.concat(F.lit(prefix), "_id").alias("id"), F.lit("JoernCPGNode").alias("type"), F.substring_index(kind, "|", 1).alias("label"), _alias("data", "NAME", "name", "METHOD_FULL_NAME").alias("name"),
        _alias("data", "FILENAME", "file").alias("file"), _alias("data", "METHOD_SHORT_NAME", "function").alias("function"), _alias("data", "LINE_NUMBER", "line_start").try_cast("int").alias("line_start"), _alias("data", "CODE", "code").alias("code"),
    )
    relation = F.upper(F.coalesce(_alias("data", "labelE", "label", "type"), F.lit("EDGE")))
    e = edges.select(F.concat(F.lit(prefix), "_source").alias("src"), F.concat(F.lit(prefix), "_target").alias("dst"), F.concat(F.lit("JOERN_"), relation).alias("type"))
    return _capped(n, e, max_nodes, max_edges)


_DOT_ID = r'"(?:\\.|[^"\\])*"|[A-Za-z0-9_.]+'
_DOT_ATTRIBUTE = re.compile(rf"([A-Za-z_]\w*)\s*=\s*({_DOT_ID})")
_DOT_EDGE = re.compile(rf"^\s*({_DOT_ID})\s*->\s*({_DOT_ID})\s*(?:\[(.*)\])?\s*$", re.S)
_DOT_NODE = re.compile(rf"^\s*({_DOT_ID})\s*\[(.*)\]\s*$", re.S)


def parse_dot(statement: str) -> tuple | None:
    """(what, id, other, label, name, code, line) of the node or edge that a DOT statement makes."""
    clean = lambda x: x[1:-1].replace('\\"', '"') if x.startswith('"') else x
    if m := _DOT_EDGE.match(statement):
        attrs = {k.lower(): clean(v) for k, v in _DOT_ATTRIBUTE.findall(m[3] or "")}
        return "edge", clean(m[1]), clean(m[2]), attrs.get("label", "EDGE"), None, None, None
    if (m := _DOT_NODE.match(statement)) and clean(m[1]) not in ("node", "edge", "graph"):
        attrs = {k.lower(): clean(v) for k, v in _DOT_ATTRIBUTE.findall(m[2])}
        line = attrs.get("line_number", "")
        return "node", clean(m[1]), None, attrs.get("label", "UNKNOWN"), attrs.get("name"), attrs.get("code"), int(line) if line.isdigit() else None
    return None


def dot_rows(spark: SparkSession, path: str) -> DataFrame:
    """(what, id, other, label, name, code, line) of all nodes and edges in the DOT files under a path, which are read by splits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for text in frame["text"] if (r := parse_dot(text))]
            yield pd.DataFrame(rows, columns=["what", "id", "other", "label", "name", "code", "line"]).astype({"line": "Int32"})

    return statements(spark, path).mapInPandas(run, "what string, id string, other string, label string, name string, code string, line int")


def read_dot(spark: SparkSession, path: str, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES, prefix: str = "cpg:") -> Graph:
    """The graph of exported DOT files: the first max_nodes ids and max_edges edges among them."""
    rows = checkpoint(dot_rows(spark, path))
    n = rows.where("what = 'node'").select(F.concat(F.lit(prefix), "id").alias("id"), F.lit("JoernCPGNode").alias("type"), "label", "name", F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("function"), F.col("line").alias("line_start"), "code")
    e = rows.where("what = 'edge'").select(F.concat(F.lit(prefix), "id").alias("src"), F.concat(F.lit(prefix), "other").alias("dst"), F.concat(F.lit("JOERN_"), F.upper("label")).alias("type"))
    return _capped(n, e, max_nodes, max_edges)


def read_export(spark: SparkSession, path: str, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES, prefix: str = "cpg:") -> Graph:
    """An export folder of any depth: its GraphML files (graphml, xml), or its DOT files if it has none; a folder with neither, or none, gives an empty graph."""
    names = lambda *ends: [f"*.{e}" for e in ends]

    def found(pattern: str) -> bool:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        try:
            return not files.load(path).select("path").limit(1).isEmpty()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    ml = [p for p in names("graphml", "xml") if found(p)]
    if ml:
        return read_graphml(spark, path, max_nodes, max_edges, prefix, "*.{graphml,xml}")
    if found("*.dot"):
        return read_dot(spark, path, max_nodes, max_edges, prefix)
    empty = spark.createDataFrame([], "id string, type string, label string, name string, file string, function string, line_start int, code string")
    return Graph(empty, spark.createDataFrame([], "edge_id string, src string, dst string, type string"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[str], limit: int | None = None) -> DataFrame:
    """old and new rows as one index: of each key the row of new, in the given order."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("_new"))
    out = both.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place", "_new").orderBy(*order)
    return out.limit(limit) if limit else out


def metric_rows(metrics: DataFrame, section: str) -> DataFrame:
    """A one-row table of numbers as rows (section, metric, value)."""
    columns = metrics.columns
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in columns])
    return metrics.select(F.lit(section).alias("section"), F.explode(pairs).alias("m")).select("section", "m.*")
