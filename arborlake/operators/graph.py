"""Property graphs as two DataFrames, and the retrieval operators over them.

nodes: id, type, label, name, file, function, line_start, code. edges: edge_id, src, dst, type. Every retrieval takes a
table of targets, so one job answers all of them; a single target is the case of one row.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.session import broadcast_if_small, is_small, written

#: The edge types of each kind of traversal.
CALL_EDGES = ("CALLS", "CALLS_INDIRECT", "STATEMENT_CALLS")
DIRECT_CALLS = ("CALLS", "CALLS_INDIRECT")
DATA_EDGES = (
    "FUNCTION_HAS_PARAMETER", "FUNCTION_HAS_LOCAL", "FILE_HAS_GLOBAL", "USES_VARIABLE", "DEFINES_VARIABLE", "USES_GLOBAL", "DEFINES_GLOBAL",
    "DEF_USE", "DATA_DEPENDS_ON", "USES_FIELD", "DEFINES_FIELD", "ACCESSES_FIELD", "HAS_TYPE", "TYPE_HAS_FIELD",
)
CFG_EDGES = ("FUNCTION_HAS_STATEMENT", "CFG_NEXT", "CONTROLS", "RETURNS")
SEMANTIC_EDGES = ("HAS_SEMANTIC_FACT", "SEMANTICALLY_RELATED")
BODY_EDGES = ("FUNCTION_HAS_PARAMETER", "FUNCTION_HAS_LOCAL", "FUNCTION_HAS_STATEMENT", "AST_CHILD", "RETURNS", "CONTROLS", "SEMANTICALLY_RELATED")
VARIABLE_TYPES = ("LocalVariable", "FunctionParameter", "GlobalVariable", "Field")
STATEMENT_TYPES = ("Statement", "Assignment", "ReturnStatement", "Condition", "Loop", "OperatorExpression")
RISK_KEEP_TYPES = ("Function", "FunctionParameter", "LocalVariable", "GlobalVariable", "Field", "Struct/Class", "Statement", "Assignment", "ReturnStatement", "Condition", "Loop", "CallExpression", "SemanticFact")
GUARD_TERMS = ("bounds", "null", "guard", "check", "sanitizer", "error_return", "return", "size")
RISK_TERMS = ("pointer", "array", "bounds", "size", "copy", "read", "write", "allocation", "free", "null", "cast", "return", "guard")
TYPE_WEIGHTS = {
    "Function": 220, "FunctionParameter": 180, "LocalVariable": 180, "GlobalVariable": 180, "Field": 170, "Condition": 150, "Loop": 150,
    "ReturnStatement": 150, "Assignment": 150, "CallExpression": 150, "Statement": 140, "SemanticFact": 140, "File": 110, "Include": 100,
    "Macro": 100, "Type": 100, "Struct/Class": 100, "JoernCPGNode": 50,
}
OTHER_WEIGHT = 20
TARGET_SCORE = 10_000
DEGREE_CAP = 40


@dataclass
class Graph:
    """A property graph."""

    nodes: DataFrame
    edges: DataFrame


def edge_id(src: Column, kind: Column, dst: Column) -> Column:
    """Stable id of an edge, from what it connects."""
    return F.substring(F.sha1(F.concat_ws("|", src, kind, dst)), 1, 16)


def _one_each(nodes: DataFrame) -> DataFrame:
    """One whole node of each id, the least by its columns in order."""
    values = [c for c in nodes.columns if c != "id"]
    if not values:
        return nodes.distinct()
    return nodes.groupBy("id").agg(F.min(F.struct(*values)).alias("_node")).select("id", *[F.col(f"_node.{c}").alias(c) for c in values])


def make_graph(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Distinct nodes by id, distinct edges by (src, dst, type), and no edge with an end outside the nodes.

    Of nodes with one id, one whole node stays, the least by its columns in order.
    """
    merged = _one_each(nodes)
    # by dst, then by src: the distinct rows after that are already together
    ends, rows = merged.select("id"), edges.select("src", "dst", "type")
    kept = rows.join(ends, rows["dst"] == ends["id"], "left_semi")
    kept = kept.join(ends, kept["src"] == ends["id"], "left_semi").distinct()
    return Graph(merged, kept.select(edge_id(F.col("src"), F.col("type"), F.col("dst")).alias("edge_id"), "src", "dst", "type"))


def type_counts(rows: DataFrame) -> DataFrame:
    """(type, n) of nodes or edges."""
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): ends at each node; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def top_degree(graph: Graph, k: int, types: Iterable[str] | None = None) -> DataFrame:
    """(id, degree) of the k nodes of most edges; ties by id. One row for each partition meets in one place, at most k."""
    nodes = graph.nodes.where(F.col("type").isin(*types)) if types else graph.nodes
    return degree(graph.edges).join(nodes.select("id"), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(k)


def adjacency(edges: DataFrame, direction: str = "both", types: Iterable[str] | None = None) -> DataFrame:
    """(node, other, edge_id) for each way an edge may be followed."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction}")
    rows = edges.where(F.col("type").isin(*types)) if types else edges
    out = rows.select(F.col("src").alias("node"), F.col("dst").alias("other"), "edge_id")
    back = rows.select(F.col("dst").alias("node"), F.col("src").alias("other"), "edge_id")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int = 1, types: Iterable[str] | None = None, direction: str = "both", nodes: DataFrame | None = None) -> DataFrame:
    """(target, node, depth): what each target's seeds (target, node) reach in at most depth steps, at its least depth.

    With `nodes` (id), seeds that are none of them are left out; without, every seed counts as a node.

    Each step joins the frontier with the edges, by broadcast while both the frontier and what has been reached are
    small, by shuffle beyond that; what is found is then grouped with what has been reached, which sorts neither. The
    edges are read once a step, so give edges that are written out.
    """
    ways = adjacency(edges, direction, types).select("node", "other")
    start = seeds.select("target", "node").distinct()
    if nodes is not None:
        start = start.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").select("target", "node")
    reached = written(start.withColumn("depth", F.lit(0)))
    frontier = reached
    for step in range(1, depth + 1):
        found = ways.join(broadcast_if_small(frontier.select("target", "node")), "node").select("target", F.col("other").alias("node"))
        if is_small(reached):
            new = found.distinct().join(F.broadcast(reached.select("target", "node")), ["target", "node"], "left_anti").withColumn("depth", F.lit(step))
        else:
            new = reached.unionByName(found.withColumn("depth", F.lit(step))).groupBy("target", "node").agg(F.min("depth").alias("depth")).where(F.col("depth") == step)
        frontier = written(new)
        reached = reached.unionByName(frontier)
    return reached


def neighborhood_edges(edges: DataFrame, reached: DataFrame, depth: int, types: Iterable[str] | None = None, direction: str = "both") -> DataFrame:
    """(target, edge_id) of edges followed from a node of less than full depth; edges between nodes of full depth are not.

    reached holds each node of a target once and edges each edge once, as neighborhood and make_graph give them. Followed one way, an edge then
    has one row for each target already; only edges followed from both ends are compared.
    """
    inner = broadcast_if_small(reached.where(F.col("depth") < depth).select("target", "node"))
    found = adjacency(edges, direction, types).join(inner, "node").select("target", "edge_id")
    return found.distinct() if direction == "both" else found


def induced_edges(edges: DataFrame, nodes: DataFrame, inner: Column | None = None) -> DataFrame:
    """(target, edge_id, src, dst, type) of edges with both ends among the nodes (target, node) of one target.

    inner, a condition over nodes that hold each node of a target once, tells from which nodes every edge is known to lead to another of the same
    target's nodes, as from the nodes of less than full depth in a neighbourhood that follows all edges. Those edges are not looked up.
    """
    shown = ["target", "edge_id", "src", "dst", "type"]
    ends = nodes.select("target", "node").distinct()
    if is_small(nodes):
        inner, ends = None, F.broadcast(ends)
    begins = ends if inner is None else nodes.where(~inner).select("target", "node")
    starts = edges.join(begins, edges["src"] == begins["node"]).drop("node")
    found = starts.join(ends.withColumnRenamed("node", "dst"), ["target", "dst"], "left_semi").select(*shown)
    if inner is None:
        return found
    sure = nodes.where(inner).select("target", "node")
    return edges.join(sure, edges["src"] == sure["node"]).select(*shown).unionByName(found)


def limited_induced(edges: DataFrame, reached: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first `limit` nodes of each target by depth and id, and the edges among them."""
    order = Window.partitionBy("target").orderBy("depth", "node")
    # written, as the nodes and both ends of edges are read from it
    kept = written(reached.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place"))
    return kept, induced_edges(edges, kept)


def incident_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, edge_id) of edges with at least one end among the nodes (target, node)."""
    return adjacency(edges).join(nodes.select("target", "node"), "node").select("target", "edge_id").distinct()


def callers(edges: DataFrame, targets: DataFrame, types: Iterable[str] = DIRECT_CALLS) -> DataFrame:
    """(target, node) that call each target in one step."""
    rows = edges.where(F.col("type").isin(*types))
    return rows.join(targets.select("target"), rows["dst"] == F.col("target")).select("target", F.col("src").alias("node")).distinct()


def callees(edges: DataFrame, targets: DataFrame, types: Iterable[str] = DIRECT_CALLS) -> DataFrame:
    """(target, node) that each target calls in one step."""
    rows = edges.where(F.col("type").isin(*types))
    return rows.join(targets.select("target"), rows["src"] == F.col("target")).select("target", F.col("dst").alias("node")).distinct()


def find_functions(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, target): for each wanted name the defined function of least id, else any function of that name."""
    rows = nodes.where(F.col("type") == "Function").join(names.select("name").distinct(), "name")
    defined = F.coalesce(F.col("defined"), F.lit(True)) if "defined" in nodes.columns else F.lit(True)
    return rows.groupBy("name").agg(F.min_by("id", F.struct((~defined).alias("_"), "id")).alias("target"))


def find_files(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, target): for each wanted path the file of that name, else the least id whose name ends with it.

    Names and paths meet on their last component, so nothing is compared all against all.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    files = nodes.where(F.col("type") == "File").select("id", "name", last(F.col("name")).alias("last"))
    wanted = paths.select("path", F.replace("path", F.lit("\\"), F.lit("/")).alias("clean")).withColumn("last", last(F.col("clean")))
    found = wanted.join(files, "last").where(F.expr("endswith(name, clean)"))
    return found.groupBy("path").agg(F.min_by("id", F.struct((F.col("name") != F.col("clean")).alias("_"), "id")).alias("target"))


def variable_seeds(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(target, node) for rows (target, function, symbol): variables of the function, else globals of that name."""
    variables = nodes.where(F.col("type").isin(*VARIABLE_TYPES)).select(F.col("id").alias("node"), F.col("name").alias("symbol"), "function")
    local = wanted.join(variables, ["function", "symbol"]).select("target", "node")
    missing = wanted.join(local, "target", "left_anti")
    globals_ = nodes.where(F.col("type") == "GlobalVariable").select(F.col("id").alias("node"), F.col("name").alias("symbol"))
    return local.unionByName(missing.join(globals_, "symbol").select("target", "node"))


def variable_flow(graph: Graph, wanted: DataFrame, depth: int = 3) -> DataFrame:
    """(target, node, depth) along data edges from each wanted symbol."""
    return neighborhood(graph.edges, variable_seeds(graph.nodes, wanted), depth, (*DATA_EDGES, "FUNCTION_HAS_STATEMENT", "FILE_HAS_GLOBAL"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int | None = None, types: Iterable[str] | None = None, direction: str = "both") -> DataFrame:
    """(source, goal, step, node, edge_id) of one shortest path for each pair that is linked, in at most `most` steps if that is given.

    Searches from each source carry the way to each newly reached node, of equal ones the way by the least (node before,
    edge). A source whose goals are all reached, or that reaches nothing new, searches no further. Each step is written
    out, and what has been reached is written together every few steps, so long paths do not make long plans.
    """
    ways = adjacency(edges, direction, types)
    wanted = written(pairs.select("source", "goal").distinct())
    first = F.array(F.struct(F.lit(0).alias("step"), F.col("source").alias("node"), F.lit(None).cast("string").alias("edge_id")))
    frontier = reached = written(wanted.select("source", F.col("source").alias("node")).distinct().withColumn("path", first))
    found, step = [], 0
    while True:
        hits = frontier.withColumnRenamed("node", "goal").join(wanted, ["source", "goal"])
        found.append(hits.select("source", "goal", "path"))
        wanted = written(wanted.join(frontier.select("source", F.col("node").alias("goal")), ["source", "goal"], "left_anti"))
        step += 1
        if wanted.isEmpty() or (most is not None and step > most):
            break
        waiting = frontier.join(broadcast_if_small(wanted.select("source").distinct()), "source", "left_semi")
        via = F.struct(F.col("node").alias("parent"), "edge_id", "path")
        new = ways.join(broadcast_if_small(written(waiting)), "node").select("source", F.col("other").alias("node"), via.alias("via")).groupBy("source", "node").agg(F.min("via").alias("via"))
        new = new.join(broadcast_if_small(reached.select("source", "node")), ["source", "node"], "left_anti")
        path = F.concat("via.path", F.array(F.struct(F.lit(step).alias("step"), F.col("node").alias("node"), F.col("via.edge_id").alias("edge_id"))))
        frontier = written(new.select("source", "node", path.alias("path")))
        if frontier.isEmpty():
            break
        reached = reached.select("source", "node").unionByName(frontier.select("source", "node"))
        reached = written(reached) if step % 8 == 0 else reached
    return reduce(DataFrame.unionByName, found).select("source", "goal", F.explode("path").alias("x")).select("source", "goal", "x.step", "x.node", "x.edge_id")


#: Up to so many sources and goals, paths are searched from both ends.
FEW_ENDS = 16


def path_lengths(edges: DataFrame, pairs: DataFrame, most: int | None = None, types: Iterable[str] | None = None, direction: str = "both") -> DataFrame:
    """(source, goal, length): the steps of the shortest paths of each pair that is linked, in at most `most` steps if that is given.

    Searches start from the side with fewer distinct ends, so many sources of one goal are one search. Between a few ends they go
    from both sides in turn and meet: a path of n steps has a node (n + 1) // 2 steps from its source and the rest from its goal.
    """
    wanted = written(pairs.select("source", "goal").distinct())
    n = wanted.agg(F.count_distinct("source").alias("sources"), F.count_distinct("goal").alias("goals")).first()
    turned, both = n["goals"] < n["sources"], max(n) <= FEW_ENDS
    ends, back = ("goal", "source") if turned else ("source", "goal"), {"out": "in", "in": "out", "both": "both"}
    # by side: the ways to follow, what was reached last, all that was reached
    ways = [adjacency(edges, d, types).select("node", "other") for d in ((back[direction], direction) if turned else (direction, back[direction]))]
    level = [written(wanted.select(end, F.col(end).alias("node")).distinct()) for end in ends]
    reached, found, step = list(level), [], 0
    while True:
        met = level[0].join(level[1], "node").select(*ends).distinct() if both else level[0].withColumnRenamed("node", ends[1])
        hits = written(wanted.join(met, [*ends], "left_semi").select("source", "goal"))
        found.append(hits.withColumn("length", F.lit(step)))
        wanted = written(wanted.join(hits, ["source", "goal"], "left_anti"))
        step += 1
        if wanted.isEmpty() or (most is not None and step > most):
            break
        side = 1 if both and step % 2 == 0 else 0
        end = ends[side]
        waiting = written(level[side].join(wanted.select(end).distinct(), end, "left_semi"))
        new = ways[side].join(broadcast_if_small(waiting), "node").select(end, F.col("other").alias("node")).distinct()
        level[side] = written(new.join(broadcast_if_small(reached[side]), [end, "node"], "left_anti").select(end, "node"))
        if level[side].isEmpty():
            break
        reached[side] = reached[side].unionByName(level[side])
        reached[side] = written(reached[side]) if step % 8 == 0 else reached[side]
    return reduce(DataFrame.unionByName, found)


def slice_scores(graph: Graph, nodes: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """(target, node, score): weight of the node's type plus its degree up to a cap; the target itself is above all."""
    weights = weights or TYPE_WEIGHTS
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    kinds, ends = graph.nodes.select("id", "type"), graph.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    if is_small(nodes):
        # ends and types of a few nodes are picked out before anything is shuffled
        few = F.broadcast(nodes.select(F.col("node").alias("id")).distinct())
        kinds, ends = kinds.join(few, "id", "left_semi"), ends.join(few, "id", "left_semi")
    score = F.coalesce(table[F.col("type")], F.lit(OTHER_WEIGHT)) + F.least(F.lit(DEGREE_CAP), F.coalesce("degree", F.lit(0)))
    # a node's score is found once and then meets its targets
    scored = kinds.join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "id", "left").select(F.col("id").alias("node"), score.cast("long").alias("score"))
    typed = nodes.select("target", "node").join(scored, "node")
    return typed.select("target", "node", F.when(F.col("node") == F.col("target"), F.lit(TARGET_SCORE).cast("long")).otherwise(F.col("score")).alias("score"))


def trim(graph: Graph, nodes: DataFrame, most: int, weights: dict[str, int] | None = None) -> DataFrame:
    """(target, node, score) of each target's `most` best nodes; ties by id."""
    order = Window.partitionBy("target").orderBy(F.desc("score"), "node")
    return slice_scores(graph, nodes, weights).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def has_term(text: Column, terms: Iterable[str]) -> Column:
    """Whether the text holds one of the terms, in any case."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in terms], F.lit(False))


def node_text(nodes: DataFrame) -> Column:
    """All of a node as text, for term filters."""
    return F.to_json(F.struct(*nodes.columns))


#: Parts into which the rows of each name are dealt, so that a frequent name is not one task.
PARTS = 16


def of_names(targets: DataFrame, named: DataFrame) -> DataFrame:
    """(target, node), distinct: the nodes (name, node) of each target's names (target, name).

    Nodes are made distinct by name, before they meet the targets. What a target of one name gets is then distinct and goes
    through no exchange, however large; only targets of several names have their rows compared.
    """
    rows = named.where("name IS NOT NULL").select("name", "node").distinct().withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    wanted = targets.select("target", "name").distinct().withColumn("_names", F.count(F.lit(1)).over(Window.partitionBy("target")))
    wanted = wanted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    given = lambda kind: wanted.where(kind).join(rows, ["name", "_part"]).select("target", "node")
    return given("_names = 1").unionByName(given("_names > 1").distinct())


def _facts(graph: Graph, terms: Iterable[str] | None) -> DataFrame:
    """(name, node): the facts of each function name, with the nodes they are about. With terms, a fact needs one of them or a guard term."""
    facts = graph.nodes.where(F.col("type") == "SemanticFact")
    if terms:
        facts = facts.where(has_term(node_text(graph.nodes), (*terms, *GUARD_TERMS)))
    own = facts.select(F.col("id").alias("node"), F.col("function").alias("name")).select("name", "node")
    links = adjacency(graph.edges, "both", SEMANTIC_EDGES)
    about = own.join(links, "node").select("name", F.col("other").alias("node"))
    return own.unionByName(about)


def semantic_facts(graph: Graph, targets: DataFrame, terms: Iterable[str] | None = None) -> DataFrame:
    """(target, node): the facts of each target's function, with the nodes they are about.

    With terms, a fact needs one of them or a guard term. Rows of targets are (target, name).
    """
    others = of_names(targets, _facts(graph, terms)).where(~F.col("target").eqNullSafe(F.col("node")))
    return others.unionByName(targets.select("target", F.col("target").alias("node")).distinct())


def file_context(graph: Graph, files: DataFrame, include_headers: bool = True, include_globals: bool = True) -> DataFrame:
    """(target, node): a file (target, file), its types with fields, macros, headers, globals and project."""
    kinds = ["FILE_HAS_TYPE", "FILE_HAS_MACRO"] + ["FILE_INCLUDES_FILE"] * include_headers + ["FILE_HAS_GLOBAL"] * include_globals
    edges = graph.edges
    own = files.select("target", F.col("file").alias("node"))
    parts = own.join(adjacency(edges, "out", kinds), "node").select("target", F.col("other").alias("node"))
    types = graph.nodes.where(F.col("type").isin("Struct/Class", "Type")).select(F.col("id").alias("node"))
    fields = graph.nodes.where(F.col("type") == "Field").select(F.col("id").alias("other"))
    inner = parts.join(types, "node", "left_semi").join(adjacency(edges, "out", ("TYPE_HAS_FIELD", "AST_CHILD")), "node").join(fields, "other", "left_semi").select("target", F.col("other").alias("node"))
    project = own.join(adjacency(edges, "in", ("PROJECT_HAS_FILE",)), "node").select("target", F.col("other").alias("node"))
    return reduce(DataFrame.unionByName, [own, parts, inner, project]).distinct()


@dataclass
class Bodies:
    """Bodies of functions, without the product of targets and what they share.

    owners: (target, name, file) of the targets of one name and at most one file. by_name: (name, node) and by_file: (file, node), which each target of
    that name, except as its own fact, and each of that file have; no node is in both. rest: (target, node) of all else, which no owner has by its name or file.
    """

    owners: DataFrame
    by_name: DataFrame
    by_file: DataFrame
    rest: DataFrame


def dealt(wanted: DataFrame, rows: DataFrame, by: list[str], on: str) -> DataFrame:
    """Rows of each target by the columns `by`, which go through no exchange afterwards. Those of one key are dealt by `on`, so that a frequent key is not one task."""
    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.withColumn("_part", F.pmod(F.xxhash64(on), F.lit(PARTS)).cast("int"))
    # a number of partitions, as what is joined is small and what comes of it is not
    asked = wanted.select("target", *by).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(n, *by, "_part")
    return asked.join(parts, [*by, "_part"]).drop("_part")


def bodies(graph: Graph, functions: DataFrame, terms: Iterable[str] | None = None, include_globals: bool = True, include_headers: bool = True) -> Bodies:
    """The bodies of functions (target, function id as node, name), as function_body means them. What is written grows with the graph, not with the members of a name or file."""
    edges, nodes = graph.edges, graph.nodes
    own, names = functions.select("target", "node"), functions.select("target", "name").distinct()
    files = own.join(adjacency(edges, "in", ("FILE_HAS_FUNCTION",)), "node").select("target", F.col("other").alias("file")).distinct()
    by_file = written(file_context(graph, files.select("file", F.col("file").alias("target")).distinct(), include_headers, include_globals).select(F.col("target").alias("file"), "node"))
    by_name = written(_facts(graph, terms).join(names.select("name").distinct(), "name", "left_semi").distinct())
    each = names.groupBy("target").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("_n")).join(files.groupBy("target").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("_f")), "target", "left")
    each = written(each.withColumn("_plain", (F.col("_n") == 1) & (F.coalesce("_f", F.lit(0)) <= 1)))
    owners = each.where("_plain").select("target", "name", "file")

    parts = own.join(adjacency(edges, "out", BODY_EDGES), "node").select("target", F.col("other").alias("node")).unionByName(own).distinct()
    # what lies in the target's function: a node names its function, so names are never multiplied with their nodes
    lies = nodes.where("function IS NOT NULL").select(F.col("id").alias("node"), F.col("function").alias("name"))
    inside = parts.join(lies, "node").join(names, ["target", "name"], "left_semi").select("target", "node")
    inside = inside.unionByName(by_file.join(lies, "node").join(files.join(names, "target"), ["file", "name"]).select("target", "node")).distinct()
    step = adjacency(edges, "both", sorted({*CFG_EDGES, *DATA_EDGES, *SEMANTIC_EDGES, "AST_CHILD", "STATEMENT_CALLS"}))
    rest = parts.unionByName(inside.join(step, "node").select("target", F.col("other").alias("node")))

    # nodes of both kinds, and targets of several names or files, have rows that must be compared
    def rows(names: DataFrame, by_name: DataFrame, files: DataFrame, by_file: DataFrame) -> DataFrame:
        facts = names.join(by_name, "name").where(~F.col("target").eqNullSafe(F.col("node")))
        return facts.select("target", "node").unionByName(files.join(by_file, "file").select("target", "node"))

    mixed = written(by_name.join(by_file, "node", "left_semi").select("node").distinct())
    if not mixed.isEmpty():
        rest = rest.unionByName(rows(owners, by_name.join(mixed, "node", "left_semi"), owners, by_file.join(mixed, "node", "left_semi")))
        pure_name, pure_file = (x.join(mixed, "node", "left_anti") for x in (by_name, by_file))
    else:
        pure_name, pure_file = by_name, by_file
    several = each.where("NOT _plain").select("target")
    if not several.isEmpty():
        rest = rest.unionByName(rows(names.join(several, "target", "left_semi"), by_name, files.join(several, "target", "left_semi"), by_file))
    rest = rest.distinct().join(owners, "target", "left")
    own_fact = (rest["name"] == pure_name["name"]) & (rest["node"] == pure_name["node"]) & (rest["target"] != rest["node"])
    rest = rest.join(pure_name, own_fact, "left_anti").join(pure_file, ["file", "node"], "left_anti")
    return Bodies(owners, pure_name.select("name", "node"), pure_file.select("file", "node"), written(rest.select("target", "node")))


def function_body(graph: Graph, functions: DataFrame, terms: Iterable[str] | None = None, include_globals: bool = True, include_headers: bool = True) -> DataFrame:
    """(target, node): what stands in the functions (target, function id as node, name) and what it is about.

    Parts of the function, then one step along control, data and meaning from the parts that lie in it, its facts, and
    the context of its file.
    """
    return _expanded(bodies(graph, functions, terms, include_globals, include_headers))


def _expanded(found: Bodies) -> DataFrame:
    """(target, node) of bodies; what a name or a file gives is distinct as it comes and goes through no exchange."""
    facts = dealt(found.owners, found.by_name, ["name"], "node").where(~F.col("target").eqNullSafe(F.col("node")))
    context = dealt(found.owners, found.by_file, ["file"], "node")
    return found.rest.unionByName(facts.select("target", "node")).unionByName(context.select("target", "node"))


def _edges_within(edges: DataFrame, found: Bodies) -> DataFrame:
    """(target, edge_id, src, dst, type) of edges with both ends in one body, each once.

    Each target has itself, so here by_name gives it as well. Edges between what a name or a file gives are found once for
    all its targets; those with an end in the rest start there and look up the other end by the target's name and file.
    """
    shown = ["edge_id", "src", "dst", "type"]
    rest = found.rest.join(found.owners, "target", "left")
    itself = (rest["name"] == found.by_name["name"]) & (rest["node"] == found.by_name["node"])
    rest = written(rest.join(found.by_name, itself, "left_anti").select("target", "node", "name", "file"))
    groups, out = (("name", found.by_name), ("file", found.by_file)), []
    # (key, edge): edges that end at, and that start at, what a key gives
    ends = {by: {at: edges.join(rows.withColumnRenamed("node", at), at).select(by, *shown) for at in ("src", "dst")} for by, rows in groups}
    for by, rows in groups:
        within = ends[by]["src"].join(rows.withColumnRenamed("node", "dst"), [by, "dst"], "left_semi").select(by, *shown)
        out.append(dealt(found.owners, within, [by], "edge_id"))
        for near, far in (("src", "dst"), ("dst", "src")):
            out.append(rest.withColumnRenamed("node", near).join(ends[by][far], [by, near]))
    for name_end, file_end in (("src", "dst"), ("dst", "src")):
        across = ends["name"][name_end].join(found.by_file.withColumnRenamed("node", file_end), file_end).select("name", "file", *shown)
        out.append(dealt(found.owners, across, ["name", "file"], "edge_id"))
    out.append(induced_edges(edges, rest.select("target", "node")))
    return reduce(DataFrame.unionByName, [x.select("target", *shown) for x in out])


def risk_slice(graph: Graph, targets: DataFrame, terms: Iterable[str] = RISK_TERMS) -> tuple[DataFrame, DataFrame]:
    """Nodes (target, node) of each function's body that bear on the terms, and all edges among them. targets: (target, name)."""
    terms = list(terms) or list(RISK_TERMS)
    found = bodies(graph, targets.select("target", F.col("target").alias("node"), "name"), terms)
    keep = written(graph.nodes.where(F.col("type").isin(*RISK_KEEP_TYPES) & ((F.col("type") != "SemanticFact") | has_term(node_text(graph.nodes), terms))).select(F.col("id").alias("node")))
    kept = Bodies(found.owners, *[written(rows.join(keep, "node", "left_semi").select(*rows.columns)) for rows in (found.by_name, found.by_file, found.rest)])
    return _expanded(kept), _edges_within(graph.edges, kept)


def security_context(graph: Graph, targets: DataFrame, call_depth: int = 2, data_depth: int = 4, include_callers: bool = True, max_nodes: int = 520, terms: Iterable[str] = RISK_TERMS, seed_limit: int = 250) -> tuple[DataFrame, DataFrame]:
    """Nodes (target, node, score) and edges of what is needed to inspect each function (target, name).

    Bodies of the function, of what it calls down to call_depth and of its direct callers, what is called outside,
    then data flow from the first seed_limit variables and statements by id, trimmed to the max_nodes best.
    """
    edges, nodes = graph.edges, graph.nodes
    start = targets.select("target", F.col("target").alias("node"))
    called = neighborhood(edges, start, call_depth, DIRECT_CALLS, "out").select("target", "node")
    calling = callers(edges, targets, ("CALLS",)) if include_callers else called.where("false")
    functions = nodes.where(F.col("type") == "Function")
    if "defined" in nodes.columns:
        functions = functions.where(F.coalesce(F.col("defined"), F.lit(True)))
    everyone = called.unionByName(calling).distinct()
    bodies = everyone.join(functions.select(F.col("id").alias("node"), "name"), "node")
    found = written(function_body(graph, bodies.select("target", "node", "name"), terms).unionByName(everyone).distinct())
    seeds = found.join(nodes.where(F.col("type").isin(*VARIABLE_TYPES, *STATEMENT_TYPES)).select(F.col("id").alias("node")), "node", "left_semi")
    first = Window.partitionBy("target").orderBy("node")
    seeds = seeds.withColumn("place", F.row_number().over(first)).where(F.col("place") <= seed_limit)
    flow = neighborhood(edges, seeds, min(max(data_depth, 1), 6), (*DATA_EDGES, "FUNCTION_HAS_STATEMENT", "CFG_NEXT", "HAS_SEMANTIC_FACT"))
    kept = written(trim(graph, written(found.unionByName(flow.select("target", "node")).distinct()), max_nodes))
    return kept, induced_edges(edges, kept)


def summarize_context(graph: Graph, kept: DataFrame) -> DataFrame:
    """One row for each target: names of functions and variables (100 at most), counts of facts and guards, counts by type."""
    rows = kept.select("target", "node").join(graph.nodes.withColumnRenamed("id", "node").withColumn("text", node_text(graph.nodes.withColumnRenamed("id", "node"))), "node")
    named = lambda kinds: F.array_sort(F.collect_set(F.when(F.col("type").isin(*kinds) & F.col("name").isNotNull(), F.col("name"))))
    fact = F.col("type") == "SemanticFact"
    summary = rows.groupBy("target").agg(
        named(("Function",)).alias("functions"), F.slice(named(VARIABLE_TYPES), 1, 100).alias("variables"),
        F.count_if(fact).alias("facts"), F.count_if(fact & has_term(F.col("text"), GUARD_TERMS)).alias("guards"),
    )
    counts = rows.groupBy("target", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("target").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
    return summary.join(counts, "target")


def overlay(graph: Graph, nodes: DataFrame, limit: int = 160, edge_limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """The best `limit` overlay nodes joined to each target's nodes, and up to edge_limit edges among them.

    Priority adds the weights of keywords found in the overlay node; ties by id.
    """
    # fixed values: keywords and their weights
    weights = (("method", 8), ("function", 8), ("call", 7), ("identifier", 6), ("local", 6), ("control", 5), ("return", 5), ("assignment", 4), ("operator", 4), ("literal", 1))
    text = F.lower(node_text(graph.nodes))
    priority = sum((F.when(F.contains(text, F.lit(t)), w).otherwise(0) for t, w in weights), F.lit(0))
    inner = graph.nodes.where(F.col("type") == "JoernCPGNode").select(F.col("id").alias("other"), priority.alias("priority"))
    found = nodes.join(adjacency(graph.edges, "both", ("JOERN_OVERLAY",)), "node").join(inner, "other").select("target", F.col("other").alias("node"), "priority").distinct()
    best = Window.partitionBy("target").orderBy(F.desc("priority"), "node")
    kept = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).drop("place")
    among = induced_edges(graph.edges, kept).where(F.col("type").startswith("JOERN_") & (F.col("type") != "JOERN_OVERLAY"))
    among = among.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("edge_id"))).where(F.col("place") <= edge_limit).drop("place")
    return kept, among


def quality(graph: Graph) -> DataFrame:
    """One row: unresolved calls, statements of at most one edge, names defined twice, calls of oneself, comment facts."""
    nodes, edges = graph.nodes, graph.edges
    ends = degree(edges)
    statements = nodes.where(F.col("type").isin(*STATEMENT_TYPES)).join(ends, "id", "left").agg(F.count_if(F.coalesce("degree", F.lit(0)) <= 1).alias("orphan_statements"))
    functions = nodes.where(F.col("type") == "Function")
    defined = F.coalesce(F.col("defined"), F.lit(True)) if "defined" in nodes.columns else F.lit(True)
    unresolved = functions.agg(F.count_if(~defined).alias("unresolved_calls"))
    twice = functions.where(defined).groupBy("name").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_names"))
    selves = edges.agg(F.count_if((F.col("type") == "CALLS") & (F.col("src") == F.col("dst"))).alias("self_calls"))
    comments = nodes.agg(F.count_if(F.col("type") == "Comment").alias("comments"))
    return reduce(lambda a, b: a.crossJoin(b), [unresolved, statements, twice, selves, comments])


def legacy_alias_edges(graph: Graph) -> DataFrame:
    """Edges of the older vocabulary besides the new ones: calls between functions under their old names."""
    functions = graph.nodes.where(F.col("type") == "Function").select("id")
    calls = graph.edges.where(F.col("type") == "CALLS")
    calls = calls.join(functions, calls["src"] == functions["id"], "left_semi")
    calls = calls.join(functions, calls["dst"] == functions["id"], "left_semi")
    alias = calls.select("src", "dst", F.lit("FUNCTION_CALLS").alias("type"))
    return graph.edges.select("src", "dst", "type").unionByName(alias).distinct()


def star_graph(tables: dict[str, DataFrame]) -> Graph:
    """A typed graph over the star schema: regions, nations, customers, suppliers, orders and parts."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    kinds = (("region", "r_regionkey", "r_name", "R", "Region"), ("nation", "n_nationkey", "n_name", "N", "Nation"), ("customer", "c_custkey", "c_name", "C", "Customer"), ("supplier", "s_suppkey", "s_name", "S", "Supplier"), ("orders", "o_orderkey", "o_orderstatus", "O", "Order"), ("part", "p_partkey", "p_name", "P", "Part"))
    # ids of two kinds differ by their prefix, so each kind is made distinct alone, and a query for one reads only that one
    nodes = [_one_each(tables[t].select(name(p, key).alias("id"), F.col(label).alias("name"))).select("id", F.lit(kind).alias("type"), "name") for t, key, label, p, kind in kinds]
    links = (
        ("nation", "R", "n_regionkey", "N", "n_nationkey", "HAS_NATION"), ("customer", "N", "c_nationkey", "C", "c_custkey", "HAS_CUSTOMER"),
        ("supplier", "N", "s_nationkey", "S", "s_suppkey", "HAS_SUPPLIER"), ("orders", "C", "o_custkey", "O", "o_orderkey", "PLACED"),
        ("lineitem", "O", "l_orderkey", "P", "l_partkey", "CONTAINS"), ("lineitem", "S", "l_suppkey", "P", "l_partkey", "SUPPLIES"),
    )
    keys = {p: tables[t].select(F.col(key).alias("_end")).distinct() for t, key, _, p, _ in kinds}
    edges = []
    # the keys behind a prefix name one kind of node, so edges are held against them before they are text
    for t, a, x, b, y, kind in links:
        rows = tables[t].select(F.col(x).alias("_src"), F.col(y).alias("_dst"))
        # by dst, then by src: the distinct rows after that are already together
        rows = rows.join(keys[b], F.col("_dst") == F.col("_end"), "left_semi").join(keys[a], F.col("_src") == F.col("_end"), "left_semi").distinct()
        edges.append(rows.select(name(a, "_src").alias("src"), name(b, "_dst").alias("dst"), F.lit(kind).alias("type")))
    edges = reduce(DataFrame.unionByName, edges)
    return Graph(reduce(DataFrame.unionByName, nodes), edges.select(edge_id(F.col("src"), F.col("type"), F.col("dst")).alias("edge_id"), "src", "dst", "type"))
