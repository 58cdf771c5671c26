"""The text front end of graph queries: calls, key=value text, contracts, checks and dispatch."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators import graph as g

#: What each kind of query takes, and how far a number may go.
PARAMETERS = {
    "function_context": {"target_function", "depth"}, "call_neighborhood": {"target_function", "direction", "depth"}, "semantic_facts": {"target_function", "risk_terms"},
    "variable_flow": {"target_function", "symbol", "depth"}, "risk_slice": {"target_function", "risk_terms"}, "file_context": {"file", "depth"},
    "callers": {"target_function"}, "callees": {"target_function"}, "shortest_path": {"source_node", "target_node"},
    "security_context": {"target_function", "depth", "call_depth", "data_depth", "include_callers", "include_headers", "include_globals", "max_nodes", "risk_terms"},
}
ALIASES = {"vulnerability_context": "security_context", "evidence_slice": "security_context"}
REQUIRED = {"file_context": ("file",), "shortest_path": ("source_node", "target_node"), "variable_flow": ("target_function", "symbol")}
LIMITS = {"depth": (1, 6), "call_depth": (0, 5), "data_depth": (1, 6), "max_nodes": (1, 1200)}
DEFAULT_DEPTH = {"function_context": 2, "call_neighborhood": 2, "variable_flow": 3, "file_context": 2}
_SQL = re.compile(r"^\s*(select|with|insert|update|delete|drop|create|match)\b.*\b(from|into|table|where|return|set|as)\b", re.I | re.S)
_PLACEHOLDER = re.compile(r"^\s*(?:<[^>]*>|\.\.\.|todo|n/?a|none|null|placeholder)\s*$", re.I)
_FILLER = {"show", "retrieve", "context", "vulnerability", "security", "for", "function", "target", "with", "called", "calls"}


@dataclass
class Query:
    """A query to run, or why it cannot be."""

    kind: str
    args: dict[str, Any] = field(default_factory=dict)
    status: str = "ok"
    error: str | None = None


def _value(text: str) -> Any:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1].replace("\\" + text[0], text[0])
    if text.startswith("[") and text.endswith("]"):
        return [_value(p) for p in split_arguments(text[1:-1])]
    low = text.lower()
    if low in ("true", "false", "none", "null"):
        return {"true": True, "false": False}.get(low)
    return int(text) if re.fullmatch(r"-?\d+", text) else text


def split_arguments(text: str) -> list[str]:
    """Parts between commas that stand outside quotes and brackets."""
    parts, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth <= 0:
            parts.append(text[start:i])
            start = i + 1
        i += 1
    return [p for p in [*parts, text[start:]] if p.strip()]


def parse(text: str | None) -> Query:
    """A query from text: a call kind(a, k=v), key=value pairs, or words of which the first that is no filler names the function."""
    raw = (text or "").strip()
    if not raw:
        return Query("security_context")
    if m := re.fullmatch(r"([A-Za-z_]\w*)\s*\((.*)\)", raw, re.S):
        args: dict[str, Any] = {}
        for part in split_arguments(m[2]):
            key, equals, value = part.partition("=")
            if equals and re.fullmatch(r"[\s-]*[A-Za-z_]\w*\s*", key):
                args[key.strip(" -\t\n")] = _value(value)
            else:
                args.setdefault("target_function", _value(part))
        return Query(m[1], args)
    args = {k.replace("-", "_"): _value(v) for k, v in re.findall(r"([A-Za-z_][\w-]*)\s*=\s*([\w./\\:-]+)", raw)}
    kind = str(args.pop("kind", "security_context"))
    if "function" in args:
        args.setdefault("target_function", args.pop("function"))
    if not {"target_function", "target"} & set(args) and (word := next((w for w in re.findall(r"[A-Za-z_]\w*", raw) if w not in _FILLER), None)):
        args["target_function"] = word
    return Query(kind, args)


def parse_contract(contract: str | dict[str, Any]) -> Query:
    """A query from an object, or its JSON text, with kind or query_type and the arguments beside it or under args."""
    if isinstance(contract, str):
        try:
            contract = json.loads(contract)
        except ValueError:
            return parse(contract)
    if not isinstance(contract, dict):
        return Query("", status="invalid_query", error="a query is text or an object")
    args = {**{k: v for k, v in contract.items() if k not in ("kind", "query_type", "args")}, **(contract.get("args") or {})}
    return Query(str(contract.get("kind") or contract.get("query_type") or "security_context"), {k: v for k, v in args.items() if v not in (None, "", [])})


def check(query: Query, text: str | None = None) -> Query:
    """The query with aliases resolved, unknown arguments dropped and numbers clamped, or with status invalid_query."""
    if text is not None and (not text.strip() or _PLACEHOLDER.match(text)):
        return Query(query.kind, query.args, "invalid_query", "empty or placeholder query")
    if text is not None and _SQL.match(text):
        return Query(query.kind, query.args, "invalid_query", "SQL is not a graph query")
    kind = ALIASES.get(query.kind.strip().lower(), query.kind.strip().lower())
    if kind not in PARAMETERS:
        return Query(kind, query.args, "invalid_query", f"unsupported query kind: {kind}")
    args = dict(query.args)
    if "target" in args:
        args.setdefault("target_function", args.pop("target"))
    args = {k: v for k, v in args.items() if k in PARAMETERS[kind]}
    for name, (low, high) in LIMITS.items():
        if name in args:
            try:
                number = int(args[name])
            except (TypeError, ValueError):
                return Query(kind, args, "invalid_query", f"{name} must be a number")
            # 0 stands for the default, as a missing number does
            args[name] = min(max(number, low), high) if number else DEFAULT_DEPTH.get(kind, 2)
    if args.get("direction", "both") not in ("in", "out", "both"):
        return Query(kind, args, "invalid_query", "direction must be in, out or both")
    if isinstance(args.get("risk_terms"), str):
        args["risk_terms"] = [t.strip() for t in args["risk_terms"].split(",") if t.strip()]
    missing = [r for r in REQUIRED.get(kind, ("target_function",)) if not args.get(r)]
    return Query(kind, args, "invalid_query", f"missing {', '.join(missing)}") if missing else Query(kind, args)


def run(spark: SparkSession, graph: g.Graph, query: Query) -> tuple[Query, DataFrame | None, DataFrame | None]:
    """(query with its status, nodes (target, node), edges); no_results if a name is not in the graph."""
    if query.status != "ok":
        return query, None, None
    kind, args, edges = query.kind, query.args, graph.edges
    depth = int(args.get("depth") or DEFAULT_DEPTH.get(kind, 2))
    if kind == "shortest_path":
        pairs = spark.createDataFrame([(args["source_node"], args["target_node"])], "source string, goal string")
        path = g.shortest_paths(edges, pairs)
        nodes = path.select(F.col("goal").alias("target"), "node")
        return _done(query, nodes, path.where("edge_id IS NOT NULL").select("edge_id"))
    if kind == "file_context":
        targets = g.find_files(graph.nodes, spark.createDataFrame([(args["file"],)], "path string")).select("target")
    else:
        targets = g.find_functions(graph.nodes, spark.createDataFrame([(args["target_function"],)], "name string")).select("target", "name")
    if targets.isEmpty():
        return Query(kind, args, "no_results", "target not found"), None, None
    seeds = targets.select("target", F.col("target").alias("node"))
    if kind in ("function_context", "file_context"):
        nodes = g.neighborhood(edges, seeds, depth, nodes=graph.nodes)
        return _done(query, nodes.select("target", "node"), g.neighborhood_edges(edges, nodes, depth).select("edge_id"))
    if kind == "call_neighborhood":
        way = args.get("direction", "both")
        nodes = g.neighborhood(edges, seeds, depth, g.CALL_EDGES, way, graph.nodes)
        return _done(query, nodes.select("target", "node"), g.neighborhood_edges(edges, nodes, depth, g.CALL_EDGES, way).select("edge_id"))
    if kind in ("callers", "callees"):
        nodes = getattr(g, kind)(edges, targets).unionByName(seeds)
    elif kind == "semantic_facts":
        nodes = g.semantic_facts(graph, targets)
    elif kind == "variable_flow":
        nodes = g.variable_flow(graph, targets.select("target", F.col("name").alias("function"), F.lit(args["symbol"]).alias("symbol")), depth).select("target", "node")
    elif kind == "risk_slice":
        return _done(query, *g.risk_slice(graph, targets, args.get("risk_terms") or g.RISK_TERMS))
    else:
        options = {k: args[k] for k in ("call_depth", "data_depth", "include_callers", "max_nodes") if k in args}
        return _done(query, *g.security_context(graph, targets, terms=args.get("risk_terms") or g.RISK_TERMS, **options))
    return _done(query, nodes, g.induced_edges(edges, nodes).select("edge_id"))


def _done(query: Query, nodes: DataFrame, edges: DataFrame) -> tuple[Query, DataFrame, DataFrame]:
    if nodes.isEmpty():
        query = Query(query.kind, query.args, "no_results", "nothing found")
    return query, nodes, edges


def execute(spark: SparkSession, graph: g.Graph, text: str, seen: set[str] | None = None) -> tuple[Query, DataFrame | None, DataFrame | None]:
    """Parse, check and run a query; one that is in `seen`, by its kind and arguments, is a duplicate."""
    query = check(parse_contract(text) if text.strip().startswith("{") else parse(text), text)
    key = json.dumps([query.kind, query.args], sort_keys=True, default=str)
    if seen is not None:
        if query.status == "ok" and key in seen:
            return Query(query.kind, query.args, "duplicate", "asked before"), None, None
        seen.add(key)
    return run(spark, graph, query)


def execute_batch(spark: SparkSession, graph: g.Graph, texts: list[str], budget: int = 8) -> list[Query]:
    """The status of each query of a batch; queries beyond the budget are not run."""
    seen: set[str] = set()
    out = []
    for i, text in enumerate(texts):
        out.append(execute(spark, graph, text, seen)[0] if i < budget else Query("", {}, "over_budget", f"more than {budget} queries"))
    return out
