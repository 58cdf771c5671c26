"""Repository inventories, candidate lists, registries and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.operators.select import blank_to_null, group_key
from arborlake.operators.windows import global_rank

MISSING_SAMPLES = 10**12


def unique_projects(samples: DataFrame) -> DataFrame:
    """(project_key, project, samples, functions, commits) of each project to inventory, by url where there is one."""
    return samples.groupBy(group_key(F.col("project_url"), F.col("project")).alias("project_key")).agg(
        F.min("project").alias("project"), F.count(F.lit(1)).alias("samples"), F.countDistinct("func_name").alias("functions"), F.countDistinct(blank_to_null(F.col("commit_id"))).alias("commits")
    )


def candidate_stats(samples: DataFrame, size: str = "size") -> DataFrame:
    """(project, samples, vulnerable, files, functions, total_size, avg_size, largest) of each project."""
    return samples.groupBy("project").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("is_vulnerable").alias("vulnerable"), F.countDistinct("filepath").alias("files"), F.countDistinct("func_name").alias("functions"),
        F.sum(size).alias("total_size"), F.avg(size).alias("avg_size"), F.max(size).alias("largest"),
    )


def registry_rollup(registry: DataFrame, splits: list[str]) -> DataFrame:
    """(project, entries, labels, one count for each split)."""
    return registry.groupBy("project").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("label").alias("labels"), *[F.count_if(F.col("split") == s).alias(s) for s in splits])


def scan_order(pairs: DataFrame, samples: str = "samples", url: str = "project_url", ties: tuple[str, ...] = ("project", "idx")) -> DataFrame:
    """pairs with `place`: few samples first, unknown numbers last, hosted repositories before others, then ties."""
    hosted = F.when(F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lit("github.com")), 0).otherwise(1)
    return global_rank(pairs, [F.coalesce(samples, F.lit(MISSING_SAMPLES)), hosted, *ties])


def candidate_order(usable: Column, score: Column, *rest: Column) -> list[Column]:
    """Order of candidates: usable ones first, unknown after, unusable last; then small scores, unknown last; then the rest."""
    penalty = F.when(usable.isNull(), 1).when(usable, 0).otherwise(2)
    return [penalty.asc(), score.asc_nulls_last(), *[r.asc_nulls_last() for r in rest]]


def load_candidates(pairs: DataFrame, excluded: Column, order: list[Column], limit: int) -> DataFrame:
    """(sample_id, place): the first `limit` pairs that are not excluded, flattened to distinct samples in pair order, vulnerable before fixed.

    Pairs that are equal in all of order follow their ids, so reruns agree.
    """
    order = [*order, F.asc_nulls_last("vulnerable_id"), F.asc_nulls_last("fixed_id")]
    chosen = pairs.where(~F.coalesce(excluded, F.lit(False))).orderBy(*order).limit(limit)
    ranked = chosen.withColumn("_pair", F.row_number().over(Window.orderBy(*order)))
    flat = ranked.select("_pair", F.posexplode(F.array("vulnerable_id", "fixed_id")).alias("_side", "sample_id"))
    first = flat.groupBy("sample_id").agg(F.min(F.struct("_pair", "_side")).alias("at"))
    return first.select("sample_id", F.row_number().over(Window.orderBy("at")).alias("place"))


def inventory_summary(inventory: DataFrame, most: int = 50) -> DataFrame:
    """One row: how many repositories are usable, failed and of unknown state, and up to `most` failed ones by name."""
    failed = F.col("repo_usable").eqNullSafe(False)
    return inventory.agg(
        F.count(F.lit(1)).alias("repos"), F.count_if("repo_usable").alias("usable"), F.count_if(failed).alias("failed"), F.count_if(F.col("repo_usable").isNull()).alias("unknown"),
        F.slice(F.array_sort(F.collect_set(F.when(failed, F.col("repo_key")))), 1, most).alias("failures"),
    )


def compact_result(nodes: DataFrame, edges: DataFrame, most_snippets: int = 25, most_nodes: int = 300, most_edges: int = 600) -> DataFrame:
    """(target, nodes, edges, snippets): ids by name up to limits, and the first code texts; nodes: (target, node, code), edges: (target, edge_id)."""
    place = lambda c: F.row_number().over(Window.partitionBy("target").orderBy(c))
    n = nodes.withColumn("_p", place("node")).where(F.col("_p") <= most_nodes)
    coded = nodes.where("code IS NOT NULL AND code <> ''").withColumn("_p", place("node")).where(F.col("_p") <= most_snippets)
    e = edges.withColumn("_p", place("edge_id")).where(F.col("_p") <= most_edges)
    listed = lambda df, c, name: df.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.col(c).alias("v")))), lambda x: x["v"]).alias(name))
    return listed(n, "node", "nodes").join(listed(e, "edge_id", "edges"), "target", "left").join(listed(coded, "code", "snippets"), "target", "left")


def visual_subset(nodes: DataFrame, first_types: list[str], most: int) -> DataFrame:
    """Up to `most` nodes: those of the listed types in that order, then others by id."""
    priority = F.coalesce(*[F.when(F.col("type") == t, F.lit(i)) for i, t in enumerate(first_types)], F.lit(len(first_types)))
    return nodes.withColumn("_priority", priority).orderBy("_priority", "id").limit(most).drop("_priority")


def list_samples(samples: DataFrame, predictions: DataFrame, role: str) -> DataFrame:
    """samples with what may be shown: a prediction only where it is available, its truth only to an admin; skipped overrides the rest."""
    rows = samples.join(predictions.select("sample_id", "status", "prediction"), "sample_id", "left")
    state = F.when(F.col("skipped"), "skipped").when(F.col("status").isNull(), "pending").otherwise(F.col("status"))
    shown = F.when(F.col("skipped") | F.col("status").isNull() | (F.col("status") != "completed"), None).otherwise(F.col("prediction"))
    out = rows.select("sample_id", state.alias("state"), shown.alias("prediction"), F.col("truth") if role == "admin" else F.lit(None).cast(samples.schema["truth"].dataType).alias("truth"))
    return out


#: Families of proof and the patterns that show them in a hypothesis, in order of precedence.
PROOF_FAMILIES = (
    ("parser_scaled_pointer_traversal", r"raw\s*\+=\s*length\s*\*\s*itemsize|length\s*\*\s*itemsize|scaled.*pointer|pointer.*travers|pointer.*advance|parser.*pointer"),
    ("selector_shift_domain_or_dispatch_bounds", r"1\s*<<\s*length_power|length_power|shift|selector|dispatch|function pointer|choose_int_read|choose_"),
    ("callee_return_signedness_or_value_range", r"signed|negative|sign[- ]?extend|uint64_t\s+length\s*=\s*read|return value|read\s*\(\s*raw\s*\).*uint64"),
    ("buffer_extent_or_signed_length", r"raw_length|end\s*=|extent|buffer length"),
    ("allocation_lifetime", r"malloc|calloc|realloc|free|lifetime|null"),
    ("path_file_api_misuse", r"path|file|open|stat|sprintf|snprintf|command|system|exec"),
    ("concurrency_lifecycle", r"race|concurr|thread|lock|mutex|atomic|lifecycle"),
    ("crypto_algorithmic", r"crypto|nonce|random|key|hash|encrypt|decrypt"),
)
#: The fallback by source, the words a hypothesis must have for it, and the family of the rest.
SOURCE_FAMILY = (r"raw\s*\+=\s*length\s*\*\s*itemsize", r"overflow|bounds|out-of-bounds|memory", "parser_scaled_pointer_traversal")
OTHER_FAMILY = "generic_memory_or_bounds"
#: Marks of risky operations, and the ends of kinds, in the order in which roles are given.
RISKY_MARKS = ("[", "memcpy", "strcpy", "sprintf", "malloc", "fread", "realloc", "free", "+=", "-=")
NOISY_DECLARATION = r"^(?:const\s+)?(?:unsigned\s+)?(?:long\s+|short\s+|int\s+|char\s+|size_t\s+|uint\d+_t\s+|bool\s+)[A-Za-z_]\w*\s*;$"
NOISY_MARKS = ("{", "}", "}else{", "else {", "else{")
NOISY_KINDS = ("codekg_query_summary", "codekg_functionparameter")


def proof_family(text: Column, source: Column | None = None) -> Column:
    """The first family that a hypothesis speaks of; for one that names none, the parser family if its source shows it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    rules = [F.when(low.rlike(pattern), F.lit(name)) for name, pattern in PROOF_FAMILIES]
    shown, words, name = SOURCE_FAMILY
    by_source = F.when(F.lower(F.coalesce(source, F.lit(""))).rlike(shown) & low.rlike(words), F.lit(name)) if source is not None else F.lit(None).cast("string")
    return F.coalesce(*rules, by_source, F.lit(OTHER_FAMILY))


def evidence_role(kind: Column, relation: Column, function: Column, target: Column, text: Column) -> Column:
    """What an item is to the target, by its kind, its relation and its text."""
    kind, relation, low = (F.coalesce(c, F.lit("")) for c in (kind, relation, F.lower(text)))
    risky = F.exists(F.array(*map(F.lit, RISKY_MARKS)), lambda m: F.contains(low, m))
    own = (kind == "target_statement") | (F.coalesce(function, F.lit("")) == target)
    has = lambda c, word: F.contains(c, F.lit(word))
    return (
        F.when(kind == "deterministic_source_fact", "deterministic_source_fact").when(own & risky, "target_risky_operation_or_guard").when(own, "target_context")
        .when(has(relation, "caller") | (kind == "caller_function"), "caller_context").when(has(relation, "callee") | (kind == "callee_function"), "callee_context")
        .when(has(kind, "global") | has(kind, "macro") | has(kind, "constant"), "definition_or_constant").when(has(kind, "semanticfact"), "semantic_fact")
        .when(has(kind, "function"), "related_function_context").when(has(kind, "assignment") | has(kind, "call") | has(kind, "control"), "statement_context").otherwise("supporting_context")
    )


def noisy(text: Column, kind: Column | None = None) -> Column:
    """Whether an item says nothing by itself: a bare declaration, a brace, or a kind of summary."""
    compact = F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^\s+|\s+$", ""))
    said = compact.rlike(NOISY_DECLARATION) | compact.isin(*NOISY_MARKS)
    return said if kind is None else F.coalesce(kind.isin(*NOISY_KINDS), F.lit(False)) | said


def declared_sizes(rows: DataFrame, code: str = "code", by: list[str] | None = None) -> DataFrame:
    """(by, symbol, size): arrays declared with a number of elements, the first declaration of a symbol."""
    found = rows.select(*(by or []), F.explode(F.arrays_zip(F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_]\w*)\s*\[\s*(\d+)\s*\]"), 1).alias("symbol"), F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_]\w*)\s*\[\s*(\d+)\s*\]"), 2).alias("size"))).alias("x"))
    return found.groupBy(*(by or []), F.col("x.symbol").alias("symbol")).agg(F.max(F.col("x.size").cast("long")).alias("size"))


def bound_findings(rows: DataFrame, sizes: DataFrame, code: str = "code", by: list[str] | None = None) -> DataFrame:
    """rows of bounded reads and prints with `finding`: whether the bound given fits the declared size of the buffer."""
    call = r"\b(fgets|snprintf)\s*\(\s*([A-Za-z_]\w*)\s*,\s*(?:(\d+)|sizeof\s*\(?\s*([A-Za-z_]\w*)\s*\)?)"
    part = lambda i: F.nullif(F.regexp_extract(code, call, i), F.lit(""))
    calls = rows.withColumns({"api": part(1), "symbol": part(2), "bound": part(3).cast("long"), "sized": part(4)}).where("api IS NOT NULL")
    joined = calls.join(sizes, [*(by or []), "symbol"], "left")
    ok = (F.col("sized") == F.col("symbol")) | (F.col("bound") <= F.col("size"))
    return joined.withColumn("finding", F.when(ok, "bound_fits").when(F.col("bound") > F.col("size"), "bound_exceeds_buffer").otherwise("bound_unknown"))
