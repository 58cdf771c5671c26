"""Ranking and quotas: scored evidence, dedupe, per-role limits, category budgets, definition choice, table pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many items of each role are shown.
ROLE_LIMITS = {
    "target_risky_operation_or_guard": 10, "target_context": 4, "caller_context": 8, "callee_context": 8, "related_function_context": 8,
    "definition_or_constant": 8, "deterministic_source_fact": 12, "semantic_fact": 8,
}
OTHER_LIMIT = 6


def evidence_score(weight: Column, text: Column, terms: list[str], per_term: int = 35, with_code: int = 15) -> Column:
    """Weight, plus points for each term in the text, plus points if there is code at all."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(t.lower())), per_term).otherwise(0) for t in terms], F.lit(0))
    return weight + hits + F.when(low != "", with_code).otherwise(0)


#: Terms and marks that make an item of evidence relevant, and kinds that are noise.
SECURITY_TERMS = (
    "memcpy", "memmove", "strcpy", "strncpy", "strcat", "sprintf", "snprintf", "scanf", "gets", "read", "fread", "recv", "send", "write", "fwrite", "malloc", "calloc",
    "realloc", "free", "new", "delete", "open", "fopen", "exec", "system", "popen", "chown", "chmod", "overflow", "underflow", "bounds", "guard", "check", "length", "size",
    "count", "offset", "index", "pointer", "null", "buffer", "array", "auth", "permission", "access", "crypto", "hash", "random", "nonce",
)
OPERATOR_HINTS = ("[", "]", "->", ".", "+=", "-=", "*=", "<<", ">>", "^", "&", "|", "*", "malloc", "free", "fread", "mem", "str", "sprintf")


def prompt_score(kind: Column, relation: Column, function: Column, target: Column, text: Column, has_symbol: Column, whole_function: Column, noise: Column) -> Column:
    """How much an item of evidence says about the target: -100 for noise, else points for what it is and what its text shows.

    has_symbol says whether it names a symbol of the hypotheses, whole_function whether its function is shown as a whole.
    """
    kind, relation, function, text = (F.coalesce(c, F.lit("")) for c in (kind, relation, function, text))
    any_of = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    points = lambda holds, n: F.when(holds, n).otherwise(0)
    hint = any_of(text, OPERATOR_HINTS)
    score = (
        points(kind == "deterministic_source_fact", 90) + points(function == target, 70) + points(kind == "target_statement", 45)
        + points(F.contains(relation, F.lit("caller")) | (kind == "caller_function"), 55) + points(F.contains(relation, F.lit("callee")) | (kind == "callee_function"), 45)
        + points(kind == "codekg_function", 40) + points(any_of(F.lower(text), SECURITY_TERMS), 30) + points(hint, 25) + points(has_symbol, 35)
        - points((kind == "target_statement") & whole_function & ~hint & ~any_of(text, ("if", "for", "while")), 70)
    )
    return F.when(noise, -100).otherwise(score)


def dedupe_key(kind: Column, function: Column, text: Column) -> Column:
    """What copies of an item of evidence share: its kind, its function and its whole text, without regard to case and white space. Nulls count as empty."""
    kind, function, text = (F.coalesce(c, F.lit("")) for c in (kind, function, text))
    return F.md5(F.concat_ws("|", kind, function, F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))))


def curate(rows: DataFrame, by: list[str], least: int = 20, limits: dict[str, int] | None = None, other: int = OTHER_LIMIT, most: int = 36, id_: str = "evidence_id") -> DataFrame:
    """Rows (score, key, role, id) of each group: scores of at least `least`, one row for each key, a quota for each role, `most` in all.

    Order is by score, then id, at every step; a dropped duplicate uses up no quota.
    """
    limits = ROLE_LIMITS if limits is None else limits
    order = [F.desc("score"), F.asc(id_)]
    rows = rows.where(F.col("score") >= least)
    place = lambda *extra: F.row_number().over(Window.partitionBy(*by, *extra).orderBy(*order))
    rows = rows.withColumn("_copy", place("key")).where("_copy = 1")
    table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else None
    quota = F.coalesce(table[F.col("role")], F.lit(other)) if limits else F.lit(other)
    rows = rows.withColumn("_in_role", place("role")).where(F.col("_in_role") <= quota)
    return rows.withColumn("place", place()).where(F.col("place") <= most).drop("_copy", "_in_role")


def omitted(rows: DataFrame, kept: DataFrame, by: list[str], least: int = 20, id_: str = "evidence_id") -> DataFrame:
    """(by, reason, n): why rows were left out: empty_text, low_relevance, or duplicate_or_limit."""
    left = rows.join(kept.select(*by, id_), [*by, id_], "left_anti")
    reason = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_text").when(F.col("score") < least, "low_relevance").otherwise("duplicate_or_limit")
    return left.groupBy(*by, reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def category_budget(rows: DataFrame, by: list[str], budgets: dict[str, int], other: int, most: int, requested: list[str], id_: str) -> DataFrame:
    """The best rows of each category up to its budget, requested categories first in their order, `most` in all."""
    table = F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair])
    inside = Window.partitionBy(*by, "category").orderBy(F.desc("score"), id_)
    rows = rows.withColumn("_place", F.row_number().over(inside)).where(F.col("_place") <= F.coalesce(table[F.col("category")], F.lit(other)))
    wanted = F.coalesce(*[F.when(F.col("category") == c, F.lit(i)) for i, c in enumerate(requested)], F.lit(len(requested)))
    overall = Window.partitionBy(*by).orderBy(wanted, F.desc("score"), id_)
    return rows.withColumn("place", F.row_number().over(overall)).where(F.col("place") <= most).drop("_place")


def best_definition(rows: DataFrame, by: list[str], flags: list[Column], id_: str) -> DataFrame:
    """The row of each group that is best by flags in order (true first, or small first for numbers), then id."""
    keys = [F.desc(f) if isinstance(f, str) else f for f in flags]
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*keys, id_))).where("_place = 1").drop("_place")


def boosted(rows: DataFrame, boosts: DataFrame, by: list[str], most: int, id_: str = "evidence_id") -> DataFrame:
    """For each obligation, the `most` best rows by base score plus the boost of (obligation, kind); one row for each key."""
    joined = rows.join(boosts, "kind").withColumn("total", F.col("score") + F.col("boost"))
    order = [F.desc("total"), F.asc("role"), F.asc(id_)]
    joined = joined.withColumn("_copy", F.row_number().over(Window.partitionBy(*by, "obligation", "key").orderBy(*order))).where("_copy = 1")
    return joined.withColumn("place", F.row_number().over(Window.partitionBy(*by, "obligation").orderBy(*order))).where(F.col("place") <= most).drop("_copy")


def table_page(rows: DataFrame, search: str | None, sort: str, descending: bool, offset: int, limit: int, tie: str) -> DataFrame:
    """One page of a table: rows that hold the search text in any column, sorted with nulls last."""
    if search:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns])), F.lit(search.lower())))
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return rows.orderBy(order, tie).offset(offset).limit(limit)


def stable_top(rows: DataFrame, by: list[str], score: list[Column], id_: str, value: list[str]) -> DataFrame:
    """The best row of each group by score columns in order, the first id of equal ones; without a window."""
    best = F.min_by(F.struct(*value), F.struct(*[(-s).alias(f"s{i}") for i, s in enumerate(score)], F.col(id_)))
    return rows.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def staged_pack(stages: list[DataFrame], by: list[str], id_: str, most: int) -> DataFrame:
    """Rows of several stages in order, each id at its first stage, `most` in all."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)])
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy(*by, id_).orderBy("stage"))).where("_copy = 1").drop("_copy")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("stage", id_))).where(F.col("place") <= most)


def categorize(rows: DataFrame, text: str, categories: list[tuple[str, str, int]], by: list[str], id_: str) -> DataFrame:
    """(row, category) for each category whose pattern the text shows, up to each category's limit by id."""
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.struct(F.lit(c).alias("category"), F.lit(n).alias("most"))) for c, p, n in categories]))
    tagged = rows.withColumn("_c", F.explode(found)).select(*rows.columns, "_c.*")
    place = F.row_number().over(Window.partitionBy(*by, "category").orderBy(id_))
    return tagged.withColumn("_place", place).where(F.col("_place") <= F.col("most")).drop("_place", "most")
