"""What the items of an evidence pack show, with the items that show it, and claims that what is shown were missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Facts and the pattern that shows each; several facts may share one.
PACK_FACTS = (
    ("linesize_definition", r"#\s*define\s+LINESIZE\b"),
    ("buf_allocation", r"\bbuf\s*=\s*myalloc\s*\(\s*LINESIZE\s*\)"),
    ("contentlen_declaration", r"\b(?:int|unsigned)\s+contentlen\s*=\s*0\b"),
    ("signed_contentlen_declaration", r"\bint\s+contentlen\s*=\s*0\b"),
    ("unsigned_contentlen_declaration", r"\bunsigned\s+contentlen\s*=\s*0\b"),
    ("signed_l_declaration", r"\bint\s+l\s*=\s*0\b"),
    ("unsigned_l_declaration", r"\bunsigned\s+l\s*=\s*0\b"),
    ("contentlen_cap", r"(?i)\bif\s*\([^\n;]*contentlen[^\n;]*(?:linesize\s*\*|<=|>=|<|>)[^\n;]*\)"),
    ("upload_read_bound", r"(?i)sockgetlinebuf\s*\([^;]*(contentlen\s*-\s*l).*LINESIZE\s*-\s*1"),
    ("upload_unsafe_read_loop", r"(?i)while\s*\(\s*\(\s*i\s*=\s*sockgetlinebuf\s*\([^;]*LINESIZE\s*-\s*1"),
    ("post_read_adjustment", r"(?i)if\s*\(\s*i\s*>\s*\(?\s*contentlen\s*-\s*l\s*\)?\s*\)\s*i\s*=\s*\(?\s*contentlen\s*-\s*l\s*\)?"),
    ("contentlen_parse", r"(?i)\b(contentlen\s*=\s*atoi|sscanf\s*\([^;]*contentlen)"),
    ("decode_or_transform", r"(?i)\bdecodeurl\s*\("),
    ("file_or_output_write", r"(?i)\bfprintf\s*\([^;]*writable"),
    ("nul_write", r"\bbuf\s*\[\s*i\s*\]\s*=\s*0\b"),
)
#: How a text says that something is missing, and of which facts it is checked, by what it calls them.
MISSING = r"\b(missing|unknown|not provided|not available|absent|cannot determine|unconfirmed|not confirmed|critical facts are missing)\b"
CHECKED = (
    ("linesize_definition", r"linesize", "LINESIZE value/definition"),
    ("buf_allocation", r"\b(buf|buffer|allocation|destination size|allocated)\b", "buf allocation/destination size"),
    ("contentlen_cap", r"\b(contentlen|content-length|cap|range)\b", "contentlen cap/range guard"),
    ("upload_read_bound", r"\b(read size|read bound|sockgetlinebuf|remaining|contentlen\s*-\s*l|min\(|bounded)\b", "upload read bound"),
)


def pack_facts(items: DataFrame, by: list[str], text: str, order: str, ids: int = 4) -> DataFrame:
    """(by, fact, n, ids): the facts that the items of each pack show, how many items show it and the first `ids` of them by `order`, which names an item.

    All patterns are tried on an item in one pass over the table; a null text shows nothing.
    """
    shown = F.array_compact(F.array(*[F.when(F.col(text).rlike(pattern), F.lit(fact)) for fact, pattern in PACK_FACTS]))
    rows = items.select(*by, F.col(order).alias("_id"), F.explode(shown).alias("fact"))
    window = Window.partitionBy(*by, "fact").orderBy("_id")
    first = rows.withColumn("_place", F.row_number().over(window)).groupBy(*by, "fact")
    return first.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_place") <= ids, F.col("_id")))).alias("ids"))


def claims_missing(text: Column, term: str) -> Column:
    """Whether a text says that what `term` finds is missing: in one clause, or within 160 characters of one sentence in either order."""
    low = F.lower(text)
    near = low.rlike(f"(?i){term}[^\\n.]{{0,160}}{MISSING}") | low.rlike(f"(?i){MISSING}[^\\n.]{{0,160}}{term}")
    return near | F.exists(F.split(low, r"[\n.;]"), lambda w: w.rlike(MISSING) & w.rlike(term))


def contradicted_claims(conclusions: DataFrame, facts: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, fact, label, ids): what a pack's conclusion says is missing although items of the pack, `ids`, show it. Facts are those of pack_facts; a pack may have several conclusions and each counts."""
    said = F.array(*[F.when(F.coalesce(claims_missing(F.col(text), term), F.lit(False)), F.struct(F.lit(fact).alias("fact"), F.lit(label).alias("label"))) for fact, term, label in CHECKED])
    claims = conclusions.select(*by, F.explode(F.array_compact(said)).alias("c")).select(*by, "c.*")
    checked = facts.where(reduce(lambda a, b: a | b, [F.col("fact") == fact for fact, _, _ in CHECKED]))
    return claims.distinct().join(checked, [*by, "fact"]).select(*by, "fact", "label", "ids")
