"""Rule-based text classification: patterns that tag statements with facts, as data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Call names and integer types that the rules look for.
BUFFER_CALLS = (
    "strcpy", "strncpy", "strcat", "strncat", "memcpy", "memmove", "memset", "sprintf", "snprintf", "vsprintf", "vsnprintf", "gets", "fgets",
    "scanf", "sscanf", "fscanf", "read", "write", "recv", "send", "recvfrom", "sendto", "strlcpy", "strlcat", "bcopy",
)
UNBOUNDED_CALLS = ("strcpy", "strcat", "sprintf", "vsprintf", "gets")
ALLOCATION_CALLS = ("malloc", "calloc", "realloc", "free", "alloca", "new", "delete")
INTEGER_TYPES = r"(?:u?int(?:8|16|32|64)_t|size_t|ssize_t|uintptr_t|intptr_t|unsigned\s+int|signed\s+int|unsigned|signed|long|short|int)"
SIZE_WORDS = r"(?i)\b(size|len|length|count|nbytes|capacity|limit|width|height|rows|cols)\b"


def calls(code: Column) -> Column:
    """Names that stand before an opening bracket, in order."""
    return F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_]\w*)\s*\("), 1)


def _any(names: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(names, F.array(*map(F.lit, wanted)))


# fixed values: the patterns, severities and confidences of the rules below
def statement_rules(code: Column, kind: Column, context: Column) -> list[tuple[str, str, str, float, Column]]:
    """(rule, fact type, severity, confidence, whether it holds) for a statement in one line, its kind, and what stands before it."""
    has = lambda pattern: code.rlike(pattern)
    names = calls(code)
    buffer, condition = _any(names, BUFFER_CALLS), (kind == "Condition") | has(r"^\s*(if|while|for)\s*\(")
    loop = (kind == "Loop") | has(r"^\s*(for|while)\s*\(")
    return [
        ("pointer_dereference", "pointer_dereference", "medium", 0.75, F.contains(code, F.lit("->")) | has(r"(^|[=,(;\s])\*\s*[A-Za-z_]\w+")),
        ("pointer_arithmetic", "pointer_arithmetic", "medium", 0.55, has(r"\b[A-Za-z_]\w*\s*(?:\+\+|--|\+\s*\d+|-\s*\d+)") & ~has(r"\b(return|case)\b")),
        ("array_indexing", "array_indexing", "medium", 0.75, has(r"\b[A-Za-z_]\w*\s*\[[^\]]+\]")),
        ("buffer_io_or_copy_call", "buffer_copy_read_write", "medium", 0.75, buffer),
        ("unchecked_buffer_api", "suspicious_unchecked_flow", "high", 0.8, _any(names, UNBOUNDED_CALLS)),
        ("buffer_call_without_obvious_size", "suspicious_unchecked_flow", "medium", 0.6, buffer & ~has(r"(?i)\b(size|len|length|count|sizeof|capacity|limit|max)\b")),
        ("allocation_or_free", "allocation_free", "medium", 0.75, _any(names, ALLOCATION_CALLS)),
        ("size_length_arithmetic", "size_length_count_arithmetic", "medium", 0.75, has(SIZE_WORDS) & has(r"[+\-*/]")),
        ("multiplication_size_computation", "multiplication_used_in_size_computation", "medium", 0.75, has(r"(?i)\b(size|len|length|count|nbytes|capacity|rows|cols)\b") & F.contains(code, F.lit("*"))),
        ("bounds_check", "bounds_check", "info", 0.75, condition & has(r"(<=|>=|<|>)") & has(r"(?i)\b(size|len|length|count|i|idx|index|n|rows|cols)\b")),
        ("null_check", "null_check", "info", 0.75, condition & has(r"(==|!=)\s*(NULL|nullptr|0)\b|!\s*[A-Za-z_]\w+")),
        ("sanitizer_like_guard", "sanitizer_like_guard", "info", 0.55, condition & (has(r"\b(assert|abort|exit)\s*\(") | has(r"\b(return|goto)\b"))),
        ("loop_over_buffer_or_range", "loops_over_buffers", "medium", 0.65, loop & (has(r"(?i)\b(size|len|length|count|rows|cols|i|idx|index|n)\b") | F.contains(code, F.lit("[")))),
        ("integer_cast", "integer_cast", "medium", 0.75, has(rf"\(\s*{INTEGER_TYPES}\s*\)")),
        ("signed_unsigned_conversion", "signed_unsigned_conversion", "medium", 0.6, has(r"\bunsigned\b") & has(r"\bsigned\b|\bint\b")),
        ("error_return", "error_return", "info", 0.65, has(r"^\s*return\b") & has(r"\b(-1|NULL|nullptr|false|0)\b")),
        ("nearby_guard_not_seen", "suspicious_unchecked_flow", "medium", 0.45, buffer & ~F.concat_ws("\n", context, code).rlike(r"\b(if|assert)\b")),
    ]


def tag_statements(rows: DataFrame, code: str = "code", kind: str = "kind", context: str = "context", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row of (keep, rule, fact_type, severity, confidence, evidence) for each rule that a statement meets; blank ones meet none."""
    compact = F.trim(F.regexp_replace(F.trim(F.col(code)), r"\s+", " "))
    rows = rows.select(*keep, F.col(kind).alias("_kind"), F.coalesce(F.col(context), F.lit("")).alias("_context"), compact.alias("_code")).where("_code <> ''")
    made = [
        F.when(holds, F.struct(F.lit(rule).alias("rule"), F.lit(fact).alias("fact_type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))
        for rule, fact, severity, confidence, holds in statement_rules(F.col("_code"), F.coalesce("_kind", F.lit("Statement")), F.col("_context"))
    ]
    tagged = rows.select(*keep, F.substring("_code", 1, 500).alias("evidence"), F.explode(F.array_compact(F.array(*made))).alias("f"))
    return tagged.select(*keep, "f.*", "evidence")


#: Enrichment facts and the patterns that show them.
ENRICHMENT = (
    ("POINTER_ADVANCE", r"\b([A-Za-z_]\w*)\s*(?:\+\+|--|\+=|-=|=\s*\1\s*[+\-])"),
    ("POINTER_DEREFERENCE", r"(?:\*\s*([A-Za-z_]\w*)\b|\b([A-Za-z_]\w*)\s*\[\s*[^\]]+\s*\])"),
    ("SIZE_ARITHMETIC", r"(?i)\b([A-Za-z_]\w*(?:len|size|count|n|num|rows|cols|bytes)[A-Za-z_0-9]*)\b.*?[+\-*/%].*?\b([A-Za-z_]\w*|\d+)\b"),
    ("BOUNDS_CHECK", r"(?i)\b(if|while|assert)\s*\([^\)]*(?:<|<=|>|>=|==|!=)[^\)]*(?:len|size|count|n|num|end|limit|capacity|bounds?|rows?|cols?)[^\)]*\)"),
    ("ALLOCATION_SIZE", r"(?i)\b(malloc|calloc|realloc|new)\s*\("),
    ("RAW_COPY_OR_READ", r"(?i)\b(strcpy|strcat|sprintf|vsprintf|memcpy|memmove|strncpy|snprintf|read|recv|fread)\s*\("),
    ("ERROR_OR_NULL_GUARD", r"(?i)\b(if|assert)\s*\([^\)]*(?:NULL|nullptr|<\s*0|==\s*0|!\s*[A-Za-z_]|errno|error|fail|invalid)[^\)]*\)"),
)


def pattern_facts(rows: DataFrame, text: str, patterns: tuple[tuple[str, str], ...] = ENRICHMENT, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep, fact) for each pattern found in the text."""
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(name)) for name, p in patterns]))
    return rows.select(*keep, F.explode(found).alias("fact"))


def term_hits(rows: DataFrame, text: str, terms: DataFrame, pattern: str, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep, term, n, *values of terms): how often each listed term is among the words that the pattern's first group finds.

    terms is a short lookup table with a unique term column; the optimizer sends it to the words, not the words to it.
    """
    words = rows.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("term"))
    return words.join(terms, "term").groupBy(*keep, *terms.columns).agg(F.count(F.lit(1)).alias("n"))


def verdict(rows: DataFrame, by: str, text: str, patterns: tuple[tuple[str, str], ...], needs: tuple[str, ...]) -> DataFrame:
    """(by, one flag for each pattern, verdict): whether any line of a document shows each, and whether all of `needs` are shown."""
    flags = rows.groupBy(by).agg(*[F.coalesce(F.bool_or(F.col(text).rlike(p)), F.lit(False)).alias(name) for name, p in patterns])
    return flags.withColumn("verdict", F.when(reduce(lambda a, b: a & b, [F.col(n) for n in needs]), "suspicious").otherwise("clear"))


def fact_catalogue(rows: DataFrame, text: str, patterns: tuple[tuple[str, str], ...], evidence_id: str = "evidence_id") -> DataFrame:
    """(fact, n, first, last): for each fact, how many items of evidence show it, and the least and the largest id of them."""
    found = pattern_facts(rows, text, patterns, (evidence_id,)).distinct()
    return found.groupBy("fact").agg(F.count(F.lit(1)).alias("n"), F.min(evidence_id).alias("first"), F.max(evidence_id).alias("last"))


#: Risky calls and the weakness each stands for.
RISKY_APIS = (
    ("gets", "CWE-242"), ("strcpy", "CWE-120"), ("strncpy", "CWE-120"), ("strcat", "CWE-120"), ("sprintf", "CWE-120"), ("vsprintf", "CWE-120"), ("scanf", "CWE-20"),
    ("sscanf", "CWE-20"), ("memcpy", "CWE-120"), ("memmove", "CWE-120"), ("malloc", "CWE-789"), ("calloc", "CWE-789"), ("realloc", "CWE-789"), ("free", "CWE-416"),
    ("system", "CWE-78"), ("popen", "CWE-78"), ("execve", "CWE-78"), ("execl", "CWE-78"), ("execlp", "CWE-78"), ("execvp", "CWE-78"),
)
#: Words of a statement that may guard something.
SAFETY_WORDS = ("if", "assert", "sizeof", "strlen", "strnlen", "bounds", "check", "validate", "limit", "clamp", "return", "goto fail", "errno", "null", "nullptr")


def risky_calls(rows: DataFrame, code: str, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep, api, cwe): each risky call that a statement makes, once."""
    table = F.create_map(*[F.lit(x) for pair in RISKY_APIS for x in pair])
    found = rows.select(*keep, F.explode(F.array_distinct(calls(F.col(code)))).alias("api")).withColumn("cwe", F.try_element_at(table, F.col("api")))
    return found.where("cwe IS NOT NULL")


def is_safety(code: Column) -> Column:
    """Whether a statement holds one of the words that may guard something."""
    # plain words, so one pattern looks for all of them at once
    return F.lower(F.coalesce(code, F.lit(""))).rlike("|".join(SAFETY_WORDS))


#: What a source snapshot may show of one upload loop, by name and pattern, in any case.
AUDIT_FACTS = (
    ("signed_contentlen", r"\bint\s+contentlen\s*=\s*0\b"),
    ("unsigned_contentlen", r"\bunsigned\s+contentlen\s*=\s*0\b"),
    ("signed_l", r"\bint\s+l\s*=\s*0\b"),
    ("unsigned_l", r"\bunsigned\s+l\s*=\s*0\b"),
    ("atoi_parse", r"\bcontentlen\s*=\s*atoi\s*\("),
    ("sscanf_u_parse", r"\bsscanf\s*\([^;]*%u[^;]*contentlen"),
    ("contentlen_cap", r"\bif\s*\([^\n;]*contentlen[^\n;]*(?:LINESIZE\s*\*|<=|>=|<|>)[^\n;]*\)"),
    ("unbounded_upload_read", r"while\s*\(\s*\(\s*i\s*=\s*sockgetlinebuf\s*\([^;]*LINESIZE\s*-\s*1[^;]*\)\s*\)\s*>\s*0\s*\)"),
    ("bounded_upload_read", r"sockgetlinebuf\s*\([^;]*\(\s*contentlen\s*-\s*l\s*\)\s*>\s*LINESIZE\s*-\s*1\s*\?\s*LINESIZE\s*-\s*1\s*:\s*contentlen\s*-\s*l"),
    ("l_lt_contentlen_loop", r"while\s*\([^;]*\bl\s*<\s*contentlen[^;]*sockgetlinebuf"),
    ("remaining_adjust", r"if\s*\(\s*i\s*>\s*\(?\s*contentlen\s*-\s*l\s*\)?\s*\)\s*i\s*=\s*\(?\s*contentlen\s*-\s*l\s*\)?"),
    ("nul_write", r"\bbuf\s*\[\s*i\s*\]\s*=\s*0\b"),
    ("decodeurl", r"\bdecodeurl\s*\("),
    ("fprintf", r"\bfprintf\s*\([^;]*writable"),
    ("buf_allocation", r"\bbuf\s*=\s*myalloc\s*\(\s*LINESIZE\s*\)"),
    ("linesize_define", r"#\s*define\s+LINESIZE\b"),
)
#: What must stand in a snapshot at all, and the facts of the unsafe and of the safe form.
AUDIT_WORDS = ("contentlen", "sockgetlinebuf", "buf[i]", "decodeurl", "fprintf")
AUDIT_UNSAFE = ("signed_contentlen", "signed_l", "atoi_parse", "unbounded_upload_read", "remaining_adjust", "nul_write")
AUDIT_SAFE = ("unsigned_contentlen", "unsigned_l", "contentlen_cap", "l_lt_contentlen_loop", "bounded_upload_read", "nul_write")


def source_audit(lines: DataFrame, by: str, text: str) -> DataFrame:
    """(by, one flag for each fact, present, verdict) of snapshots given as lines: unsafe, safe, ambiguous or not_present."""
    shown = [F.coalesce(F.bool_or(F.col(text).rlike(f"(?i){pattern}")), F.lit(False)).alias(name) for name, pattern in AUDIT_FACTS]
    words = [F.coalesce(F.bool_or(F.contains(F.col(text), F.lit(w))), F.lit(False)) for w in AUDIT_WORDS]
    flags = lines.groupBy(by).agg(*shown, reduce(lambda a, b: a & b, words).alias("present"))
    every = lambda names: reduce(lambda a, b: a & b, [F.col(n) for n in names])
    unsafe = F.col("present") & every(AUDIT_UNSAFE) & ~F.col("contentlen_cap")
    safe = F.col("present") & every(AUDIT_SAFE)
    return flags.withColumn("verdict", F.when(unsafe, "unsafe").when(safe, "safe").when(F.col("present"), "ambiguous").otherwise("not_present"))


#: Unbounded calls and the patterns that show them with their buffer, and the bounded ones.
UNBOUNDED = (
    ("unbounded_sprintf", r"\bsprintf\s*\(\s*([A-Za-z_]\w*)(?:\s*\+[^,]*)?\s*,"),
    ("unbounded_vsprintf", r"\bvsprintf\s*\(\s*([A-Za-z_]\w*)(?:\s*\+[^,]*)?\s*,"),
    ("unbounded_strcpy", r"\bstrcpy\s*\(\s*([A-Za-z_]\w*)(?:\s*\+[^,]*)?\s*,"),
    ("unbounded_strcat", r"\bstrcat\s*\(\s*([A-Za-z_]\w*)(?:\s*\+[^,]*)?\s*,"),
    ("gets", r"\bgets\s*\(\s*([A-Za-z_]\w*)\s*\)"),
)


def unbounded_calls(rows: DataFrame, code: str, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep, kind, symbol) of each unbounded call in an item that does not begin with a comment."""
    lead = F.regexp_replace(code, r"^\s+", "")

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(code, F.lit(pattern), 1), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("symbol")))

    found = F.flatten(F.array(*[of(kind, pattern) for kind, pattern in UNBOUNDED]))
    return rows.where(~(lead.startswith("//") | lead.startswith("/*"))).select(*keep, F.explode(found).alias("x")).select(*keep, "x.*")


#: Words of a size-like expression.
SIZE_LIKE = ("len", "length", "size", "count", "offset", "index", "<<", "*")


def size_advances(rows: DataFrame, source: str, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep, variable, op, expression) of each compound assignment by a size-like expression in a source text."""
    pattern = r"\b([A-Za-z_]\w*)\s*(\+=|-=)\s*([^;]+);"
    part = lambda i: F.regexp_extract_all(source, F.lit(pattern), i)
    found = rows.select(*keep, F.explode(F.arrays_zip(part(1).alias("variable"), part(2).alias("op"), part(3).alias("expression"))).alias("x")).select(*keep, "x.*")
    found = found.withColumn("expression", F.regexp_replace("expression", r"^\s+|\s+$", ""))
    return found.where(F.exists(F.array(*map(F.lit, SIZE_LIKE)), lambda w: F.contains(F.lower("expression"), w)))
