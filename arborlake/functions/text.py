"""Scalar functions over code and log text, all as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
#: Words that are no call and no identifier.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "else", "do", "return", "sizeof", "case", "typedef", "struct", "class", "enum", "defined")


def stable_id(*parts: Column, length: int = 16) -> Column:
    """Hex id of the parts joined by bars; nulls are empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, length)


def hash_bucket(key: Column, n: int) -> Column:
    """Bucket of a key by the first 60 bits of its SHA-1."""
    return F.pmod(F.conv(F.substring(F.sha1(key.cast("string")), 1, 15), 16, 10).cast("long"), F.lit(n))


def safe_name(c: Column, most: int = 80) -> Column:
    """Letters, digits, dot, bar and dash; runs of the rest become one underscore."""
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), 1, most)


def truncate_middle(c: Column, most: int) -> Column:
    """The text, or its two ends around a note if it is longer."""
    half = max(1, (most - 30) // 2)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, half), F.lit("\n... <truncated> ...\n"), F.right(c, F.lit(half))))


def strip_code_fence(c: Column) -> Column:
    """The lines between the first and the last of a fenced text; other texts trimmed."""
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = F.split(text, "\n")
    inner = F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n"), r"^\s+|\s+$", "")
    return F.when(text.startswith("```") & (F.size(lines) >= 2), inner).otherwise(text)


def one_line(c: Column, most: int = 200) -> Column:
    """White space folded, cut to a length."""
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, most)


def normalize_code(c: Column) -> Column:
    """Comments out, white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", " "), r"(?m)//[^\n]*", " "), r"\s+", " "))


def blank_literals(c: Column) -> Column:
    """Comments and the insides of string and character literals out."""
    out = F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    return F.regexp_replace(F.regexp_replace(out, r'"(?:\\.|[^"\\])*"', '""'), r"'(?:\\.|[^'\\])*'", "''")


def identifiers(c: Column, skip: tuple[str, ...] = NOT_CALLS) -> Column:
    """Distinct identifiers in order of first use, without the listed words and names in capitals."""
    found = F.regexp_extract_all(c, F.lit(f"({IDENTIFIER})"), 1)
    return F.filter(F.array_distinct(found), lambda x: ~x.isin(*skip) & ~x.rlike(r"^[A-Z][A-Z0-9_]+$"))


def call_names(c: Column) -> Column:
    """Names before an opening bracket, in order with repeats, without control words."""
    return F.filter(F.regexp_extract_all(c, F.lit(rf"\b({IDENTIFIER})\s*\("), 1), lambda x: ~x.isin(*NOT_CALLS))


#: Kinds of statements and the patterns that show them, in order.
STATEMENT_KINDS = (
    ("ReturnStatement", r"^return\b"),
    ("Condition", r"^if\s*\(|^else\s+if\s*\(|^switch\s*\("),
    ("Loop", r"^(for|while)\s*\(|^do\b"),
    ("Assignment", r"(?<![=!<>])=(?!=)"),
    ("OperatorExpression", r"[+\-*/%&|^]=|\+\+|--"),
)


def statement_kind(c: Column) -> Column:
    """Kind of a statement by the first pattern it shows; a comparison is no assignment, a compound assignment is one."""
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.coalesce(*[F.when(s.rlike(pattern), kind) for kind, pattern in STATEMENT_KINDS], F.lit("Statement"))


def literals(c: Column) -> Column:
    """String, character and number literals, in order."""
    return F.regexp_extract_all(c, F.lit(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\b(?:0[xX][0-9A-Fa-f]+|[0-9]+(?:\.[0-9]+)?)\b)"""), 1)


def code_tokens(c: Column) -> Column:
    """Identifiers, numbers, literals and single marks, without comments."""
    return F.regexp_extract_all(normalize_code(c), F.lit(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[A-Za-z_]\w*|[0-9]+|[^\s\w])"""), 1)


def canonical_type(c: Column) -> Column:
    """A C type without qualifiers, stars and brackets, white space folded."""
    out = F.regexp_replace(c, r"\b(const|static|extern|volatile|register|inline|restrict|struct|enum|union|class)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[*&]|\[[^\]]*\]", " "), r"\s+", " "))


def includes(text: Column) -> Column:
    """Paths of include lines, in order."""
    return F.regexp_extract_all(text, F.lit(r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)[>"]'), 1)


def macros(text: Column) -> Column:
    """Names of defined macros, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)"), 1)


def gold_statements(c: Column) -> Column:
    """Statements of a text cut at line ends and after semicolons, without quotes and brackets round them."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r";\s+", ";\n"), r"\n+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"""^[ \t\r\n'"\[\]]+|[ \t\r\n'"\[\]]+$""", "")), lambda p: p != "")


def whole_word(text: Column, word: str) -> Column:
    """Whether the identifier stands by itself in the text."""
    return text.rlike(rf"(?<![A-Za-z0-9_])\Q{word}\E(?![A-Za-z0-9_])")


def suffix_candidates(path: Column) -> Column:
    """The path and every shorter tail of it, longest first."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def repo_key(url: Column) -> Column:
    """owner/name of a repository url, lower-cased, without .git."""
    return F.lower(F.regexp_extract(F.regexp_replace(F.trim(url), r"(?:\.git)?/*$", ""), r"([^/:]+/[^/:]+)$", 1))


def duration_seconds(c: Column) -> Column:
    """Seconds of a duration such as 1h2m3.5s; null if it has no part."""
    part = lambda unit: F.coalesce(F.regexp_extract(c, rf"([0-9]+(?:\.[0-9]+)?){unit}(?![a-z])", 1).try_cast("double"), F.lit(0.0))
    return F.when(c.rlike(r"[0-9](?:\.[0-9]+)?[hms]"), part("h") * 3600 + part("m") * 60 + part("s"))


def format_bytes(n: Column) -> Column:
    """A size with one decimal in the largest unit that keeps it at 1 or more."""
    out = F.format_string("%d B", n.cast("long"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**i, F.concat(F.format_number(n / 1024**i, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_seconds(s: Column) -> Column:
    """1h02m03s, 2m03s or 3s."""
    whole = s.cast("long")
    h, m, r = F.floor(whole / 3600).cast("long"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("long"), F.pmod(whole, F.lit(60))
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def html_unescape(c: Column) -> Column:
    """The five named entities and the two forms of the apostrophe; ampersands last."""
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(mark))
    return c


def safe_int(c: Column) -> Column:
    """A whole number, null if the text is none."""
    return F.trim(c.cast("string")).try_cast("long")


def first_digits(c: Column) -> Column:
    """The first run of digits as a number."""
    return F.nullif(F.regexp_extract(c, r"([0-9]+)", 1), F.lit("")).try_cast("long")


def numeric(c: Column) -> Column:
    """A finite number of at least 0, else null."""
    n = c.cast("string").try_cast("double")
    return F.when((n >= 0) & (n < float("inf")) & ~F.isnan(n), n)


def truthy(c: Column) -> Column:
    """Whether a text or number stands for yes."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y", "on"), F.lit(False))


def norm_list(c: Column) -> Column:
    """A list in any of its text forms as an array: [a, b], or parts between commas or semicolons; blanks go."""
    inner = F.regexp_replace(F.coalesce(c, F.lit("")), r"""^\s*\[|\]\s*$""", "")
    parts = F.transform(F.split(inner, "[,;]"), lambda p: F.regexp_replace(p, r"""^[\s'"]+|[\s'"]+$""", ""))
    return F.filter(parts, lambda p: p != "")


def short_list(c: Column, most: int = 40, width: int = 80) -> Column:
    """Distinct values, cut in number and length."""
    return F.slice(F.array_distinct(F.transform(c, lambda x: F.substring(x, 1, width))), 1, most)


def mask_secrets(text: Column, keys: tuple[str, ...] = ("api_key", "apikey", "token", "secret", "password", "authorization")) -> Column:
    """JSON text with the string values of secret keys masked, at any depth."""
    return F.regexp_replace(text, rf'(?i)("[^"]*(?:{"|".join(keys)})[^"]*"\s*:\s*)"(?:\\.|[^"\\])*"', '$1"***"')


def log_fields(line: Column) -> tuple[Column, Column]:
    """(tag, fields) of a line such as `tag | k=v | k=v`; fields is a map."""
    parts = F.transform(F.split(line, r"\|"), lambda p: F.trim(p))
    pairs = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.contains(p, F.lit("=")))
    keys = F.transform(pairs, lambda p: F.trim(F.substring_index(p, "=", 1)))
    values = F.transform(pairs, lambda p: F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))))
    return parts[0], F.map_from_arrays(keys, values)


def rate_limit_headers(headers: Column) -> Column:
    """The entries of a header map whose names speak of rate limits."""
    return F.map_filter(headers, lambda k, v: F.lower(k).contains("ratelimit") | F.lower(k).contains("rate-limit") | (F.lower(k) == "retry-after"))


def close_json(text: Column) -> Column:
    """JSON text with trailing commas dropped and cut-off brackets closed, where only closers are missing."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r",\s*([}\]])", "$1")
    bare = F.regexp_replace(clean, r'"(?:\\.|[^"\\])*"', "")
    marks = F.regexp_extract_all(bare, F.lit(r"([{}\[\]])"), 1)
    open_ = F.aggregate(marks, F.lit("").cast("string"), lambda s, m: F.when(m == "{", F.concat(F.lit("}"), s)).when(m == "[", F.concat(F.lit("]"), s)).otherwise(F.substring(s, 2, F.length(s))))
    return F.concat(F.regexp_replace(clean, r",\s*$", ""), open_)


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is found."""
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns], F.lit(False))
