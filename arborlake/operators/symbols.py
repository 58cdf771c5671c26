"""What the statements of a function do to one of its variables, and statements that guard or risk something, for a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions import outline as o
from arborlake.functions.rules import RISKY_APIS, is_safety

#: Calls that allocate, free and write, and those beyond the writing ones through which something leaves.
ALLOCATES = ("malloc", "calloc", "realloc", "myalloc", "mystrdup", "strdup", "new")
FREES = ("free", "myfree", "delete")
WRITES = (
    "sprintf", "snprintf", "vsprintf", "vsnprintf", "strcpy", "strncpy", "strcat", "strncat", "memcpy", "memmove", "fgets", "gets", "scanf", "sscanf", "fscanf", "sockgetlinebuf", "decodeurl", "printuserlist",
    "printiplist", "printportlist",
)
SENDS = ("fprintf", "printf", "printstr", "stdpr", "write", "send")
#: Categories in order, with how many items of each are shown, and how many of all.
CATEGORIES = (("declaration", 2), ("allocation", 3), ("writes", 8), ("bounds_checks", 6), ("sinks", 8), ("lifetime", 3), ("uses", 4))
MOST = 18
#: Words by which a statement counts as a guard besides the safety words.
GUARDS = ("LINESIZE", "sizeof", "contentlen")

_WORD = r"^[A-Za-z_]\w*$"
# stands for the symbol, so that patterns are the same for all rows
_AT = "\x01"


def _calls(calls: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(calls, F.array(*map(F.lit, names)))


def _asked(requests: DataFrame) -> DataFrame:
    """Requests whose symbol is an identifier; another one has no statement."""
    return requests.where(F.col("symbol").rlike(_WORD)).select("request", "file", "fn", "symbol", "source_line")


def _marked() -> Column:
    """The code with its symbol as a mark."""
    word = F.concat(F.lit(r"(?<![A-Za-z0-9_])"), F.col("symbol"), F.lit(r"(?![A-Za-z0-9_])"))
    return F.regexp_replace(F.col("code"), word, F.lit(_AT))


def _seen(statements: DataFrame, requests: DataFrame) -> DataFrame:
    """Statements of each request's function that hold its symbol. Words and calls are found once a statement, before it meets the requests."""
    words = F.array_distinct(F.regexp_extract_all("code", F.lit(r"[A-Za-z0-9_]+"), 0))
    rows = statements.select("file", "fn", "idx", "line", "code", o.called(F.col("code")).alias("calls"), words.alias("_words"))
    asked = _asked(requests).withColumnsRenamed({"file": "_file", "fn": "_fn"})
    same = (F.col("file") == F.col("_file")) & (F.col("fn") == F.col("_fn")) & F.array_contains("_words", F.col("symbol"))
    return rows.join(asked, same).drop("_file", "_fn", "_words")


def category(text: Column, code: Column, calls: Column, defines: Column) -> Column:
    """The first category, other than declaration, of a statement that holds the symbol."""
    has = F.contains(text, F.lit(_AT))
    written = text.rlike(rf"{_AT}\s*\[[^\]]+\]\s*=|\*\s*{_AT}\s*=|\b(?:{'|'.join(WRITES)})\s*\([^;\n]*{_AT}")
    guard = text.rlike(r"\b(?:if|while|for)\s*\(") & text.rlike(rf"{_AT}|\bLINESIZE\b|\bsizeof\b|\bcontentlen\b|\bi\b\s*[<>]")
    risky = _calls(calls, tuple(api for api, _ in RISKY_APIS))
    return (
        F.when((defines | text.rlike(rf"{_AT}\s*(?:\[[^\]]*\])?\s*=")) & (_calls(calls, ALLOCATES) | F.contains(code, F.lit("="))), "allocation")
        .when(written | (has & _calls(calls, WRITES)), "writes").when(is_safety(code) | guard, "bounds_checks").when(has & (risky | _calls(calls, SENDS)), "sinks")
        .when(_calls(calls, FREES), "lifetime").otherwise("uses")
    )


def variable_statements(statements: DataFrame, variables: DataFrame, requests: DataFrame, budgets: bool = True) -> DataFrame:
    """(request, place, category, idx, line, code, declared_line): what a function's statements do to a variable, by category, then order.

    statements (file, fn, idx, line, code), variables (file, fn, name, line), requests (request, file, fn, symbol, source_line); a request names one
    function. The declaration meant is the last at or before source_line, else the first; without a source line, the first. Its statements end where
    the name is declared again, and for an inner declaration at the next closing brace. A variable itself is an item of idx -1. Each statement counts
    in its first category. With budgets each category shows a fixed number and a request 18, without them all items are shown. A name that the
    function does not declare gives nothing.
    """
    again = rf"(?:^|[;{{]\s*)\s*(?:[A-Za-z_]\w*\s+)+[*\s]+{_AT}(?:\s*\[[^\]]*\])?\s*[=;,]"
    words = F.array_distinct(F.regexp_extract_all("code", F.lit(r"[A-Za-z0-9_]+"), 0))
    # what is found in a statement is found once, before it meets the requests; a declaration is one of the unmarked code, as its name has to be an identifier
    rows = statements.select("file", "fn", "idx", "line", "code", o.called(F.col("code")).alias("calls"), words.alias("words"), o.declared(F.col("code")).alias("declared"), F.ltrim("code").startswith("}").alias("brace"), F.lit(False).alias("own"))
    none = F.array().cast("array<string>")
    own = variables.select("file", "fn", F.lit(-1).alias("idx"), "line", F.col("name").alias("code"), none.alias("calls"), none.alias("words"), F.lit(None).cast("string").alias("declared"), F.lit(False).alias("brace"), F.lit(True).alias("own"))
    asked = requests.select("request", F.col("file").alias("_file"), F.col("fn").alias("_fn"), "symbol", "source_line", F.coalesce(F.col("symbol").rlike(_WORD), F.lit(False)).alias("word"))
    # one join finds the variables, the statements that hold the symbol, and the braces that may end a declaration
    holds = F.col("word") & F.array_contains("words", F.col("symbol"))
    closes = F.col("word") & F.col("brace") & F.col("source_line").isNotNull()
    rows = rows.unionByName(own).join(asked, (F.col("file") == F.col("_file")) & (F.col("fn") == F.col("_fn")) & ((F.col("own") & (F.col("code") == F.col("symbol"))) | holds | closes))
    rows = rows.select("request", "source_line", "idx", "line", "code", "calls", "symbol", holds.alias("has"), (holds & F.coalesce(F.col("declared") == F.col("symbol"), F.lit(False))).alias("defines"), F.coalesce(closes, F.lit(False)).alias("closes"))
    rows = rows.withColumn("text", F.when(F.col("has"), _marked()))
    kind = F.when(F.col("has"), category(F.col("text"), F.col("code"), F.col("calls"), F.col("defines")))
    rows = rows.select("request", "source_line", "idx", "line", "code", F.coalesce(F.translate("text", "\n", " ").rlike(again), F.lit(False)).alias("again"), "defines", kind.alias("kind"), "closes", "has")
    whole = Window.partitionBy("request")
    is_declaration = (F.col("idx") == -1) | F.col("again") | F.col("defines")
    before = F.max(F.when(is_declaration & (F.col("line") <= F.col("source_line")), F.col("line"))).over(whole)
    rows = rows.withColumn("declared_line", F.coalesce(before, F.min(F.when(is_declaration, F.col("line"))).over(whole))).where("declared_line IS NOT NULL")
    later = F.col("line") > F.col("declared_line")
    inner = (F.col("source_line") >= F.col("declared_line")) & F.coalesce(F.max(F.col("again") & (F.col("line") < F.col("declared_line"))).over(whole), F.lit(False))
    rows = rows.withColumns({
        "stop_line": F.min(F.when(F.col("again") & later, F.col("line"))).over(whole),
        "stop_idx": F.min(F.when(F.coalesce(inner, F.lit(False)) & later & F.col("closes"), F.col("idx"))).over(whole),
    })
    inside = F.col("has") & (F.col("line") >= F.col("declared_line")) & F.coalesce(F.col("line") < F.col("stop_line"), F.lit(True)) & F.coalesce(F.col("idx") < F.col("stop_idx"), F.lit(True))
    rows = rows.withColumn("inside", inside).withColumn("any", F.max("inside").over(whole))
    declares = is_declaration & (F.col("line") == F.col("declared_line"))
    named = F.when(declares, "declaration").when(F.col("inside") | (~F.col("any") & F.col("has")), F.col("kind"))
    rank = F.create_map(*[F.lit(x) for i, (c, _) in enumerate(CATEGORIES) for x in (c, i)])
    rows = rows.withColumn("category", named).where("category IS NOT NULL").withColumn("rank", rank[F.col("category")])
    if budgets:
        most = F.create_map(*[F.lit(x) for c, n in CATEGORIES for x in (c, n)])
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("request", "rank").orderBy("idx", "line"))).where(F.col("n") <= most[F.col("category")])
    shown = rows.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy("rank", "idx", "line")))
    shown = shown.where(F.col("place") <= MOST) if budgets else shown
    return shown.select("request", "place", "category", "idx", "line", "code", "declared_line")


def flagged_statements(statements: DataFrame, requests: DataFrame, kind: str, most: int = 12) -> DataFrame:
    """(request, place, idx, line, code): the first `most` statements of each request's function that guard (kind `safety`) or risk something (`risk`).

    requests as above; a null symbol takes every such statement, else those that hold the symbol.
    """
    any_ = requests.where("symbol IS NULL").select("request", "file", "fn").join(statements.select("file", "fn", "idx", "line", "code"), ["file", "fn"])
    rows = any_.withColumn("calls", o.called(F.col("code"))).select("request", "idx", "line", "code", "calls").unionByName(_seen(statements, requests).select("request", "idx", "line", "code", "calls"))
    guard = is_safety(F.col("code")) | F.exists(F.array(*map(F.lit, GUARDS)), lambda w: F.contains(F.col("code"), w))
    risk = _calls(F.col("calls"), tuple(api for api, _ in RISKY_APIS)) | _calls(F.col("calls"), WRITES + SENDS)
    order = Window.partitionBy("request").orderBy("idx")
    return rows.where({"safety": guard, "risk": risk}[kind]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("request", "place", "idx", "line", "code")
