"""Variable statements and flagged statements on a function with an inner declaration."""

from arborlake.operators import symbols

BODY = [
    "int f(int k)\n{", "char  *buf = malloc(k);", "if (k > 1) {", "char  *buf = NULL;", "buf[0] = k;", "}", "free(buf);", "fgets(buf, 9, in);", "printf(buf);", "while (x < k) {", "}", "other(buf);",
]
ROWS = [("a.c", 0, i, 10 + i, c) for i, c in enumerate(BODY)] + [("a.c", 1, i, 40 + i, f"use{i}(v);") for i in range(30)] + [("a.c", 1, 30, 70, "int v;"), ("b.c", 0, 0, 1, None), ("b.c", 0, 1, 2, "")]
NAMED = [("a.c", 0, "k", 10), ("a.c", 0, "buf", 11), ("a.c", 1, "v", 70)]
REQUESTS = [
    ("outer", "a.c", 0, "buf", None), ("inner", "a.c", 0, "buf", 14), ("absent", "a.c", 0, "x", None), ("many", "a.c", 1, "v", 1), ("null", "a.c", 0, None, None), ("pattern", "a.c", 0, "b.f", None),
    ("elsewhere", "c.c", 0, "buf", None), ("empty", "b.c", 0, "v", None),
]


def _tables(spark):
    # an extra column that clashes with one of the operator's
    statements = spark.createDataFrame([(*r, "t") for r in ROWS], "file string, fn int, idx int, line int, code string, text string")
    return statements, spark.createDataFrame(NAMED, "file string, fn int, name string, line int"), spark.createDataFrame(REQUESTS, "request string, file string, fn int, symbol string, source_line int")


def test_variable_statements(spark):
    statements, variables, requests = _tables(spark)
    got = {}
    for r in symbols.variable_statements(statements, variables, requests).orderBy("request", "place").collect():
        got.setdefault(r["request"], []).append((r["category"], r["idx"]))
    # the outer one ends where the name is declared again, the inner one at its brace; v is only declared last, so nothing after it holds it but its declaration
    assert got == {"outer": [("declaration", -1), ("declaration", 1)], "inner": [("declaration", 3), ("allocation", 4)], "many": [("declaration", -1), ("declaration", 30)]}
    assert symbols.variable_statements(statements.limit(0), variables.limit(0), requests).count() == 0


def test_categories_and_budgets(spark):
    statements, variables, requests = _tables(spark)
    # one declaration, then one statement of each kind and far more uses than are shown
    lines = ["int  v;", "v = g();", "memcpy(v, p, 1);", "if (v) {", "printf(v);", "delete(v);", *[f"use{i}(v);" for i in range(30)]]
    rows = spark.createDataFrame([("x.c", 0, i, i + 1, c) for i, c in enumerate(lines)], "file string, fn int, idx int, line int, code string")
    one = spark.createDataFrame([("r", "x.c", 0, "v", None)], "request string, file string, fn int, symbol string, source_line int")
    got = [(r["place"], r["category"], r["idx"]) for r in symbols.variable_statements(rows, variables, one).orderBy("place").collect()]
    assert got == [(1, "declaration", 0), (2, "allocation", 1), (3, "writes", 2), (4, "bounds_checks", 3), (5, "sinks", 4), (6, "lifetime", 5), (7, "uses", 6), (8, "uses", 7), (9, "uses", 8), (10, "uses", 9)]


def test_all_items_without_budgets(spark):
    """More items of each category than its budget, and far more than 18 together: without budgets each is there, in the same order."""
    lines = ["int  v;", *[f"{call}(v{i % 2 * ', p'}, 1);" for call in ("memcpy", "printf", "delete", "use") for i in range(12)], *["if (v) {"] * 9, *["v = g();"] * 5]
    rows = spark.createDataFrame([("x.c", 0, i, i + 1, c) for i, c in enumerate(lines)], "file string, fn int, idx int, line int, code string")
    one = spark.createDataFrame([("r", "x.c", 0, "v", None)], "request string, file string, fn int, symbol string, source_line int")
    variables = spark.createDataFrame([("x.c", 0, "v", 1)], "file string, fn int, name string, line int")
    whole = [tuple(r) for r in symbols.variable_statements(rows, variables, one, budgets=False).orderBy("place").select("category", "idx").collect()]
    spans = [("declaration", -1, 1), ("allocation", 58, 63), ("writes", 1, 13), ("bounds_checks", 49, 58), ("sinks", 13, 25), ("lifetime", 25, 37), ("uses", 37, 49)]
    assert whole == [(kind, i) for kind, a, b in spans for i in range(a, b)]
    shown = [tuple(r) for r in symbols.variable_statements(rows, variables, one).orderBy("place").select("category", "idx").collect()]
    most = dict(symbols.CATEGORIES)
    assert shown == [(kind, i) for kind, a, b in spans for i in list(range(a, b))[: most[kind]]][: symbols.MOST]


def test_the_query_shows_all_items(spark, monkeypatch):
    from arborlake.plans import symbol_queries

    monkeypatch.setattr(symbols, "MOST", 1)
    monkeypatch.setattr(symbols, "CATEGORIES", tuple((c, 1) for c, _ in symbols.CATEGORIES))
    rows = symbol_queries.QUERIES["variable_statements"](spark, "/root/testdata/sf0.001")
    assert rows.where("place > 1").count() > 0 and rows.groupBy("request", "category").count().where("count > 1").count() > 0


def test_flagged_statements(spark):
    statements, _, requests = _tables(spark)
    of = lambda kind, most=12: sorted((r["request"], r["idx"]) for r in symbols.flagged_statements(statements, requests, kind, most).collect())
    assert of("risk") == [("inner", 1), ("inner", 6), ("inner", 7), ("inner", 8), ("null", 1), ("null", 6), ("null", 7), ("null", 8), ("outer", 1), ("outer", 6), ("outer", 7), ("outer", 8)]
    assert of("safety") == [("inner", 3), ("null", 2), ("null", 3), ("outer", 3)] and of("safety", 1) == [("inner", 3), ("null", 2), ("outer", 3)]
