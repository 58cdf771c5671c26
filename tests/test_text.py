"""Scalar functions, rules and similarity on small inputs."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from arborlake.functions import rules, similarity, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (text.normalize_code, "a = 1; // c\n/* d\n */ b", "a = 1; b"),
        (text.blank_literals, 'f("x\\"y", \'c\'); // z', 'f("", \'\');  '),
        (text.identifiers, "if (foo->bar == LIMIT_X && foo) return baz(foo);", ["foo", "bar", "baz"]),
        (text.call_names, "if (f(g(x)) && sizeof (y)) f(1);", ["f", "g", "f"]),
        (text.statement_kind, "return x;", "ReturnStatement"),
        (text.statement_kind, "else if (x)", "Condition"),
        (text.statement_kind, "while (1)", "Loop"),
        (text.statement_kind, "x == y;", "Statement"),
        (text.statement_kind, "x <= y;", "Statement"),
        (text.statement_kind, "x += 1;", "Assignment"),
        (text.statement_kind, "a->n *= 2;", "Assignment"),
        (text.statement_kind, "i++;", "OperatorExpression"),
        (text.statement_kind, "f(x);", "Statement"),
        (text.gold_statements, "a();\nb(); c()\n\n['d();']", ["a();", "b();", "c()", "d();"]),
        (text.gold_statements, None, []),
        (text.norm_list, "['CVE-1', \"CVE-2\"]", ["CVE-1", "CVE-2"]),
        (text.norm_list, "a; b,c", ["a", "b", "c"]),
        (text.norm_list, None, []),
        (text.duration_seconds, "1h2m3s", 3723.0),
        (text.duration_seconds, "1m51s", 111.0),
        (text.duration_seconds, "soon", None),
        (text.repo_key, "https://github.com/Own/Name.git/", "own/name"),
        (text.suffix_candidates, "a/b\\c.c", ["a/b/c.c", "b/c.c", "c.c"]),
        (text.html_unescape, "&lt;a&gt; &amp;lt; &#39;", "<a> &lt; '"),
        (text.truthy, " YES ", True),
        (text.truthy, None, False),
        (text.safe_int, "12x", None),
        (text.safe_int, " 12 ", 12),
        (text.first_digits, "abc 042 7", 42),
        (text.numeric, "-1", None),
        (text.numeric, "inf", None),
        (text.numeric, "2.5", 2.5),
        (text.strip_code_fence, "```json\n{1}\n```", "{1}"),
        (text.strip_code_fence, " plain ", "plain"),
        (text.mask_secrets, '{"a": {"API_KEY": "x\\"y", "b": "c"}}', '{"a": {"API_KEY": "***", "b": "c"}}'),
        (text.close_json, '{"a": [1, 2,', '{"a": [1, 2]}'),
        (text.close_json, '{"a": "}",}', '{"a": "}"}'),
        (text.canonical_type, "const struct Foo *", "Foo"),
        (text.includes, '#include <a.h>\n # include "b/c.h"', ["a.h", "b/c.h"]),
        (text.macros, "#define A 1\nx\n#define B(x) x", ["A", "B"]),
        (text.literals, 'f("a", 0x1F, \'c\', 12)', ['"a"', "0x1F", "'c'", "12"]),
        (text.code_tokens, "a+=b; /* c */", ["a", "+", "=", "b", ";"]),
        (text.safe_name, "a b/c*d", "a_b_c_d"),
        (lambda c: text.truncate_middle(c, 40), "x" * 100, "x" * 5 + "\n... <truncated> ...\n" + "x" * 5),
        (lambda c: text.whole_word(c, "len"), "length len_x", False),
        (lambda c: text.whole_word(c, "len"), "p->len;", True),
    ],
)
def test_scalar(spark, f, value, expected):
    assert one(spark, value, f) == expected


def test_numbers_as_text(spark):
    assert [one(spark, n, text.format_bytes, "long") for n in (12, 2048, 5 * 1024**3)] == ["12 B", "2.0 KB", "5.0 GB"]
    assert [one(spark, n, text.format_seconds, "double") for n in (3.0, 123.0, 3723.0)] == ["3s", "2m03s", "1h02m03s"]


def test_log_line(spark):
    tag, fields = spark.createDataFrame([("QUERY | nodes=350 | note = a=b | bare",)], "x string").select(*text.log_fields(F.col("x"))).first()
    assert (tag, fields) == ("QUERY", {"nodes": "350", "note": "a=b"})


def test_rate_limits(spark):
    got = spark.createDataFrame([({"X-RateLimit-Remaining": "9", "retry-after": "3", "Date": "x"},)], "x map<string,string>").select(text.rate_limit_headers(F.col("x"))).first()[0]
    assert got == {"X-RateLimit-Remaining": "9", "retry-after": "3"}


RULES = {
    "p->next = q;": {"pointer_dereference"},
    "x = *ptr;": {"pointer_dereference"},
    "i++;": {"pointer_arithmetic"},
    "return i + 1;": set(),
    "buf[i] = 0;": {"array_indexing"},
    "strcpy(dst, src);": {"buffer_io_or_copy_call", "unchecked_buffer_api", "buffer_call_without_obvious_size", "nearby_guard_not_seen"},
    "memcpy(d, s, len);": {"buffer_io_or_copy_call", "nearby_guard_not_seen"},
    "n = count * size;": {"pointer_dereference", "size_length_arithmetic", "multiplication_size_computation"},
    "if (len > 10) return;": {"bounds_check", "sanitizer_like_guard"},
    "if (p == NULL)": {"null_check"},
    "for (i = 0; i < n; j)": {"bounds_check", "loop_over_buffer_or_range"},
    "y = (size_t) x;": {"integer_cast"},
    "unsigned int z;": {"signed_unsigned_conversion"},
    "return -1;": set(),  # no word boundary stands before the sign
    "return NULL;": {"error_return"},
    "free(q);": {"allocation_or_free"},
    "   ": set(),
}


def test_statement_rules(spark):
    rows = spark.createDataFrame([(i, c, "Statement", "") for i, c in enumerate(RULES)], "id int, code string, kind string, context string")
    got = {i: set() for i in range(len(RULES))}
    for r in rules.tag_statements(rows).collect():
        got[r["id"]].add(r["rule"])
    assert [got[i] for i in range(len(RULES))] == list(RULES.values())


def test_guard_in_context(spark):
    rows = spark.createDataFrame([(0, "memcpy(d, s, len);", "Statement", "if (ok)")], "id int, code string, kind string, context string")
    assert {r["rule"] for r in rules.tag_statements(rows).collect()} == {"buffer_io_or_copy_call"}


def test_enrichment(spark):
    rows = spark.createDataFrame([(0, "p = p + 1;"), (1, "if (n <= limit) x = a[2];"), (2, "malloc(3)")], "id int, code string")
    got = {(r["id"], r["fact"]) for r in rules.pattern_facts(rows, "code").collect()}
    assert {(0, "POINTER_ADVANCE"), (1, "BOUNDS_CHECK"), (1, "POINTER_DEREFERENCE"), (2, "ALLOCATION_SIZE")} <= got


def test_similarity(spark):
    pairs = [("int a = 1;", "int  a = 1; // x"), ("", "x"), ("abcdef" * 60, "abcxef" * 60), ("ab", "zzzzzzzzzzzzzzzzzz"), (None, None)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = [r["similarity"] for r in similarity.with_similarity(rows, "a", "b").collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and got[4] == 0.0
    assert got[2] == pytest.approx(SequenceMatcher(None, *pairs[2]).ratio())
    bounded = [r["similarity"] for r in similarity.with_similarity(rows, "a", "b", least=0.8).collect()]
    assert bounded[2] == got[2] and bounded[3] == pytest.approx(0.2)


def test_validation(spark):
    rows = spark.createDataFrame([("int f() { return 1; }", "int f(){return 1;}"), ("int f() { return 1; } // c", "int f() { return 1; }"), ("abc", "xyz"), (None, "x"), ("int alpha = beta + gamma;", "int alpha = beta + gamme;")], "found string, wanted string")
    assert [r["status"] for r in similarity.validate_targets(rows).collect()] == ["match_exact", "match_exact", "body_mismatch", "not_found", "match_approximate"]


def test_greedy_matching(spark):
    samples = spark.createDataFrame([("s", "alpha = beta;\nalpha = beta1;"), ("t", "x();"), ("missing", "y();")], "sample_id string, changed_statements string")
    predictions = spark.createDataFrame([("s", ["alpha = beta1;"]), ("t", ["", "x();", "z();"])], "sample_id string, statements array<string>")
    got = {r["sample_id"]: (r["gold"], r["predicted"], r["matched"]) for r in similarity.match_statements(samples, predictions).collect()}
    # the first gold statement takes the only prediction
    assert got == {"s": (2, 1, 1), "t": (1, 2, 1)}
    m = similarity.statement_metrics(similarity.match_statements(samples, predictions)).first()
    assert (m["precision"], m["recall"], m["f1"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3))


def test_locate(spark):
    samples = spark.createDataFrame([("1", "f", "a.c", ""), ("2", "f", "z.c", ""), ("3", "gone", "a.c", "int g(int x) { return x + 1; }"), ("4", "gone", "z.c", "x")], "sample_id string, func_name string, filepath string, func_body string")
    functions = spark.createDataFrame([("n1", "f", "a.c", "int f();"), ("n2", "g", "a.c", "int g(int x) { return x + 2; }")], "id string, name string, file string, code string")
    got = {r["sample_id"]: (r["node_id"], r["score"]) for r in similarity.locate_targets(samples, functions).collect()}
    assert got["1"] == ("n1", 1.0) and got["2"] == ("n1", 0.7) and got["3"][0] == "n2" and got["3"][1] > 0.9 and "4" not in got


def test_best_ratio_compares_only_what_may_win(monkeypatch):
    from difflib import SequenceMatcher
    from random import Random

    r, calls = Random(3), []
    texts = ["", "a", *("".join(r.choices("ab c\n", k=r.randrange(1, 60))) for _ in range(120))]
    plain = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio()

    def counted(*args, **options):
        calls.append(args)
        return SequenceMatcher(*args, **options)

    monkeypatch.setattr(similarity, "SequenceMatcher", counted)
    for _ in range(300):
        pairs = [(x := r.choice(texts), r.choice((x[3:], x[:-2], r.choice(texts)))) for _ in range(3)]
        assert similarity.best_ratio(pairs) == max(plain(a, b) for a, b in pairs)
    assert len(calls) < 600
    calls.clear()
    long = "".join(r.choices("abcdefgh ", k=5000))
    squeezed = long.replace(" ", "")
    assert similarity.best_ratio([(long, long[9:]), (squeezed, squeezed[8:])]) == max(plain(long, long[9:]), plain(squeezed, squeezed[8:])) and not calls
