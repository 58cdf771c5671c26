"""JSON inside free text, against a plain scanner and listed cases."""

import json
import random

import pytest

from arborlake.functions import json_text as j


def plain_spans(text):
    """The same search, scanning anew from each opener."""
    out, i = [], 0
    while i < len(text):
        if text[i] not in "[{":
            i += 1
            continue
        stack, quoted, skip, end = [], False, False, "out"
        for k in range(i, len(text)):
            c = text[k]
            if quoted:
                if skip:
                    skip = False
                elif c == "\\":
                    skip = True
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in "[{":
                stack.append("]" if c == "[" else "}")
            elif c in "]}":
                if stack[-1] != c:
                    end = "wrong"
                    break
                stack.pop()
                if not stack:
                    end = k + 1
                    break
        if end == "out":
            return out
        if end == "wrong":
            i += 1
        else:
            out.append((i, end))
            i = end
    return out


def test_spans_equal_a_plain_scan():
    draw = random.Random(5)
    for _ in range(20_000):
        text = "".join(draw.choice('[]{}"\\ a,') for _ in range(draw.randint(0, 24)))
        assert list(j.balanced_spans(text)) == plain_spans(text), text


def test_deep_and_long_texts_are_scanned_once():
    deep = "[" * 200_000 + "}"
    assert list(j.balanced_spans(deep)) == []
    assert j.find_value("[" * 200_000 + "]" * 200_000)[0] == "none"
    text = "{" + "x" * 3_000_000 + "} " + json.dumps({"a": "y" * 3_000_000})
    assert j.find_value(text) == ("span", {"a": "y" * 3_000_000})


@pytest.mark.parametrize(
    ("text", "how", "value"),
    [
        ('{"a": 1}', "whole", {"a": 1}),
        ('```json\n{"a": 1}\n```', "whole", {"a": 1}),
        ('```json {"a": 1} ```', "whole", {"a": 1}),
        ('int f() { return x[0]; } so: {"a": "}"}', "span", {"a": "}"}),
        ('{"alignment":"aligned","findings":["one","two"],"conclusion":"cut off', "closed", {"alignment": "aligned", "findings": ["one", "two"], "conclusion": "cut off"}),
        ('{"a": [1, 2,', "closed", {"a": [1, 2]}),
        ('{"a": {"b":', "closed", {"a": {"b": None}}),
        ('{"a": "x\\', "closed", {"a": "x"}),
        ('{"a": "x\\\\', "closed", {"a": "x\\"}),
        ('{"a": ", ]", "b": [1,', "closed", {"a": ", ]", "b": [1]}),
        (r'{"a": "\d+"}', "whole", {"a": r"\d+"}),
        ('{"a": "x\x01y"}', "whole", {"a": "xy"}),
        ("no json", "none", None),
        ("", "none", None),
        ("} ] text", "none", None),
    ],
)
def test_values(text, how, value):
    assert j.find_value(text) == (how, value)


def test_answers_between_tags():
    row = j.read_answer('<thinking>{"x": 1}</thinking><answer>{"id": "H1"}</answer>')
    assert row[:3] == ("answer_tag", True, "whole") and json.loads(row[4]) == {"id": "H1"}
    # the last complete tag counts, spellings of tags vary
    assert json.loads(j.read_answer('<answer>{"a": 1}</answer> or < ANSWER >{"a": 2}</ answer > <answer>{"a": 3')[4]) == {"a": 2}
    cut = j.read_answer('<thinking>x</thinking><answer>{"risk_hypotheses": []')
    assert cut[0] == "bare" and cut[2] == "closed" and cut[5] == ["answer tag is not complete"]
    assert j.read_answer('{"thinking": "t", "answer": {"a": 1}}')[0] == "json_key_answer"
    assert j.read_answer('{"thinking": "t", "answer": "{\\"a\\": 1}"}')[4] == '{"a":1}'
    assert j.read_answer("[1, 2]")[:4] == ("none", False, "whole", "array")
    assert j.read_answer('{"a": "\\ud800"}')[4].isascii()


def test_fields_have_one_spelling():
    notes = []
    value = {
        "decision_status": "Safe", "is_vulnerable": False, "primary_vulnerability_type": "x", "vuln_statements": [1], "upload": {"verdict": "N/A"},
        "kg_queries": [{"type": "callee_summary", "scope": "parse_it", "match_type": "exact", "query": "bundle"}, {"query_type": "Macro_Definition_Bundle", "symbol": "MAX", "scope": "repo"}, {"query_type": "caller", "scope": "project", "query": "q"}],
    }
    got = j.normalize_fields(value, notes)
    assert got["decision_status"] == "non_vulnerable" and got["primary_vulnerability_type"] is None and got["vuln_statements"] == [] and got["upload"]["verdict"] == "unresolved"
    assert got["kg_queries"] == [
        {"scope": "target_function", "query": "callee_summary_bundle", "query_type": "evidence_bundle", "match": "exact", "bundle_type": "callee_summary_bundle"},
        {"query_type": "evidence_bundle", "symbol": "MAX", "scope": "project", "bundle_type": "global_state_bundle", "query": "MAX"},
        {"query_type": "caller", "scope": "project", "query": "q"},
    ]
    assert any("decision_status" in n for n in notes)
    assert j.normalize_fields({"is_vulnerable": False, "decision_status": "vuln", "unresolved_hypotheses": [1]}, [])["decision_status"] == "inconclusive"


def test_column(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, 'x {"a": 1} y')], "id int, text string")
    got = {r["id"]: r["a"] for r in rows.select("id", j.answer(rows["text"]).alias("a")).collect()}
    assert got[1]["source"] == got[2]["source"] == "none" and got[3]["value"] == '{"a":1}' and got[3]["how"] == "span"
