"""JSON inside free text: balanced spans, repair of cut-off values, answers between tags, and spellings of their fields."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER = "source string, thinking boolean, how string, kind string, value string, notes array<string>"

_STRING = r'"(?:[^"\\]++|\\.)*+("?)'
_MARK = re.compile(_STRING + r"|[\[\]{}]", re.S)
_OPENER = re.compile(r"[\[{]")
_LAST_COMMA = re.compile(rf"(?P<string>{_STRING})|,\s*(?=[}}\]])", re.S)
_ESCAPE = re.compile(r'\\(["\\/bfnrtu])|\\')
_CONTROL = re.compile(r"[\x00-\x08\x0B-\x1F]")
_FENCE = re.compile(r"```\w*\s*(.*?)\s*(?:```)?\s*", re.S)
_TAG = re.compile(r"<\s*(/?)\s*(thinking|answer)(?:\s*|\b[^>]*)>", re.I)
_CLOSER = {"[": "]", "{": "}"}
_WRONG, _RUNS_OUT = -1, -2

#: Spellings of the fields of an answer.
STATUSES = {
    "safe": "non_vulnerable", "not_vulnerable": "non_vulnerable", "non_vulnerable": "non_vulnerable", "vuln": "vulnerable", "vulnerable_confirmed": "vulnerable",
    "unknown": "inconclusive", "uncertain": "inconclusive", "needs_more_evidence": "inconclusive",
}
VERDICTS = {"not_present": "unresolved", "absent": "unresolved", "none": "unresolved", "n/a": "unresolved", "n_a": "unresolved", "na": "unresolved", "not_applicable": "unresolved"}
SCOPES = {
    "target": "target_function", "target function": "target_function", "target-function": "target_function", "function_under_test": "target_function", "current_function": "target_function",
    "adminchild": "target_function", "repo": "project", "repository": "project", "project_global": "global",
}
SCOPE_NAMES = ("target_function", "project", "global", "callee", "caller")
BUNDLES = ("buffer_write", "input_validation", "callee_summary", "global_state", "macro_definition", "global_definition", "integer_overflow", "format_string", "path_traversal", "lifetime_ownership", "caller_input")
BUNDLE_OF = {"macro_definition": "global_state", "global_definition": "global_state"}
QUERY_TYPES = ("evidence_bundle", "guard_dominance", "callee", "caller", "safety", "risk", "statement", "variable", "type", "global", "search")
RENAMED = {"continue_": "continue", "type": "query_type", "match_type": "match"}


def _follow(text: str, start: int, ends: dict[int, int]) -> None:
    # one pass with a stack; each opener is pushed once in all passes, since where it ends does not depend on what lies before it
    stack: list[int] = []
    at, outcome = start, _RUNS_OUT
    while mark := _MARK.search(text, at):
        place, at = mark.start(), mark.end()
        char = text[place]
        if char in _CLOSER:
            known = ends.get(place)
            if known is None:
                stack.append(place)
            elif known < 0:
                outcome = known
                break
            else:
                at = known
        elif char != '"':
            if _CLOSER[text[stack[-1]]] != char:
                outcome = _WRONG
                break
            ends[stack.pop()] = at
            if not stack:
                return
    ends.update(dict.fromkeys(stack, outcome))


def balanced_spans(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of objects and arrays whose brackets match, outermost first, left to right; brackets in their strings do not count.

    An opener that meets a wrong closer is skipped and the search goes on behind it; one that meets none ends the search.
    """
    ends: dict[int, int] = {}
    at = 0
    while opener := _OPENER.search(text, at):
        start = opener.start()
        if start not in ends:
            _follow(text, start, ends)
        end = ends[start]
        if end == _RUNS_OUT:
            return
        if end == _WRONG:
            at = start + 1
        else:
            yield start, end
            at = end


def close_cut(text: str) -> str | None:
    """Text from its first opener on, with an open string, a field without value and open brackets closed, and commas before closers dropped; None without an opener."""
    opener = _OPENER.search(text)
    if opener is None:
        return None
    stack, in_string = [], False
    for mark in _MARK.finditer(text, opener.start()):
        char = mark[0][0]
        if char in _CLOSER:
            stack.append(_CLOSER[char])
        elif char == '"':
            in_string = not mark[1]
        elif stack:
            stack.pop()
    body = text[opener.start() :].rstrip()
    if in_string:
        slashes = len(body) - len(body.rstrip("\\"))
        body = (body[:-1] if slashes % 2 else body) + '"'
    elif body.endswith(":"):
        body += " null"
    elif body.endswith(","):
        body = body[:-1]
    return _LAST_COMMA.sub(lambda m: m["string"] or "", body + "".join(reversed(stack)))


def unfence(text: str) -> str:
    """Text without the code fence around it."""
    text = text.strip()
    fence = _FENCE.fullmatch(text) if text.startswith("```") else None
    return fence[1] if fence and "```" not in fence[1] else text


def _load(text: str) -> Any:
    """The value of JSON text, of its form with stray backslashes doubled, or of that without control characters; ValueError if none can be read."""
    escaped = _ESCAPE.sub(lambda m: m[0] if m[1] else r"\\", text)
    for form in dict.fromkeys((text, escaped, _CONTROL.sub("", escaped))):
        try:
            return json.loads(form)
        except (ValueError, RecursionError):
            continue
    raise ValueError("no JSON")


def find_value(text: str) -> tuple[str, Any]:
    """(how, value): the `whole` text, the first balanced `span` that can be read, or the `closed` rest of a cut-off text; ("none", None) if all fail."""
    text = unfence(text)
    try:
        return "whole", _load(text)
    except ValueError:
        pass
    for start, end in balanced_spans(text):
        try:
            return "span", _load(text[start:end])
        except ValueError:
            continue
    closed = close_cut(text)
    try:
        return ("closed", _load(closed)) if closed else ("none", None)
    except ValueError:
        return "none", None


def tagged_part(text: str) -> tuple[str | None, bool, bool]:
    """(payload, found, thinking): what the last complete answer tag holds, if one is complete; whether one was opened; whether a thinking tag is complete."""
    opened: dict[str, list[int]] = {"answer": [], "thinking": []}
    payload, thinking, closed = None, False, 0
    for tag in _TAG.finditer(text):
        name = tag[2].lower()
        if not tag[1]:
            opened[name].append(tag.end())
        elif name == "thinking":
            thinking = thinking or bool(opened[name])
        else:
            # the latest tag opened since the last close is the one that this closes
            inner = [p for p in opened[name][-1:] if p > closed]
            if inner:
                payload = text[inner[0] : tag.start()].strip()
            closed = tag.end()
    return payload, bool(opened["answer"]), thinking


def _slug(value: str) -> str:
    return re.sub(r"[^a-z0-9_]+", "_", value.strip().lower()).strip("_")


def _query(fields: dict[str, Any], notes: list[str], path: str) -> None:
    kind = _slug(fields["query_type"]) if isinstance(fields.get("query_type"), str) else None
    if kind is not None:
        bundle = kind.removesuffix("_bundle")
        if bundle in BUNDLES:
            named = f"{BUNDLE_OF.get(bundle, bundle)}_bundle"
            asked = re.sub(r"\s+", "_", str(fields.get("query") or "").strip().lower())
            fields.setdefault("bundle_type", named)
            # a query that only repeats its type asks for nothing
            if asked in ("", "bundle", "evidence_bundle", kind):
                fields["query"] = fields.get("symbol") or named
            fields["query_type"] = "evidence_bundle"
            notes.append(f"{path}: query_type {kind} is evidence_bundle of {named}")
        elif kind not in QUERY_TYPES:
            fields["query_type"] = kind
    scope = fields.get("scope")
    if isinstance(scope, str):
        plain = re.sub(r"\s+", " ", scope.strip().lower())
        bare = re.fullmatch(r"[A-Za-z_]\w*", scope) and plain not in SCOPE_NAMES
        known = SCOPES.get(plain) or ("target_function" if bare else None)
        if known:
            fields["scope"] = known
            notes.append(f"{path}: scope {scope} is {known}")


def normalize_fields(value: Any, notes: list[str], path: str = "$") -> Any:
    """The value with known spellings of its fields and their values made one, at any depth; each change is noted.

    What is said to be no vulnerability has no vulnerability type and no vulnerable statements.
    """
    if isinstance(value, list):
        return [normalize_fields(v, notes, f"{path}[{i}]") for i, v in enumerate(value)]
    if not isinstance(value, dict):
        return value
    fields = dict(value)
    is_query = "query_type" in fields or "type" in fields
    for old, new in RENAMED.items():
        if old in fields and new not in fields and (is_query or old == "continue_"):
            fields[new] = fields.pop(old)
            notes.append(f"{path}: {old} is {new}")
    for field, known in (("decision_status", STATUSES), ("verdict", VERDICTS)):
        said = fields.get(field)
        meant = (known.get(_slug(said)) or known.get(said.strip().lower())) if isinstance(said, str) else None
        if meant:
            fields[field] = meant
            notes.append(f"{path}: {field} {said} is {meant}")
    if fields.get("is_vulnerable") is False:
        status = "inconclusive" if fields.get("unresolved_hypotheses") else "non_vulnerable"
        wrong = {"primary_vulnerability_type": None} if fields.get("primary_vulnerability_type") is not None else {}
        wrong |= {"vuln_statements": []} if fields.get("vuln_statements") else {}
        wrong |= {"decision_status": status} if fields.get("decision_status") == "vulnerable" else {}
        notes.extend(f"{path}: {field} contradicts is_vulnerable=false" for field in wrong)
        fields |= wrong
    fields = {k: normalize_fields(v, notes, f"{path}.{k}") for k, v in fields.items()}
    if is_query:
        _query(fields, notes, path)
    return fields


def _text(value: Any) -> str:
    out = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    # half a surrogate pair is no character of a Spark string
    return out if out.isascii() or not re.search(r"[\ud800-\udfff]", out) else json.dumps(value, separators=(",", ":"))


def read_answer(text: str) -> tuple[str, bool, str, str | None, str | None, list[str]]:
    """A row of ANSWER: where the object of an answer stands (`answer_tag`, `json_key_answer`, `bare`), how it was read, and its normal form.

    Places are tried in that order, the first that holds an object counts; without one, source is `none`.
    """
    payload, found, thinking = tagged_part(text)
    tries = [("answer_tag", find_value(payload))] if payload is not None else []
    how, value = find_value(text)
    if isinstance(value, dict) and "answer" in value:
        inner = value["answer"]
        tries.append(("json_key_answer", find_value(inner) if isinstance(inner, str) else (how, inner)))
    tries.append(("bare", (how, value)))
    for source, (read, result) in tries:
        if isinstance(result, dict):
            notes = ["answer tag is not complete"] if found and payload is None else []
            try:
                return source, thinking, read, "object", _text(normalize_fields(result, notes)), notes
            except RecursionError:
                continue
    return "none", thinking, how, {list: "array", dict: "object"}.get(type(value), None if how == "none" else "scalar"), None, []


def _answers(texts: pd.Series) -> pd.DataFrame:
    rows = [read_answer(t) if isinstance(t, str) else ("none", False, "none", None, None, []) for t in texts]
    return pd.DataFrame(rows, columns=["source", "thinking", "how", "kind", "value", "notes"])


def answer(text: Column) -> Column:
    """read_answer of each text, whole; a null text holds no answer. Texts go to Python in Arrow batches and each is scanned in linear time but for spans that fail to parse."""
    return F.pandas_udf(_answers, ANSWER)(text)
