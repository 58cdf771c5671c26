"""Source code to property graph.

One Python pass per file turns text into flat rows of what stands where (functions, parameters, statements, names used,
calls, members, literals, comments). Everything that relates rows to each other is done with joins and windows: scopes,
definitions and uses, calls across files, fields by type, control order and facts.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.functions.rules import statement_rules
from arborlake.functions.text import NOT_CALLS, STATEMENT_KINDS
from arborlake.operators.graph import Graph, edge_id
from arborlake.session import checkpoint

#: Which files are source, and what is passed over.
EXTENSIONS = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx")
SKIP_FOLDERS = (".git", ".hg", ".svn", ".idea", ".vscode", "__pycache__", "node_modules", "build", "dist", "cmake-build-debug", "cmake-build-release", ".venv", "venv")
SKIP_SUFFIXES = (".min.js", ".map")
MAX_BYTES = 5_000_000
BUILTIN_TYPES = (
    "void", "char", "int", "float", "double", "bool", "size_t", "ssize_t", "FILE", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "int8_t", "int16_t", "int32_t", "int64_t",
    "uintptr_t", "intptr_t",
)
QUALIFIERS = ("const", "static", "extern", "volatile", "register", "auto", "inline", "restrict", "signed", "unsigned", "long", "short", "struct", "enum", "union")

ROW = "file string, function string, fn_line int, kind string, name string, type string, line int, line_end int, code string, idx int, ord int, flag string"
_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_]\w*|\d[\w.]*|->|\+\+|--|[-+*/%&|^<>=!]=|<<|>>|&&|\|\||\S", re.S)
_KINDS = [(kind, re.compile(pattern)) for kind, pattern in STATEMENT_KINDS]
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(include|define)[ \t]*([^\n]*(?:\\\n[^\n]*)*)", re.M)


def scan_tree(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, skipped): source files (path, text) under a folder, and (path, reason) of what is passed over.

    Bytes that are not UTF-8 come as replacement characters, and a file of no source suffix is in neither. A file above
    max_bytes is passed over by its size, before its content is asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    suffix = F.lower(F.concat(F.lit("."), F.element_at(F.split(path, r"\."), -1)))
    reason = (
        F.when(F.arrays_overlap(folders, F.array(*map(F.lit, SKIP_FOLDERS))), "inside skipped folder")
        .when(reduce(lambda a, b: a | b, [path.endswith(s) for s in SKIP_SUFFIXES]), "skipped suffix")
        .when(~suffix.isin(*EXTENSIONS), "no source").when(F.col("length") > max_bytes, "too large")
    )
    small = files.where(F.col("length") <= max_bytes).select(path.alias("path"), reason.alias("reason"), "content")
    kept = small.where("reason IS NULL").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")).orderBy(F.lower("path"), "path")
    rows = files.select(path.alias("path"), reason.alias("reason"))
    return kept, rows.where("reason IS NOT NULL AND reason <> 'no source'").select("path", "reason")


class _File:
    """Tokens of a file with positions, brackets matched."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        blank = lambda m: re.sub(r"[^\n]", " ", m.group())
        self.directives = [(m.group(1), m.group(2), self.line(m.start())) for m in _DIRECTIVE.finditer(text)]
        bare = re.sub(r"^[ \t]*#[^\n]*(?:\\\n[^\n]*)*", blank, text, flags=re.M)
        every = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(bare)]
        self.comments = [t for t in every if t[0].startswith(("//", "/*"))]
        self.tokens = [t for t in every if not t[0].startswith(("//", "/*"))]
        self.close, stack = {}, []
        for i, (t, _, _) in enumerate(self.tokens):
            if t in "({[":
                stack.append(i)
            elif t in ")}]":
                # a closer takes the nearest opener of its kind, so stray ones do little harm
                for at in range(len(stack) - 1, -1, -1):
                    if self.tokens[stack[at]][0] + t in ("()", "{}", "[]"):
                        self.close[stack[at]] = i
                        del stack[at:]
                        break

    def line(self, position: int) -> int:
        return bisect.bisect_right(self.starts, position)

    def code(self, a: int, b: int) -> str:
        return self.text[self.tokens[a][1] : self.tokens[b - 1][2]] if b > a else ""


def _declarators(f: _File, a: int, b: int) -> list[tuple[str, str]]:
    """(name, type) declared by tokens a..b, empty if they are no declaration."""
    words = [t for t, _, _ in f.tokens[a:b]]
    if len(words) < 2 or words[0] in ("return", "if", "for", "while", "switch", "case", "goto", "else", "do", "typedef", "break", "continue"):
        return []
    n, base = 0, []
    while n < len(words) and (words[n] in QUALIFIERS or words[n] in BUILTIN_TYPES or (not base or all(x in QUALIFIERS for x in base)) and re.match(r"[A-Za-z_]\w*$", words[n])):
        base.append(words[n])
        n += 1
    known = any(x in BUILTIN_TYPES or x in QUALIFIERS for x in base) or (base and base[-1][:1].isupper())
    if not base or not known or n >= len(words) or not re.match(r"[*A-Za-z_]", words[n]):
        return []
    out, depth, part = [], 0, []
    for t in [*words[n:], ","]:
        if t == "," and depth == 0:
            head = part[: part.index("=")] if "=" in part else part
            stars = sum(x == "*" for x in head)
            names = [x for x in head if re.match(r"[A-Za-z_]\w*$", x)]
            if names and "(" not in head:
                out.append((names[0], " ".join(base) + " *" * min(stars, 1) * bool(stars)))
            part = []
            continue
        depth += (t in "([{") - (t in ")]}")
        part.append(t)
    return out


def _parameters(f: _File, a: int, b: int) -> list[tuple[str, str, str]]:
    """(name, type, code) of the parameters between two brackets."""
    parts, depth, start = [], 0, a
    for i in range(a, b + 1):
        t = f.tokens[i][0] if i < b else ","
        if t == "," and depth == 0:
            if i > start:
                parts.append((start, i))
            start = i + 1
        depth += (t in "([<") - (t in ")]>")
    out = []
    for n, (x, y) in enumerate(parts):
        words = [t for t, _, _ in f.tokens[x:y]]
        if words == ["void"]:
            continue
        words = words[: words.index("=")] if "=" in words else words
        if "(" in words and "*" in words[words.index("(") :]:
            name = next((w for w in words[words.index("(") :] if re.match(r"[A-Za-z_]", w)), f"param_{n}")
        else:
            flat = words[: words.index("[")] if "[" in words else words
            names = [w for w in flat if re.match(r"[A-Za-z_]\w*$", w)]
            name = names[-1] if len(names) > 1 else f"param_{n}"
        out.append((name, " ".join(w for w in words if w != name), f.code(x, y)))
    return out


def kind_of(code: str) -> str:
    """Kind of a statement by the patterns that statement_kind uses."""
    return next((kind for kind, pattern in _KINDS if pattern.search(code.strip())), "Statement")


def parse(path: str, text: str) -> list[tuple]:
    """Rows of what stands in one file."""
    f, rows = _File(text), []

    def add(kind, name=None, line=None, function=None, type_=None, line_end=None, code=None, idx=None, ord_=None, flag=None, fn_line=None):
        rows.append((path, function, fn_line, kind, name, type_, line, line_end or line, code, idx, ord_, flag))

    for what, body, line in f.directives:
        if what == "include" and (m := re.match(r'[<"]([^>"]+)[>"]', body)):
            add("Include", m.group(1).strip(), line, code=body.strip())
        elif what == "define" and (m := re.match(r"([A-Za-z_]\w*)(.*)", body, re.S)):
            add("Macro", m.group(1), line, code=re.sub(r"\\\n", " ", m.group(2)).strip())
    for i, (t, a, b) in enumerate(f.comments):
        add("Comment", line=f.line(a), line_end=f.line(b), code=t, ord_=i)
    at, begin, tokens = 0, 0, f.tokens
    while at < len(tokens):
        t = tokens[at][0]
        if t == "{" and at in f.close:
            end = f.close[at]
            head = [w for w, _, _ in tokens[begin:at]]
            kind = next((w for w in head if w in ("struct", "class", "union", "enum")), None)
            if ")" in head and head[-1] != "=" and (name := _function_name(head)):
                _function(f, add, begin, at, end, name)
            elif kind and "(" not in head:
                names = [w for w in head[head.index(kind) + 1 :] if re.match(r"[A-Za-z_]\w*$", w)]
                name = names[0] if names else next((tokens[j][0] for j in range(end + 1, min(end + 2, len(tokens))) if re.match(r"[A-Za-z_]", tokens[j][0])), f"anonymous_{kind}_{tokens[at][1]}")
                add("Struct/Class" if kind != "enum" else "Type", name, f.line(tokens[begin][1]), line_end=f.line(tokens[end][1]), type_=kind, code=f.code(begin, end + 1)[:2000])
                if kind != "enum":
                    for x, y in _split(f, at + 1, end):
                        for n, typ in _declarators(f, x, y):
                            add("Field", n, f.line(tokens[x][1]), type_=typ, code=f.code(x, y), flag=name)
            elif head[:1] in (["extern"], ["namespace"]):
                at, begin = at + 1, at + 1
                continue
            at = end + 1
            if not (kind and at < len(tokens) and tokens[at][0] != ";"):
                begin = at
            continue
        if t == ";":
            if begin < at and "(" not in [w for w, _, _ in tokens[begin:at]]:
                for n, typ in _declarators(f, begin, at):
                    add("GlobalVariable", n, f.line(tokens[begin][1]), type_=typ, code=f.code(begin, at))
            begin = at + 1
        elif t == "}":
            begin = at + 1
        at += 1
    return rows


def _function_name(head: list[str]) -> str | None:
    depth = 0
    for i in range(len(head) - 1, 0, -1):
        depth += (head[i] == ")") - (head[i] == "(")
        if head[i] == "(" and depth == 0:
            name = head[i - 1]
            return name if re.match(r"[A-Za-z_]\w*$", name) and name not in NOT_CALLS else None
    return None


def _split(f: _File, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Token ranges of statements: up to a semicolon outside brackets, a brace, or the bracket that ends a control header."""
    start = a
    i = a
    while i < b:
        t = f.tokens[i][0]
        if t in "([" and i in f.close:
            header = [w for w, _, _ in f.tokens[start:i]]
            i = f.close[i]
            if header in (["if"], ["else", "if"], ["for"], ["while"], ["switch"]):
                yield start, i + 1
                start = i + 1
        elif t in "{};":
            if i > start:
                yield start, i
            start = i + 1
        i += 1
    if b > start:
        yield start, b


def _function(f: _File, add, begin: int, brace: int, end: int, name: str) -> None:
    tokens = f.tokens
    line = f.line(tokens[begin][1])
    opening = max(i for i in range(begin, brace) if tokens[i][0] == "(" and i - 1 >= begin and tokens[i - 1][0] == name)
    add("Function", name, line, line_end=f.line(tokens[end][1]), type_=f.code(begin, opening - 1) or "unknown", code=re.sub(r"\s+", " ", f.code(begin, brace)), fn_line=line, function=name)
    for i, (n, typ, code) in enumerate(_parameters(f, opening + 1, f.close.get(opening, brace))):
        add("FunctionParameter", n, line, function=name, type_=typ, code=code, ord_=i, fn_line=line)
    for idx, (a, b) in enumerate(_split(f, brace + 1, end)):
        words = [t for t, _, _ in tokens[a:b]]
        here = {"function": name, "line": f.line(tokens[a][1]), "line_end": f.line(tokens[b - 1][1]), "idx": idx, "fn_line": line}
        add("Statement", type_=kind_of(f.code(a, b)), code=f.code(a, b), **here)
        declared = _declarators(f, a, b)
        for i, (n, typ) in enumerate(declared):
            add("LocalVariable", n, type_=typ, code=f.code(a, b), ord_=i, **here)
        # a comparison also counts as an assignment, and so do the compound forms
        if not declared and len(words) > 1 and re.match(r"[A-Za-z_]\w*$", words[0]) and words[1].endswith("=") and words[1] not in ("<=", ">=", "!="):
            add("Assigned", words[0], **here)
        first_equals = words.index("=") if "=" in words else len(words)
        members = set()
        for i in range(1, len(words) - 1):
            if words[i] in ("->", ".") and re.match(r"[A-Za-z_]", words[i - 1]) and re.match(r"[A-Za-z_]", words[i + 1]):
                members.add(i + 1)
                add("Member", words[i + 1], type_=words[i - 1], ord_=i, flag="lhs" if i - 1 < first_equals < len(words) else "rhs", **here)
        for w in sorted({w for i, w in enumerate(words) if re.match(r"[A-Za-z_]\w*$", w) and i not in members}):
            add("Used", w, **here)
        for w in sorted({words[i] for i in members}):
            add("MemberName", w, **here)
        calls = [words[i] for i in range(len(words) - 1) if words[i + 1] == "(" and re.match(r"[A-Za-z_]\w*$", words[i]) and words[i] not in NOT_CALLS]
        for i, w in enumerate(calls):
            add("CallExpression", w, code=f.code(a, b), ord_=i, **here)
        for i, w in enumerate([w for w in words if w[0] in "\"'" or w[0].isdigit()]):
            add("Literal", w[:50], code=w, ord_=i, **here)


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of all files (path, text). A file that is null or has no code gives no row."""
    columns = [c.split(" ")[0] for c in ROW.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for path, text in zip(frame["path"], frame["text"], strict=True) if text for r in parse(path, text)]
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int32" for c in ("fn_line", "line", "line_end", "idx", "ord")})

    return files.select("path", "text").mapInPandas(run, ROW)


def _id(kind: str, *parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


def canonical(type_: Column) -> Column:
    """The last word of a type without qualifiers and stars."""
    plain = F.regexp_replace(type_, r"\b(const|volatile|restrict|static|extern|register|signed|unsigned|struct|class|union|enum)\b|[*&]", " ")
    return F.element_at(F.split(F.trim(F.regexp_replace(plain, r"\s+", " ")), " "), -1)


def build_graph(files: DataFrame, project: str = "project") -> Graph:
    """The property graph of all files.

    Names resolve to the last declaration of the same function at or before the line, else to a parameter; then to a
    global, unless a visible name or a member of that spelling hides it. Calls resolve to a variable, to the first
    function of that name, or to an outside stub.
    """
    rows = checkpoint(parse_files(files))
    of = lambda kind: rows.where(F.col("kind") == kind)
    f = lambda *c: [F.col(x) for x in c]
    file_id, fn_id = _id("file", F.col("file")), _id("function", *f("file", "function", "fn_line"))
    stmt_id = _id("statement", *f("file", "function", "fn_line", "idx"))
    scope = ["file", "function", "fn_line"]
    node = lambda df, id_, kind, label, name="name", code="code": df.select(
        id_.alias("id"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), label.alias("label"), F.col(name).alias("name"), "file", "function",
        F.col("line").alias("line_start"), "line_end", F.col(code).alias("code"), F.lit(True).alias("defined"),
    )
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("type"))
    simple = {"Include": "FILE_INCLUDES_FILE", "Macro": "FILE_HAS_MACRO", "Struct/Class": "FILE_HAS_TYPE", "Type": "FILE_HAS_TYPE", "GlobalVariable": "FILE_HAS_GLOBAL"}
    nodes, edges = [], []
    every = files.select(F.col("path").alias("file")).distinct().withColumns({"name": F.col("file"), "function": F.lit(None).cast("string"), "line": F.lit(1), "line_end": F.lit(None).cast("int"), "code": F.lit(None).cast("string")})
    root = _id("project", F.lit(project))
    nodes.append(node(every, file_id, "File", F.col("file")))
    nodes.append(node(every.limit(1).withColumns({"name": F.lit(project), "file": F.lit(None).cast("string")}), root, "Project", F.lit(project)))
    edges.append(edge(every, root, file_id, "PROJECT_HAS_FILE"))
    for kind, link in simple.items():
        own = _id(kind, *f("file", "name", "line"))
        nodes.append(node(of(kind), own, kind, F.col("name")))
        edges.append(edge(of(kind), file_id, own, link))
    type_id = lambda name, file="file": _id("Struct/Class", F.col(file), F.col(name), F.col("type_line"))
    types = of("Struct/Class").groupBy("name").agg(F.min_by(_id("Struct/Class", *f("file", "name", "line")), F.struct("file", "line")).alias("type_node"))
    owners = of("Struct/Class").groupBy("file", F.col("name").alias("flag")).agg(F.min("line").alias("type_line"))
    field_id = _id("Field", *f("file", "flag", "name", "line"))
    fields = of("Field").join(owners, ["file", "flag"])
    nodes.append(node(of("Field"), field_id, "Field", F.concat_ws(".", "flag", "name")))
    for link in ("TYPE_HAS_FIELD", "AST_CHILD"):
        edges.append(edge(fields, type_id("flag"), field_id, link))
    comment_id = _id("Comment", *f("file", "line", "ord"))
    nodes.append(node(of("Comment"), comment_id, "Comment", F.substring("code", 1, 60)))
    functions = of("Function")
    nodes.append(node(functions, fn_id, "Function", F.col("name")))
    edges.append(edge(functions, file_id, fn_id, "FILE_HAS_FUNCTION"))
    param_id = _id("parameter", *f("file", "function", "fn_line", "name", "ord"))
    local_id = _id("local", *f("file", "function", "fn_line", "name", "idx"))
    nodes.append(node(of("FunctionParameter"), param_id, "FunctionParameter", F.col("name")))
    nodes.append(node(of("LocalVariable"), local_id, "LocalVariable", F.col("name")))
    for link in ("FUNCTION_HAS_PARAMETER", "AST_CHILD"):
        edges.append(edge(of("FunctionParameter"), fn_id, param_id, link))
    edges.append(edge(of("LocalVariable"), fn_id, local_id, "FUNCTION_HAS_LOCAL"))
    statements = of("Statement")
    nodes.append(node(statements, stmt_id, F.col("type"), F.concat(F.col("type"), F.lit("@"), F.col("line").cast("string"))))
    for link in ("FUNCTION_HAS_STATEMENT", "AST_CHILD"):
        edges.append(edge(statements, fn_id, stmt_id, link))
    edges.append(edge(statements.where("type = 'ReturnStatement'"), fn_id, stmt_id, "RETURNS"))
    edges.append(edge(statements.where("type IN ('Condition', 'Loop')"), stmt_id, fn_id, "CONTROLS"))
    in_order = Window.partitionBy(*scope).orderBy("idx")
    edges.append(edge(statements.withColumn("before", F.lag(stmt_id).over(in_order)).where("before IS NOT NULL"), F.col("before"), stmt_id, "CFG_NEXT"))

    # names in scope
    params = of("FunctionParameter").groupBy(*scope, "name").agg(F.min_by(F.struct(param_id.alias("id"), F.col("type").alias("var_type")), "ord").alias("param"))
    locals_ = of("LocalVariable").select(*scope, "name", F.col("line").alias("decl_line"), F.col("idx").alias("decl_idx"), local_id.alias("local_id"), F.col("type").alias("local_type"))

    def resolve(uses: DataFrame) -> DataFrame:
        """uses (scope, idx, line, name) with var_id and var_type, null if no name of the function is visible there."""
        keyed = uses.withColumn("_row", F.monotonically_increasing_id())
        seen = keyed.select("_row", *scope, "name", "line").join(locals_, [*scope, "name"]).where("decl_line <= line")
        best = seen.groupBy("_row").agg(F.max_by(F.struct(F.col("local_id").alias("id"), F.col("local_type").alias("var_type")), F.struct("decl_line", "decl_idx")).alias("local"))
        out = keyed.join(best, "_row", "left").join(params, [*scope, "name"], "left")
        return out.withColumn("var", F.coalesce("local", "param")).withColumns({"var_id": F.col("var.id"), "var_type": F.col("var.var_type")}).drop("_row", "local", "param", "var")

    typed = of("LocalVariable").select(local_id.alias("id"), canonical(F.col("type")).alias("name")).unionByName(of("FunctionParameter").select(param_id.alias("id"), canonical(F.col("type")).alias("name")))
    edges.append(edge(typed.join(types, "name"), F.col("id"), F.col("type_node"), "HAS_TYPE"))
    globals_ = of("GlobalVariable").groupBy("name").agg(F.min_by(_id("GlobalVariable", *f("file", "name", "line")), F.struct("file", "line")).alias("global_id"))
    assigned = checkpoint(resolve(of("Assigned").select(*scope, "idx", "line", "name")))
    declared = of("LocalVariable").select(*scope, "idx", local_id.alias("var_id"))
    defines = assigned.where("var_id IS NOT NULL").select(*scope, "idx", "var_id").unionByName(declared).distinct()
    edges.append(edge(defines, stmt_id, F.col("var_id"), "DEFINES_VARIABLE"))
    edges.append(edge(assigned.where("var_id IS NULL").join(globals_, "name"), stmt_id, F.col("global_id"), "DEFINES_GLOBAL"))
    used = checkpoint(resolve(of("Used").select(*scope, "idx", "line", "name")))
    uses = used.where("var_id IS NOT NULL").select(*scope, "idx", "var_id")
    edges.append(edge(uses, stmt_id, F.col("var_id"), "USES_VARIABLE"))
    both = uses.withColumn("u", F.lit(True)).join(defines.withColumn("d", F.lit(True)), [*scope, "idx", "var_id"], "full")
    frame = Window.partitionBy(*scope, "var_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    linked = both.withColumn("last", F.last(F.when(F.col("d"), F.col("idx")), ignorenulls=True).over(frame)).where("u AND last IS NOT NULL AND last <> idx")
    last_id = _id("statement", *f("file", "function", "fn_line", "last"))
    edges += [edge(linked, last_id, stmt_id, "DEF_USE"), edge(linked, stmt_id, last_id, "DATA_DEPENDS_ON")]
    hidden = of("MemberName").select(*scope, "idx", "name")
    plain = used.where("var_id IS NULL").join(hidden, [*scope, "idx", "name"], "left_anti")
    edges.append(edge(plain.join(globals_, "name"), stmt_id, F.col("global_id"), "USES_GLOBAL"))

    # members: by the type of what they belong to, else by a name that only one field has
    members = resolve(of("Member").select(*scope, "idx", "line", F.col("name").alias("field"), F.col("type").alias("name"), "flag"))
    by_type = of("Field").groupBy(F.col("flag").alias("owner"), F.col("name").alias("field")).agg(F.min_by(field_id, F.struct("file", "line")).alias("typed_field"))
    only = of("Field").groupBy(F.col("name").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.min(field_id).alias("only_field")).where("n = 1").drop("n")
    members = members.withColumn("owner", canonical(F.col("var_type"))).join(by_type, ["owner", "field"], "left").join(only, "field", "left").withColumn("target", F.coalesce("typed_field", "only_field")).where("target IS NOT NULL")
    edges.append(edge(members, stmt_id, F.col("target"), F.when(F.col("flag") == "lhs", "DEFINES_FIELD").otherwise("USES_FIELD")))
    edges.append(edge(members.where("var_id IS NOT NULL"), F.col("var_id"), F.col("target"), "ACCESSES_FIELD"))

    # calls
    call_id = _id("call", *f("file", "function", "fn_line", "idx", "ord"))
    nodes.append(node(of("CallExpression"), call_id, "CallExpression", F.col("name")))
    for link in ("AST_CHILD", "STATEMENT_CALLS"):
        edges.append(edge(of("CallExpression"), stmt_id, call_id, link))
    first = functions.groupBy("name").agg(F.min_by(fn_id, F.struct("file", "line")).alias("callee"))
    calls = checkpoint(resolve(of("CallExpression").select(*scope, "idx", "line", "name", "ord")).join(first, "name", "left"))
    indirect, direct = calls.where("var_id IS NOT NULL"), calls.where("var_id IS NULL")
    stub = _id("external_function", F.col("name"))
    callee = F.coalesce("callee", stub)
    for src in (call_id, fn_id):
        edges += [edge(indirect, src, F.col("var_id"), "CALLS_INDIRECT"), edge(direct, src, callee, "CALLS")]
    outside = direct.where("callee IS NULL").select("name").distinct()
    empty = lambda t: F.lit(None).cast(t)
    nodes.append(outside.select(stub.alias("id"), F.lit("Function").alias("type"), F.col("name").alias("label"), "name", empty("string").alias("file"), empty("string").alias("function"), empty("int").alias("line_start"), empty("int").alias("line_end"), empty("string").alias("code"), F.lit(False).alias("defined")))
    literal_id = _id("literal", *f("file", "function", "fn_line", "idx", "ord"))
    nodes.append(node(of("Literal"), literal_id, "Literal", F.substring("name", 1, 30)))
    edges.append(edge(of("Literal"), stmt_id, literal_id, "AST_CHILD"))

    # facts, with up to three statements before as context
    before = Window.partitionBy(*scope).orderBy("idx").rowsBetween(-3, -1)
    compact = statements.withColumn("compact", F.trim(F.regexp_replace("code", r"\s+", " "))).withColumn("context", F.array_join(F.collect_list("code").over(before), "\n"))
    found = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(rule).alias("rule"), F.lit(fact).alias("fact"))) for rule, fact, _, _, holds in statement_rules(F.col("compact"), F.col("type"), F.col("context"))]))
    facts = compact.withColumn("x", F.explode(found)).withColumns({"name": F.col("x.rule"), "fact": F.col("x.fact"), "evidence": F.substring("compact", 1, 500)})
    fact_id = _id("fact", *f("file", "function", "fn_line", "idx", "name"))
    nodes.append(node(facts, fact_id, "SemanticFact", F.col("fact"), code="evidence"))
    edges += [edge(facts, stmt_id, fact_id, "HAS_SEMANTIC_FACT"), edge(facts, fn_id, fact_id, "SEMANTICALLY_RELATED")]

    all_nodes = checkpoint(reduce(DataFrame.unionByName, nodes).dropDuplicates(["id"]))
    all_edges = reduce(DataFrame.unionByName, edges).distinct()
    return Graph(all_nodes, checkpoint(all_edges.select(edge_id(F.col("src"), F.col("type"), F.col("dst")).alias("edge_id"), "src", "dst", "type")))
