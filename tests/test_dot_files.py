"""DOT files read by splits, against a splitter that has the whole text; the choice between export forms."""

import random

import pytest

from arborlake.sources import dot_files, graphs


def whole(text):
    """Statements of a text, character by character."""
    out, now, quoted, depth, i = [], "", False, 0, 0
    while i < len(text):
        c = text[i]
        if quoted and c == "\\":
            now += text[i : i + 2]
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "[]":
            depth = depth + 1 if c == "[" else max(depth - 1, 0)
        if not quoted and depth == 0 and c in ";\n{}":
            out.append(now)
            now = ""
        else:
            now += c
        i += 1
    return sorted(s.strip() for s in [*out, now] if s.strip())


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_statements_across_splits(spark, tmp_path, tiny_splits):
    rng, wanted = random.Random(7), []
    for n in range(3):
        parts = []
        for i in range(150):
            label = "".join(rng.choice(["a", "b ", "\n", ";", "{", "}", "[", "]", "\\\"", "\\\\", "->"]) for _ in range(rng.choice([3, 10, 60, 400 if i % 50 == 0 else 5])))
            end = rng.choice([";\n", "\n", ";"])
            parts.append(f'n{i} [label="{label}"\n CODE="x{i}"]{end}' if rng.random() < 0.6 else f"n{i} -> n{i // 2} [\nlabel=[AST]\n]{end}")
        # stray closers come before what must stay whole
        text = f"digraph g {{\n] ]\n{''.join(parts)}}}\n"
        (tmp_path / f"{n}.dot").write_text(text)
        wanted += whole(text)
    rows = dot_files.statements(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 10
    assert sorted(r["text"].strip() for r in rows.collect()) == sorted(wanted)


def test_open_quotes_and_empty_files(spark, tmp_path, tiny_splits):
    (tmp_path / "open.dot").write_text('digraph {\na [label="A"]\nb [label="' + "x;\n" * 800)
    (tmp_path / "empty.dot").write_text("")
    (tmp_path / "null.dot").write_text("\n\n{}\n;;\n")
    got = graphs.read_dot(spark, str(tmp_path))
    assert [(r["id"], r["label"]) for r in got.nodes.collect()] == [("cpg:a", "A")] and got.edges.count() == 0


def test_export_takes_graphml_before_dot(spark, tmp_path):
    assert graphs.read_export(spark, str(tmp_path / "none")).nodes.count() == 0
    (tmp_path / "deep/er").mkdir(parents=True)
    (tmp_path / "readme.txt").write_text("<node id='9'/>")
    assert graphs.read_export(spark, str(tmp_path)).nodes.count() == 0
    (tmp_path / "deep/x.dot").write_text("a -> b\na [label=METHOD]\nb [label=CALL]\n")
    dot = graphs.read_export(spark, str(tmp_path))
    assert sorted(r["id"] for r in dot.nodes.collect()) == ["cpg:a", "cpg:b"] and dot.edges.count() == 1
    assert graphs.read_export(spark, str(tmp_path), max_nodes=1).edges.count() == 0
    (tmp_path / "deep/er/x.xml").write_text('<graphml><graph><node id="1"><data key="labelV">METHOD</data></node><node id="2"/><edge source="1" target="2"><data key="labelE">AST</data></edge></graph></graphml>')
    ml = graphs.read_export(spark, str(tmp_path))
    assert sorted(r["id"] for r in ml.nodes.collect()) == ["cpg:1", "cpg:2"] and [r["type"] for r in ml.edges.collect()] == ["JOERN_AST"]
