"""Counter-review in sequence, long paths, source trees that are not UTF-8, and whole nodes of one id."""

import random

from pyspark.sql import functions as F


def test_downgrade_in_sequence(spark):
    from arborlake.operators import evaluate as e

    r = random.Random(1)
    hypotheses = [(f"h{i}", r.choice([e.CONFIRMED, "insufficient_evidence"]), r.choice([*e.CONFIRMED_TIERS, "incomplete", None])) for i in range(40)]
    findings = [(f"h{r.randrange(45)}", i, r.choice([*e.UNSUPPORTED_STATUSES, e.CONFIRMED, None]), r.choice(["Refutes", "weakens", "none", None]), r.random() < 0.5) for i in range(160)]
    expected = {}
    for h, status, tier in hypotheses:
        strong, tier = tier in e.CONFIRMED_TIERS, tier or ""
        for _, _, rec, effect, concrete in sorted((f for f in findings if f[0] == h), key=lambda f: f[1]):
            low = (effect or "").lower()
            if rec not in e.UNSUPPORTED_STATUSES or not (status == e.CONFIRMED or "refut" in low or "weaken" in low):
                continue
            if strong and not concrete:
                status = e.CONFIRMED
            else:
                status = rec
                tier = "refuted" if rec in e.REFUTING_STATUSES else "high_signal_incomplete" if strong else tier
        expected[h] = (status, tier)
    out = e.downgrade(spark.createDataFrame(hypotheses, "hypothesis_id string, status string, tier string"), spark.createDataFrame(findings, "hypothesis_id string, seq int, recommended string, effect string, concrete boolean"))
    assert {x["hypothesis_id"]: (x["status"], x["tier"]) for x in out.collect()} == expected


def test_ledger_polarity(spark):
    from arborlake.operators import evaluate as e

    names = ["missing_domain_guard", "b", "c"]
    obligations = [("a", n, n, True, None) for n in names] + [("a", "d", "d", True, None), ("b", "x", "x", False, "refutes_hypothesis"), ("b", "y", "y", True, None), ("c", "x", "x", True, "supports_hypothesis")]
    results = [("a", n, "proven") for n in names] + [("b", "x", "proven"), ("b", "y", "proven"), ("c", "x", "proven")]
    hypotheses = spark.createDataFrame([("a", "allocation_lifetime", "none"), ("b", "allocation_lifetime", "none"), ("c", e.SOURCE_LEVEL_FAMILY, "source_level")], "hypothesis_id string, family string, boundary string")
    out = e.ledger(spark.createDataFrame(obligations, "hypothesis_id string, obligation_id string, name string, required boolean, polarity string"), spark.createDataFrame(results, "hypothesis_id string, obligation_id string, result string"), hypotheses)
    assert {x["hypothesis_id"]: (x["required"], x["proven"], x["open"], x["tier"]) for x in out.collect()} == {"a": (4, 3, 1, "high_signal_incomplete"), "b": (1, 1, 0, "refuted"), "c": (1, 1, 0, e.CONFIRMED_TIERS[0])}


def test_long_paths(spark):
    from arborlake.operators import graph as g

    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "NEXT", f"e{i:02d}") for i in range(11)] + [("z0", "z1", "NEXT", "f0")], "src string, dst string, type string, edge_id string").cache()
    pairs = spark.createDataFrame([("n0", "n11"), ("n3", "n3"), ("n0", "z1"), ("n9", "n2")], "source string, goal string")
    rows = g.shortest_paths(edges, pairs).orderBy("source", "goal", "step").collect()
    assert [x["node"] for x in rows if (x["source"], x["goal"]) == ("n0", "n11")] == [f"n{i}" for i in range(12)]
    assert [x["edge_id"] for x in rows if x["source"] == "n9"] == [None, *(f"e{i:02d}" for i in range(8, 1, -1))]
    assert [x["node"] for x in rows if x["source"] == "n3"] == ["n3"] and not any(x["goal"] == "z1" for x in rows)
    assert g.shortest_paths(edges, pairs, 5).where("goal = 'n11'").count() == 0
    assert g.shortest_paths(edges, pairs, direction="in").where("source = 'n9'").count() == 8


def test_source_trees_with_other_bytes(spark, tmp_path):
    from arborlake.sources import code

    (tmp_path / "a.c").write_bytes(b"// caf\xe9\nint f(void) { return 1; }\n")
    (tmp_path / "big.c").write_bytes(b"int x;\n" * 400)
    files, skipped = code.scan_tree(spark, str(tmp_path), max_bytes=1000)
    assert {x["path"]: x["text"] for x in files.collect()} == {"a.c": "// caf�\nint f(void) { return 1; }\n"}
    assert {x["path"]: x["reason"] for x in skipped.collect()} == {"big.c": "too large"}


def test_nodes_of_one_id_stay_whole(spark):
    from arborlake.operators import graph as g

    nodes = spark.createDataFrame([("a", "T", "x", 9), ("a", "T", "y", 1), ("b", "U", None, 2)], "id string, type string, name string, line int")
    kept = {x["id"]: (x["name"], x["line"]) for x in g.make_graph(nodes, spark.createDataFrame([("a", "b", "E")], "src string, dst string, type string")).nodes.collect()}
    assert kept == {"a": ("x", 9), "b": (None, 2)}


def test_statement_kinds_agree(spark):
    from arborlake.functions import text
    from arborlake.plans.rule_queries import STATEMENTS
    from arborlake.sources import code

    rows = spark.createDataFrame([(s,) for s in (*STATEMENTS, "x ^= 1;", "x != y;", "return;", "iffy = 2;", "a <<= 1;")], "s string")
    for x in rows.select("s", text.statement_kind(F.col("s")).alias("kind")).collect():
        assert x["kind"] == code.kind_of(x["s"])
