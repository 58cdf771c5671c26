"""Facts of evidence packs and claims against them."""

from arborlake.functions import pack_facts as p

ITEMS = [
    ("a", "E1", "#define LINESIZE 4096"), ("a", "E2", "unsigned contentlen = 0;"), ("a", "E3", "if (CONTENTLEN > LINESIZE * 4)"), ("a", "E4", None), ("b", "E1", "buf = myalloc(LINESIZE);"),
    *[("b", f"E{i}", "buf[i] = 0;") for i in range(2, 9)],
]


def test_facts_name_the_items_that_show_them(spark):
    items = spark.createDataFrame(ITEMS, "pack string, evidence_id string, text string")
    got = {(r["pack"], r["fact"]): (r["n"], r["ids"]) for r in p.pack_facts(items, ["pack"], "text", "evidence_id").collect()}
    assert got == {
        ("a", "linesize_definition"): (1, ["E1"]), ("a", "contentlen_declaration"): (1, ["E2"]), ("a", "unsigned_contentlen_declaration"): (1, ["E2"]), ("a", "contentlen_cap"): (1, ["E3"]),
        ("b", "buf_allocation"): (1, ["E1"]), ("b", "nul_write"): (7, ["E2", "E3", "E4", "E5"]),
    }
    assert p.pack_facts(items.limit(0), ["pack"], "text", "evidence_id").count() == 0


def test_claims_that_a_shown_fact_is_missing(spark):
    items = spark.createDataFrame(ITEMS, "pack string, evidence_id string, text string")
    said = [("a", "LINESIZE is missing and the buffer is unknown"), ("a", "Critical facts are missing: contentlen"), ("b", "The allocated size is known. Missing is another thing"), ("b", None), ("b", ""), ("c", "linesize is absent")]
    facts = p.pack_facts(items, ["pack"], "text", "evidence_id")
    got = p.contradicted_claims(spark.createDataFrame(said, "pack string, said string"), facts, ["pack"], "said").collect()
    assert sorted((r["pack"], r["fact"], r["ids"]) for r in got) == [("a", "contentlen_cap", ["E3"]), ("a", "linesize_definition", ["E1"])]
