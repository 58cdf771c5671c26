"""Inventory operators that no SQL query covers."""

from pyspark.sql import functions as F

from arborlake.operators import inventory


def test_bounds_against_declared_sizes(spark):
    rows = spark.createDataFrame([("f", "char buf[64]; int n[2];"), ("f", "fgets(buf, 64, in);"), ("f", "fgets(buf, 65, in);"), ("f", "snprintf(out, sizeof(out), s);"), ("f", "fgets(other, 9, in);")], "fn string, code string")
    sizes = inventory.declared_sizes(rows, by=["fn"])
    assert {(r["symbol"], r["size"]) for r in sizes.collect()} == {("buf", 64), ("n", 2)}
    got = {r["code"]: r["finding"] for r in inventory.bound_findings(rows, sizes, by=["fn"]).collect()}
    assert got == {"fgets(buf, 64, in);": "bound_fits", "fgets(buf, 65, in);": "bound_exceeds_buffer", "snprintf(out, sizeof(out), s);": "bound_fits", "fgets(other, 9, in);": "bound_unknown"}


def test_noise(spark):
    cases = {"{": True, "else  {": True, "int i;": True, "  const unsigned int  n ;": True, "break;": False, "x = 1;": False, "char b[9];": False, "int *p;": False, "": False}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["n"] for r in rows.select("t", inventory.noisy(F.col("t")).alias("n")).collect()} == cases


def test_students_see_no_truth(spark):
    samples = spark.createDataFrame([("a", False, "x")], "sample_id string, skipped boolean, truth string")
    predictions = spark.createDataFrame([("a", "completed", 1)], "sample_id string, status string, prediction int")
    assert inventory.list_samples(samples, predictions, "student").first()["truth"] is None
    assert inventory.list_samples(samples, predictions, "admin").first()["truth"] == "x"
