"""Steps that follow each other keep the disk of one step, not of all."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from arborlake.operators import relation
from arborlake.session import shared_folder, written


def shuffle_files(spark):
    return {p for p in Path("/tmp").glob("blockmgr-*/*/shuffle_*") if p.exists()}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = written(spark.range(20_000).groupBy((F.col("id") % 5_000).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and table.count() == 5_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_relation_costs_keeps_only_what_its_result_reads(spark):
    def tables():
        return set(Path(shared_folder(spark).removeprefix("file:")).glob("*"))

    edges = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i + 1}", "CALLS") for i in range(12)], "edge_id string, src string, dst string, type string")
    for goal, most in ((None, 12), ("n10", 10)):
        pairs = spark.createDataFrame([("n0", goal)], "source string, goal string")
        before = tables()
        plain = relation.relation_costs(edges, pairs, parents=False)
        # eight buckets at most stand beside what was written together
        assert len(tables() - before) <= 8
        assert {tuple(x) for x in plain.collect()} == {("n0", f"n{i}", 100 * i) for i in range(most + 1)}
        full = relation.relation_costs(edges, pairs)
        assert {(x["node"], x["parent"], x["edge_id"]) for x in full.where("cost > 0").collect()} == {(f"n{i + 1}", f"n{i}", f"e{i}") for i in range(most)}
