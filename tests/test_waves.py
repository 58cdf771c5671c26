"""Candidates in waves against going through them one by one."""

import random

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize(("wanted", "first", "group"), [(4, 2, "project"), (5, 3, None), (50, 4, "project"), (1, 100, "project")])
def test_waves_against_one_by_one(spark, wanted, first, group):
    from arborlake.operators.waves import first_valid

    r = random.Random(wanted)
    rows = [(i, r.choice(["a", "b", "c", "d", "e", "f", None]), r.randint(0, 9), r.choice([True, False, False, None])) for i in range(60)]
    table = spark.createDataFrame(rows, "id int, project string, size int, ok boolean")
    asked = []

    def check(some):
        asked.append(some.count())
        return some.withColumn("valid", F.col("ok"))

    got = {x["id"]: (x["place"], x["outcome"]) for x in first_valid(table, [F.col("size"), F.col("id")], check, wanted, group, first).collect()}
    want, used, n = {}, set(), 0
    for place, (i, project, _, ok) in enumerate(sorted(rows, key=lambda x: (x[2], x[0])), 1):
        if n >= wanted:
            want[i] = place, "not_reached"
        elif group and project in used:
            want[i] = place, "blocked"
        elif ok:
            n, want[i] = n + 1, (place, "selected")
            used |= {project} - {None}
        else:
            want[i] = place, "invalid"
    assert got == want
    if wanted == 4:
        assert sum(asked) < 60
    assert first_valid(table.where("false"), [F.col("id")], check, wanted, group, first).collect() == []
