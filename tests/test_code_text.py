"""Comments, definitions and challenge folders."""

from pyspark.sql import functions as F

from arborlake.functions import code_text
from arborlake.operators import select
from arborlake.sources import challenge

TEXT = 'a = "// no"; // yes\n/* b\n c */ d = \'"\'; /* e'


def test_comments():
    assert code_text.mask_comments(TEXT) == 'a = "      ' + " " * 8 + "\n    \n      d = '\"'; /* e"
    assert code_text.strip_comments(TEXT) == 'a = "// no";       \n    \n      d = \'"\';     '
    assert code_text.strip_comments_keep_lines(TEXT) == 'a = "// no"; \n\n d = \'"\'; '
    assert len(code_text.strip_comments(TEXT)) == len(TEXT)
    assert [(a, b) for a, b, _ in code_text.comment_spans(TEXT)] == [(1, 1), (2, 3)]


def test_definitions(spark):
    text = "#define LIMIT \\\n  16 // x\nstatic const int buf_size = 4 * 2;\nconst int other = 1;\nenum e { RED, GREEN = 3,\n blue };\n"
    assert code_text.file_definitions(text) == [("macro", "LIMIT", "16", 1), ("constant", "buf_size", "4 * 2", 3), ("enum", "GREEN", "3", 5), ("enum", "RED", "", 5)]
    rows = spark.createDataFrame([(text,), (None,)], "t string")
    got = rows.select(code_text.definitions(F.col("t")).alias("d"), code_text.stripped(F.col("t")).alias("s"), code_text.masked(F.col("t")).alias("m")).collect()
    assert len(got[0]["d"]) == 4 and got[1]["d"] is None and "// x" not in got[0]["s"] and got[1]["m"] is None


def test_challenge(spark, tmp_path):
    rows = [(str(i), f"p{i % 2}", "f.c", f"fn{i}", i % 4 < 2, i) for i in range(12)]
    samples = spark.createDataFrame(rows, "sample_id string, project string, filepath string, func_name string, is_vulnerable boolean, size int")
    split = challenge.with_ids(select.train_test_split(samples, 2, [F.asc("size")]))
    challenge.write(split, str(tmp_path / "c1"))
    assert [r["path"].rsplit("/", 1)[-1] for r in challenge.discover(spark, str(tmp_path)).collect()] == ["c1"]
    assert challenge.problems(spark, str(tmp_path / "c1")).collect() == []
    assert {r["split"]: (r["rows"], r["vulnerable"]) for r in challenge.counts(split).collect()} == {"test": (4, 2), "train": (8, 4)}
    spark.read.option("header", "true").csv(str(tmp_path / "c1/labels")).limit(3).coalesce(1).write.option("header", "true").csv(str(tmp_path / "l"))
    assert "label" not in spark.read.option("header", "true").csv(str(tmp_path / "c1/test")).columns
