"""The Arrow data source: partitions, columns, streams, folders, types and empty files."""

import datetime as dt
import decimal

import pyarrow as pa
import pytest

from arborlake.sources.arrow_files import ArrowReader, Batches, read_arrow, write_arrow


def write(path, table, rows=10, stream=False, compression=None):
    kind = pa.ipc.new_stream if stream else pa.ipc.new_file
    with pa.OSFile(str(path), "wb") as sink, kind(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as out:
        out.write_table(table, max_chunksize=rows)


@pytest.fixture
def numbers():
    return pa.table({"a": list(range(95)), "b": [f"t{i}" if i % 7 else None for i in range(95)]})


def test_one_partition_a_run_of_batches(spark, tmp_path, numbers):
    write(tmp_path / "x.arrow", numbers, compression="zstd")
    whole = read_arrow(spark, str(tmp_path / "x.arrow"))
    assert whole.rdd.getNumPartitions() == 10
    assert [tuple(r) for r in whole.orderBy("a").collect()] == list(zip(*numbers.to_pydict().values(), strict=True))
    assert read_arrow(spark, str(tmp_path / "x.arrow"), batches=4).rdd.getNumPartitions() == 3
    assert read_arrow(spark, f"file://{tmp_path}/x.arrow", ["b"]).columns == ["b"]
    assert read_arrow(spark, str(tmp_path / "x.arrow"), ["b", "a"], 4).agg({"a": "sum"}).first()[0] == sum(range(95))


def test_folders_streams_and_missing_columns(spark, tmp_path, numbers):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    write(tmp_path / "in" / "a.arrow", numbers)
    write(tmp_path / "in" / "deep" / "b.feather", numbers.select(["a"]), stream=True)
    write(tmp_path / "in" / "c.arrow", numbers.slice(0, 0))
    write(tmp_path / "in" / "_skip.arrow", numbers)
    (tmp_path / "in" / "notes.txt").write_text("no Arrow")
    got = read_arrow(spark, str(tmp_path / "in"))
    # ten batches, one stream, and none of the empty file
    assert got.count() == 190 and got.rdd.getNumPartitions() == 11
    assert got.where("b IS NULL").count() == 95 + 14
    assert ArrowReader(str(tmp_path / "in"), got.schema, 1, 2).partitions() == [Batches(str(tmp_path / "in" / n)) for n in ("a.arrow", "c.arrow", "deep/b.feather")]
    limited = spark.read.format("arrow_files").option("footers", 1).load(str(tmp_path / "in"))
    assert limited.rdd.getNumPartitions() == 3 and limited.count() == 190
    (tmp_path / "none").mkdir()
    for path in ("none", "absent"):
        with pytest.raises(Exception, match="no Arrow files|absent"):
            read_arrow(spark, str(tmp_path / path)).count()


def test_types_and_empty_tables(spark, tmp_path):
    row = {"i": 1, "f": 0.5, "s": "é", "d": dt.date(2020, 1, 2), "t": dt.datetime(2020, 1, 2, 3, 4, 5), "l": [1, None], "m": {"x": "y"}, "n": decimal.Decimal("1.25"), "b": b"\x00"}
    table = pa.Table.from_pylist([row, dict.fromkeys(row)]).append_column("k", pa.array(["u", None]).dictionary_encode())
    write(tmp_path / "t.arrow", table)
    got = read_arrow(spark, str(tmp_path / "t.arrow")).orderBy("i").collect()
    assert got[0].asDict() == dict.fromkeys([*row, "k"])
    assert {k: (v.asDict() if k == "m" else bytes(v) if k == "b" else v) for k, v in got[1].asDict().items()} == {**row, "k": "u"}
    write(tmp_path / "e.arrow", table.slice(0, 0))
    assert read_arrow(spark, str(tmp_path / "e.arrow")).collect() == []


def test_written_files_are_read_again(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 3).selectExpr("id", "CASE WHEN id % 3 > 0 THEN concat('r', id) END AS name", "array(id, NULL) AS l", "timestamp_seconds(id) AS t")
    assert write_arrow(rows, f"file:{tmp_path}/out") == 1000
    got = read_arrow(spark, str(tmp_path / "out"))
    assert got.exceptAll(rows).count() == rows.exceptAll(got).count() == 0
    assert [p.name for p in sorted((tmp_path / "out").iterdir())] == [f"part-{i:06d}.arrow" for i in range(3)]
    assert write_arrow(rows.limit(0), str(tmp_path / "none")) == 0
    assert read_arrow(spark, str(tmp_path / "none")).count() == 0
