"""Keyed tables of streams: buckets, versions, restarts, late rows; recent events; appended lines."""

import json
import random

import pytest

from arborlake.streaming import events, sink

SCHEMA = "key string, last_seq long, value long"


def rows(df):
    return sorted((r["key"] or "", r["last_seq"], r["value"]) for r in df.collect())


def test_batches_rewrite_only_what_they_touch(spark, tmp_path):
    path, draw, model = str(tmp_path / "t"), random.Random(3), {}
    for number in range(5):
        batch = [(draw.choice(["a", "b", "c", "d", None, "e"]), draw.randint(0, 30), number) for _ in range(4)]
        # in the order of seq, so that a later batch wins ties and a batch has no ties of its own
        batch = list({(k, s): (k, s, v) for k, s, v in batch}.values())
        sink.upsert(spark.createDataFrame(batch, SCHEMA), number, path, ["key"], "last_seq", 8)
        for key, seq, value in batch:
            if key not in model or (seq, value) >= model[key][1:]:
                model[key] = (key, seq, value)
        assert rows(sink.read_table(spark, path)) == sorted((k or "", s, v) for k, s, v in model.values())
        assert sink.versions(spark, path) == [n for n in (number - 1, number) if n >= 0]
    # a batch that is run again changes nothing, an empty one neither
    sink.upsert(spark.createDataFrame(batch, SCHEMA), 4, path, ["key"], "last_seq", 8)
    sink.upsert(spark.createDataFrame([], SCHEMA), 5, path, ["key"], "last_seq", 8)
    assert rows(sink.read_table(spark, path)) == sorted((k or "", s, v) for k, s, v in model.values())
    assert sink.versions(spark, path) == [3, 4]
    used = {(b, v) for n in (3, 4) for b, v in sink._buckets(spark, path, n).items()}
    left = {(int(p.name[7:]), int(p.parent.name[8:])) for p in (tmp_path / "t" / "rows").glob("version=*/bucket=*")}
    assert left == used
    assert sink.read_table(spark, path, 3).count() <= len(model)
    with pytest.raises(FileNotFoundError):
        sink.read_table(spark, path, 0)
    with pytest.raises(FileNotFoundError):
        sink.read_table(spark, str(tmp_path / "absent"))


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    sink.upsert(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], SCHEMA), 0, path, ["key"], "last_seq", 4)
    # the rows of batch 1 were written and its version was not
    spark.createDataFrame([("a", 2, 2, 0)], SCHEMA + ", bucket int").write.partitionBy("bucket").parquet(f"{path}/rows/version=1")
    assert rows(sink.read_table(spark, path)) == [("a", 1, 1), ("b", 1, 1)]
    sink.upsert(spark.createDataFrame([("a", 2, 5)], SCHEMA), 1, path, ["key"], "last_seq", 4)
    assert rows(sink.read_table(spark, path)) == [("a", 2, 5), ("b", 1, 1)]


def put(folder, number, lines):
    folder.mkdir(exist_ok=True)
    (folder / f"{number}.json").write_text("\n".join(json.dumps(dict(zip(("key", "seq", "status", "value"), e, strict=True))) for e in lines))


def test_streams_go_on_after_a_restart(spark, tmp_path):
    draw = random.Random(7)
    all_ = [(draw.choice("abcdef"), seq, draw.choice(["error", "done", None]), draw.choice([None, 1.5])) for seq in range(60)]
    draw.shuffle(all_)
    stream = lambda: events.read_events(spark, str(tmp_path / "in"), 2)
    for run in range(2):
        for i in range(3):
            put(tmp_path / "in", run * 3 + i, all_[(run * 3 + i) * 10 :][:10])
        events.run_to_table(events.reduce_stream(stream()), str(tmp_path / "state"), str(tmp_path / "c1"), 8)
        sink.upsert_stream(events.recent_stream(stream(), 4), str(tmp_path / "recent"), str(tmp_path / "c2"), ["key"], "n", 4)
        sink.append_stream(stream(), str(tmp_path / "log"), str(tmp_path / "c3"))
        seen = spark.createDataFrame(all_[: (run + 1) * 30], events.EVENT_SCHEMA)
        plain = lambda df: {r["key"]: r.asDict() for r in df.collect()}
        assert plain(sink.read_table(spark, str(tmp_path / "state"))) == plain(events.snapshot(seen))
        assert plain(sink.read_table(spark, str(tmp_path / "recent"))) == plain(events.recent_snapshot(seen, 4))
        assert sorted(map(repr, spark.read.schema(events.EVENT_SCHEMA).json(str(tmp_path / "log")).collect())) == sorted(map(repr, seen.collect()))
    assert len(sink.versions(spark, str(tmp_path / "state"))) == 2
