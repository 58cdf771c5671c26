"""Event streams: reducing run events to state, quota projection, log lines, and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arborlake.functions.text import log_fields
from arborlake.streaming.sink import upsert_stream

EVENT_SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("status", T.StringType()), T.StructField("value", T.DoubleType())])
RESULT = "key string, status string, value double, n long, errors long, last_seq long"
STATE = "status string, status_seq long, value double, value_seq long, n long, errors long, last_seq long"


def snapshot(events: DataFrame) -> DataFrame:
    """(key, status, value, n, errors, last_seq): the batch twin of reduce_stream. The last value of each field by seq stays; nulls do not overwrite."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return events.groupBy("key").agg(last("status").alias("status"), last("value").alias("value"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errors"), F.max("seq").alias("last_seq"))


def _reduce(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # for each field its last value and the seq it came with, so that late events count but overwrite nothing newer
    status, status_seq, value, value_seq, n, errors, last = state.get if state.exists else (None, -1, None, -1, 0, 0, -1)
    for frame in frames:
        for event_status, event_value, seq in zip(frame["status"], frame["value"], frame["seq"].tolist(), strict=True):
            if isinstance(event_status, str) and seq >= status_seq:
                status, status_seq = event_status, seq
            if event_value is not None and not pd.isna(event_value) and seq >= value_seq:
                value, value_seq = float(event_value), seq
            n, errors, last = n + 1, errors + (event_status == "error"), max(last, seq)
    state.update((status, status_seq, value, value_seq, n, errors, last))
    yield pd.DataFrame([{"key": key[0], "status": status, "value": value, "n": n, "errors": errors, "last_seq": last}])


def reduce_stream(events: DataFrame) -> DataFrame:
    """A stream of (key, seq, status, value) as a stream of each key's state after every batch that touches it."""
    return events.groupBy("key").applyInPandasWithState(_reduce, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of JSON lines as a stream of events; bad lines are dropped."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("mode", "DROPMALFORMED").json(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> None:
    """Drain what is there and keep the last state of each key as a keyed table (sink.read_table); a batch rewrites only the buckets it touches."""
    upsert_stream(stream, path, checkpoint, ["key"], "last_seq", buckets)


RECENT = "key string, seqs array<long>, statuses array<string>, values array<double>, n long, last_seq long"
RECENT_STATE = "seqs array<long>, statuses array<string>, values array<double>, n long"


def recent_snapshot(events: DataFrame, most: int = 500) -> DataFrame:
    """(key, seqs, statuses, values, n, last_seq): the last `most` events of each key by seq and how many there were; the batch twin of recent_stream. Events of a key must differ in seq."""
    order = Window.partitionBy("key").orderBy(F.desc("seq"))
    kept = events.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most)
    lists = kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "status", "value"))).alias("r"))
    n = events.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))
    field = lambda name: F.transform("r", lambda x: x[name])
    return lists.select(F.col("key").alias("k"), field("seq").alias("seqs"), field("status").alias("statuses"), field("value").alias("values")).join(n, F.col("k").eqNullSafe(F.col("key"))).select("key", "seqs", "statuses", "values", "n", "last_seq")


def recent_stream(events: DataFrame, most: int = 500) -> DataFrame:
    """A stream of (key, seq, status, value) as a stream of each key's last `most` events; the state of a key never holds more, late events take their place by seq."""

    def keep(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, statuses, values, n = state.get if state.exists else ([], [], [], 0)
        held = list(zip(seqs, statuses, values, strict=True))
        for frame in frames:
            n += len(frame)
            new = frame.sort_values("seq").tail(most)
            clean = [None if pd.isna(v) else float(v) for v in new["value"]]
            text = [s if isinstance(s, str) else None for s in new["status"]]
            held = sorted(held + list(zip(new["seq"].tolist(), text, clean, strict=True)), key=lambda e: e[0])[-most:]
        columns = [list(c) for c in zip(*held, strict=True)]
        state.update((*columns, n))
        yield pd.DataFrame([dict(zip(("key", "seqs", "statuses", "values", "n", "last_seq"), (key[0], *columns, n, columns[0][-1]), strict=True))])

    return events.groupBy("key").applyInPandasWithState(keep, RECENT, RECENT_STATE, "update", GroupStateTimeout.NoTimeout)


def quota_left(calls: DataFrame, by: list[str], order: list[str], quota: int) -> DataFrame:
    """calls with what is left of a quota after each completed or failed call; never below 0."""
    used = F.sum(F.when(F.col("status").isin("completed", "error"), 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("left", F.greatest(F.lit(quota) - used, F.lit(0)))


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log lines as (tag, fields); lines without a tag and fields are dropped. Works on streams and tables alike."""
    tag, fields = log_fields(F.col(column))
    return lines.select(tag.alias("tag"), fields.alias("fields")).where((F.col("tag") != "") & (F.size("fields") > 0))
