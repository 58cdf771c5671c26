"""Shared plumbing: Arrow-batched work on whole texts in bounded slices."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.session import broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(columns: list[str], name: str) -> str:
    """The name, with bars in front if one of the columns has it; names differ if they do so beyond case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keep_marked(docs: DataFrame, verdicts: DataFrame, mark: Column, most: int = 200_000) -> DataFrame:
    """docs without the rows that verdicts (id, mark, kept) tell to drop, and with one of each that they tell to keep.

    Rows are matched by doc_id and `mark`, an expression over docs. Rows that no verdict names stay as they are; where
    kept is true and several rows match, any one of them stays. Columns are unchanged. verdicts must be written out.
    """
    name = free_name(docs.columns, "mark")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*columns, mark.alias(name))
    is_in = lambda some: rows["doc_id"].eqNullSafe(some["id"]) & (rows[name] == some["mark"])
    out = rows.join(broadcast_if_small(verdicts, most), is_in(verdicts), "left_anti").select(*columns)
    repeated = verdicts.where("kept")
    if repeated.isEmpty():
        return out
    # a partial aggregate runs before the exchange, so rows repeated very often do not meet in one task
    some = rows.join(broadcast_if_small(repeated, most), is_in(repeated), "left_semi").groupBy("doc_id", name)
    return out.unionByName(some.agg(F.any_value(F.struct(*columns)).alias("row")).select("row.*"))


def give_back() -> None:
    """Return freed memory to the system. Python workers live on between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of a batch of rows between Spark and Python. Both sides hold one or two for each task, beside what the operator needs.
BATCH_BYTES = 8 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bytes a batch to BATCH_BYTES; a lower setting stays. It counts when a query is run, so it is not set back."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(_BATCHES).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def map_texts(
    docs: DataFrame,
    keep: list[str],
    fields: list[T.StructField],
    start: Callable[[], Callable[[list[str | None]], list[pa.Array]]],
    slice_chars: int = 3_000_000,
) -> DataFrame:
    """Rows of keep plus what start()(texts) returns for them.

    Each task calls start() once. Texts come in slices of about slice_chars characters, one text at least; a longer
    text comes whole, and each operator works through it in pieces, so memory holds the text itself and one piece.
    Columns of docs other than keep and text are not read.
    """
    _bounded_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[name] for name in keep] + fields)
    # a text that is kept is not sent a second time
    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            # strings are made for one slice at a time, not for the whole batch
            texts, low = batch.column(at), 0
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            while low < len(sizes):
                high, size = low, 0
                while high < len(sizes) and (high == low or size < slice_chars):
                    size += sizes[high]
                    high += 1
                made = step(texts.slice(low, high - low).to_pylist())
                kept = [batch.column(i).slice(low, high - low) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + made, names=schema.names)
                low = high
        give_back()

    sent = [F.col(name) for name in keep] + ([] if "text" in keep else [F.col("text").alias("_text")])
    return docs.select(*sent).mapInArrow(run, schema)
