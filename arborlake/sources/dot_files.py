"""DOT files of any size, read by splits: what a statement needs to know of the text before it is one small row a split.

A first scan tells what each split does to the state it is entered with; states are then chained within a file, and a second scan cuts statements.
Only pieces of statements that cross a split's edge are exchanged, at most two a split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlake.session import broadcast_if_small, checkpoint

#: Characters of a statement; a longer one, as an open quote makes, gives nothing.
LONGEST = 1_000_000
_MARK = re.compile(r'\\.|["\[\];{}]', re.S)
_EFFECT = "file string, block long, q0 boolean, up0 long, low0 long, q1 boolean, up1 long, low1 long"
_PIECE = "file string, block long, part int, text string"


def _marks(line: str, quoted: bool) -> Iterator[tuple[str, int]]:
    """Marks of a line that stand outside quotes, with their places; a quote that opens or closes comes as itself."""
    for m in _MARK.finditer(line):
        mark, at = m[0], m.start()
        if mark[0] == "\\":
            if quoted or mark[1] not in '"[];{}':
                continue
            mark, at = mark[1], at + 1
        if mark == '"':
            quoted = not quoted
            yield mark, at
        elif not quoted:
            yield mark, at


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, pd.DataFrame]]:
    """Rows of one split at a time, in parts if it comes in several batches."""
    for frame in frames:
        if len(frame):
            key = (frame["file"] != frame["file"].shift()) | (frame["block"] != frame["block"].shift())
            for _, part in frame.groupby(key.cumsum(), sort=False):
                yield part["file"].iloc[0], int(part["block"].iloc[0]), part


def _effects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each split does: entered outside quotes (0) or inside (1) it is left in quotes or not, and a depth d becomes max(d + up, low)."""
    at, state, columns = None, [], [c.split(" ")[0] for c in _EFFECT.split(", ")]
    row = lambda: pd.DataFrame([[*at, *state[0], *state[1]]], columns=columns)
    for file, block, part in _runs(frames):
        if at != (file, block):
            if at:
                yield row()
            at, state = (file, block), [[False, 0, 0], [True, 0, 0]]
        for line in part["value"]:
            for s in state:
                quoted, up, low = s
                for mark, _ in _marks(line, quoted):
                    if mark == '"':
                        quoted = not quoted
                    elif mark == "[":
                        up, low = up + 1, low + 1
                    elif mark == "]":
                        up, low = up - 1, max(low - 1, 0)
                s[:] = quoted, up, low
    if at:
        yield row()


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole statements (part null), the end of one that an earlier split began (part 0) and the start of one that a later split ends (part 1)."""
    at, parts, size, quoted, depth, head = None, [], 0, False, 0, False
    columns = [c.split(" ")[0] for c in _PIECE.split(", ")]

    def whole() -> str:
        return "".join(parts) if size <= LONGEST else ""

    for file, block, frame in _runs(frames):
        out = []
        if at != (file, block):
            if at and (parts or head):
                out.append((*at, 0 if head else 1, whole()))
            at, parts, size, quoted, depth = (file, block), [], 0, bool(frame["quoted"].iloc[0]), int(frame["depth"].iloc[0])
            head = quoted or depth > 0
        for line in frame["value"]:
            start = 0
            cuts = []
            for mark, i in _marks(line, quoted):
                if mark == '"':
                    quoted = not quoted
                elif mark == "[":
                    depth += 1
                elif mark == "]":
                    depth = max(depth - 1, 0)
                elif depth == 0:
                    cuts.append(i)
            if not quoted and depth == 0:
                cuts.append(len(line))
            for i in cuts:
                size += i - start
                parts += [line[start:i]] if size <= LONGEST else []
                text = whole()
                if head or text.strip():
                    out.append((file, block, 0 if head else None, text))
                parts, size, head, start = [], 0, False, i + 1
            if start <= len(line) and (quoted or depth):
                size += len(line) - start + 1
                parts += [line[start:] + "\n"] if size <= LONGEST else []
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"part": "Int32"})
    if at and (parts or head):
        yield pd.DataFrame([(*at, 0 if head else 1, whole())], columns=columns).astype({"part": "Int32"})


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): statements of the DOT files under a path: cut at semicolons, braces and line ends that stand outside quotes and square brackets. Blank ones are left out.

    Files are read by Spark's splits, so none has to fit a task. Both scans must see the same splits; the second one stops if they have changed.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    effects = checkpoint(lines.mapInPandas(_effects, _EFFECT))

    def step(s, x):
        pick = lambda a, b: F.when(s["quoted"], x[b]).otherwise(x[a])
        depth = F.greatest(s["depth"] + pick("up0", "up1"), pick("low0", "low1"))
        entered = F.concat(s["entered"], F.array(F.struct(x["block"].alias("block"), s["quoted"].alias("quoted"), s["depth"].alias("depth"))))
        return F.struct(pick("q0", "q1").alias("quoted"), depth.alias("depth"), entered.alias("entered"))

    none = F.array().cast("array<struct<block:bigint,quoted:boolean,depth:bigint>>")
    begin = F.struct(F.lit(False).alias("quoted"), F.lit(0).cast("long").alias("depth"), none.alias("entered"))
    chain = effects.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "q0", "up0", "low0", "q1", "up1", "low1"))).alias("x"))
    entered = checkpoint(chain.select("file", F.explode(F.aggregate("x", begin, step)["entered"]).alias("e")).select("file", "e.*"))
    known = lines.withColumn("n", F.monotonically_increasing_id()).join(broadcast_if_small(entered), ["file", "block"], "left")
    changed = F.raise_error(F.lit("the splits of these files changed while they were read; read them again"))
    known = known.withColumn("quoted", F.when(F.col("quoted").isNull(), changed.cast("boolean")).otherwise(F.col("quoted"))).sortWithinPartitions("file", "block", "n")
    pieces = checkpoint(known.select("file", "block", "value", "quoted", "depth").mapInPandas(_pieces, _PIECE))
    number = F.sum("part").over(Window.partitionBy("file").orderBy("block", "part"))
    open_ = pieces.where("part IS NOT NULL").withColumn("number", number).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("p"))
    joined = open_.where(F.size("p") > 0).select("file", F.array_join(F.transform("p", lambda p: p["text"]), "").alias("text"))
    return pieces.where("part IS NULL").select("file", "text").unionByName(joined.where(F.trim("text") != ""))
