"""Exact dedup by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. Sorting the blocks brings equal ones together, and each
distinct block is named by its first occurrence, the pair of integers (document, place). Adjacent names are then
paired and the pairs are named the same way, level by level, until each document has one name. Blocks and pairs are
compared as they are, never by hash, so equal names mean equal texts.

A hot block is never gathered into one task: occurrences are first named inside one of SALTS shares by document, and
only the distinct blocks of each share meet to agree on the common name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.texts import keep_marked
from arborlake.session import checkpoint

BLOCK_BYTES = 16_384
SALTS = 64


def _named(rows: DataFrame, salts: int) -> DataFrame:
    """(spot, name) for rows of (key, spot): name is the smallest spot of all rows with the same key.

    spot is one struct that nothing prunes, so both branches below read the same exchange of keys.
    """
    share = Window.partitionBy("key", "salt")
    local = rows.select("key", "spot", F.pmod(F.xxhash64("spot"), F.lit(salts)).alias("salt")).withColumn("local", F.min("spot").over(share))
    firsts = local.where(F.col("spot") == F.col("local")).select("key", "local")
    agreed = firsts.select(_place(F.col("local")).alias("local"), _place(F.min("local").over(Window.partitionBy("key"))).alias("name"))
    agreed = agreed.groupBy("local").agg(F.min("name").alias("name"))
    return local.select("spot", _place(F.col("local")).alias("local")).join(agreed, "local").select("spot", "name")


def _place(spot: Column) -> Column:
    return F.struct(spot["id"].alias("id"), spot["at"].alias("at"), spot["hash"].alias("hash"))


def _spot(at: Column, carried: Column) -> Column:
    return F.struct(F.col("id"), at.alias("at"), F.col("hash"), F.col("blocks"), carried.alias("carried"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, salts: int = SALTS, extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, blocks, name, *extra) for every row: rows have equal (blocks, name) exactly if their texts are equal.

    A null text is the empty text, which has one empty block. extra holds expressions over docs to carry along.
    """
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    blocks = F.greatest(F.ceil(F.octet_length(raw) / F.lit(block_bytes)), F.lit(1)).cast("int")
    extra = extra or {}
    # hash keeps rows apart that repeat a doc_id, or have none, with other texts
    rows = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash"), blocks.alias("blocks"), raw.alias("raw"),
        F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in extra.items()]).alias("carried"),
    )
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block = F.when(F.col("blocks") == 1, F.col("raw")).otherwise(F.substring(F.col("raw"), F.col("at") * block_bytes + 1, F.lit(block_bytes)))
    # each level is written out: its rows hold names only, and the next level reads them more than once
    named = checkpoint(_named(rows.select(block.alias("key"), _spot(F.col("at"), F.when(F.col("at") == 0, F.col("carried"))).alias("spot")), salts))
    widest, level = docs.select(F.max(blocks)).first()[0] or 1, 0
    out = named.where(F.col("spot.blocks") == 1)
    live = named.where(F.col("spot.blocks") > 1)
    while widest > 1:
        level, widest = level + 1, -(-widest // 2)
        # rows that repeat both doc_id and text are one row here, counted in `times`
        sides = live.select("spot.*", "name").withColumn("even", F.col("at") % 2 == 0).withColumn("at", F.expr("at div 2").cast("int"))
        pairs = sides.groupBy("id", "hash", "blocks", "at").agg(
            F.min(F.when(F.col("even"), F.col("name"))).alias("left"), F.min(F.when(~F.col("even"), F.col("name"))).alias("right"),
            F.max("carried").alias("carried"), F.count_if("even").alias("times"),
        )
        times = F.when(F.col("at") == 0, F.col("times").cast("int")).otherwise(1)
        pairs = pairs.withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
        live = checkpoint(_named(pairs.select(F.struct("left", "right").alias("key"), _spot(F.col("at"), F.col("carried")).alias("spot")), salts))
        left = F.ceil(F.col("spot.blocks") / F.lit(2**level))
        out = out.unionByName(live.where(left == 1))
        live = live.where(left > 1)
    return out.select(F.col("spot.id").alias("doc_id"), F.col("spot.blocks").alias("blocks"), "name", *[F.col(f"spot.carried.{k}").alias(k) for k in extra])


def groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row; of equal texts the largest doc_id stays.

    Null texts equal empty ones. A very long text is many blocks, which are named wherever they are. Rows that repeat a
    doc_id and its text count in group_size and are all kept if it is the largest. A null doc_id is below all others. Only doc_id and text are read. An empty table gives an empty result.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = identities(docs.select("doc_id", "text"), block_bytes, salts, {"text_sha256": F.sha2(text, 256)})
    sums = rows.groupBy("blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # spread anew, so that the join has an exchange on both sides and a hot group's rows can be split
    sums = sums.where("group_size > 1").repartition("keep_id", "name")
    rows = rows.join(sums, ["blocks", "name"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    rows = rows.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of docs for each text, with the largest doc_id of those; columns are unchanged.

    A null text equals the empty one. Of several rows with the largest doc_id and the text, any one stays, so a table
    united with itself loses its copies. A text may have all its doc_ids null; then one of its rows stays.
    """
    digest = F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256)
    found = groups(docs).groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("mark")).agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    return keep_marked(docs, checkpoint(found.where("NOT kept OR n > 1").drop("n")), digest)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""
