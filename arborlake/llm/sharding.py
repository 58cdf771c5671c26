"""Sharding by a permutation-filled lookup table of prime size.

Each shard has its own permutation of the table's slots, given by an offset and a stride. The shards take turns and
claim the first slot of their permutation that is still free, so slots are even to within one and few slots change
hands when a shard joins or leaves. A document's key hashes to a slot and a broadcast lookup gives its shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.texts import free_name

SHARDS = 256
TABLE_SIZE = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the shard that owns each slot. size must be a prime of at least len(shards)."""
    if not shards or size < len(shards) or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime that is no smaller than the number of shards")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names must differ")
    at = [_number(f"offset:{name}") % size for name in shards]
    stride = [_number(f"stride:{name}") % (size - 1) + 1 for name in shards]
    owner, left = [-1] * size, size
    while left:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + stride[shard]) % size
            owner[at[shard]] = shard
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """A key's slot: the first 60 bits of the md5 of its text, modulo size; a null key hashes as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size))


def assign(docs: DataFrame, shards: list[str] | int = SHARDS, size: int = TABLE_SIZE, key: str = "doc_id") -> DataFrame:
    """(key, slot, shard) for every row, without a shuffle.

    Nulls hash as the empty text; text, source and every other column are not read; repeated rows go to the same
    shard; an empty table gives an empty result. The broadcast has exactly `size` rows of two numbers.
    """
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else shards
    owners = ",".join(map(str, fill_table(names, size)))
    lookup = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    lookup = lookup.select(F.col("slot").cast("long").alias("slot"), F.col("owner").cast("long").alias("shard"))
    keyed = docs.select(F.col(key), slot_of(F.col(key), size).alias("slot"))
    return keyed.join(F.broadcast(lookup), "slot").select(key, "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: list[str] | int = SHARDS, size: int = TABLE_SIZE, pieces: int = 8, key: str = "doc_id") -> None:
    """Write docs as one folder per shard, each in up to `pieces` files that hold whole rows, all columns as they are.

    The folders are named shard=N, with bars in front of the name if docs has such a column. A hot key's rows, which
    all belong to one shard, are dealt to its files by their whole content.
    """
    label = free_name(docs.columns, "shard")
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else shards
    owners = F.split(F.lit(",".join(map(str, fill_table(names, size)))), ",")
    shard = F.element_at(owners, (slot_of(F.col(key), size) + 1).cast("int")).cast("long")
    piece = F.pmod(F.xxhash64(*[_plain(docs, c) for c in docs.columns]), F.lit(pieces))
    rows = docs.withColumn(label, shard)
    rows.repartition(F.col(label), piece).write.mode("overwrite").partitionBy(label).parquet(path)


def _plain(docs: DataFrame, name: str) -> Column:
    # maps have no hash
    c = F.col(f"`{name}`")
    return c if docs.schema[name].dataType.typeName() in ("string", "long", "integer", "double", "boolean") else F.to_json(F.struct(c))


def oracle_sql(shards: int = SHARDS, size: int = TABLE_SIZE) -> str:
    """The same placement in DuckDB SQL over the filled table."""
    owners = ",".join(map(str, fill_table([f"shard-{i:05d}" for i in range(shards)], size)))
    slot = f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size}"
    return f"WITH t AS (SELECT string_split('{owners}', ',') AS owners) SELECT doc_id, {slot} AS slot, CAST(t.owners[{slot} + 1] AS BIGINT) AS shard FROM documents, t"
