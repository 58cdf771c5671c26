"""Importance resampling towards a target distribution, by hashed n-gram features.

The features of a text are its runs of one to `n` words. Each falls in one of `buckets` hash buckets, and a bucket's
gain is the log ratio of its smoothed shares in the target and in the corpus. A document's weight is the sum of its
features' gains; with Gumbel noise added, the highest scores are a sample without replacement in proportion to the
exponential of the weights.

No row is made for a feature when documents are scored: higher-order functions make each document's array of buckets,
which is written once, and an aggregate looks each bucket up in a literal array of gains. What is shuffled are bucket
totals, at most one row a bucket and task, and the scores that are put in order.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.texts import ascii_lower
from arborlake.session import broadcast_if_small, checkpoint

#: What stands between words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Bits of monotonically_increasing_id that number the rows of a partition.
_ROW_BITS = 33


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    found = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR, -1)
    return F.filter(found, lambda w: w != "")


def _bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("smallint" if buckets <= 1 << 15 else "int")


def bucket_array(found: Column, n: int = N, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to n of the words, repeats included."""

    def runs(size: int) -> Column:
        places = F.when(F.size(found) >= size, F.sequence(F.lit(1), F.size(found) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: _bucket(F.array_join(F.slice(found, i, size), " "), buckets))

    alone = F.transform(found, lambda w: _bucket(w, buckets))
    return F.concat(alone, *[runs(size) for size in range(2, n + 1)]) if n > 1 else alone


def _bucketed(texts: DataFrame, keep: tuple[str, ...], n: int, buckets: int) -> DataFrame:
    """keep, n_words and bucket, the array; n-grams are made from words that are split once."""
    rows = texts.select(*keep, words(F.col("text")).alias("_words"))
    return rows.select(*keep, F.size("_words").cast("long").alias("n_words"), bucket_array(F.col("_words"), n, buckets).alias("bucket"))


def totals(bucketed: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features fall in each bucket. At most `buckets` rows a task are shuffled, and so many reach the driver."""
    out = [0] * buckets
    for row in bucketed.select(F.explode("bucket").alias("b")).groupBy("b").count().collect():
        out[row["b"]] = row["count"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """The gain of each bucket in thousandths of a nat, rounded down."""
    buckets = len(corpus)
    all_corpus, all_target = float(sum(corpus) + buckets), float(sum(target) + buckets)
    return [math.floor(1000 * math.log((t + 1) * all_corpus / ((s + 1) * all_target))) for s, t in zip(corpus, target, strict=True)]


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, by the doc_id alone; a null doc_id has that of an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share)))


def score(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, n_words, n_features, weight, score) for every row of docs, written out. target has a column text.

    A null or empty text has no feature and weight 0. Repeated rows count each; an empty docs gives an empty result, and
    an empty target leaves the smoothing alone. Only keep and text are read, so other columns never clash. A very
    long text is one array of its buckets, two bytes a word.
    """
    rows = checkpoint(_bucketed(docs, keep, n, buckets))
    table = gains(totals(rows, buckets), totals(_bucketed(target, (), n, buckets), buckets))
    # a JSON text of whole numbers, which the optimizer folds to one literal array
    literal = F.from_json(F.lit(json.dumps(table)), "array<bigint>")
    weight = F.aggregate("bucket", F.lit(0).cast("long"), lambda so_far, b: so_far + F.element_at(literal, b.cast("int") + 1))
    rows = rows.select(*keep, "n_words", F.size("bucket").cast("long").alias("n_features"), weight.alias("weight"))
    return checkpoint(rows.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored with rank: 1, 2, 3 ... for the highest scores among rows of least_words words, null for all others.

    percent of those rows are drawn, rounded down; ties go to the smaller doc_id, null last. Rows are sorted by range,
    and a row's rank is its place in its range behind all earlier ranges, so no task holds more than one range.
    """
    rows = scored.where(F.col("n_words") >= least_words)
    wanted = percent * rows.count() // 100
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    placed = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    # as many rows as there are ranges
    sizes = placed.groupBy(F.shiftright("at", _ROW_BITS).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, bases = 0, []
    for row in sizes:
        if before < wanted:
            bases.append((row["part"], before))
        before += row["n"]
    spark = scored.sparkSession
    bases = broadcast_if_small(spark.createDataFrame(bases, "part long, base long"))
    rank = F.col("base") + F.col("at").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    columns = scored.columns
    drawn = placed.withColumn("part", F.shiftright("at", _ROW_BITS)).join(bases, "part", "left").select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    return drawn.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """The drawn rows of docs, columns unchanged. Rows that agree in doc_id and text are drawn together."""
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    drawn = draw(score(docs.select("doc_id", "text", mark.alias("mark")), target, keep=("doc_id", "mark"), **options), percent, least_words)
    drawn = broadcast_if_small(checkpoint(drawn.where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()))
    return docs.join(drawn, docs["doc_id"].eqNullSafe(F.col("_id")) & (mark == F.col("_mark")), "left_semi")


def query(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Every document's weight, score and rank under the fixed settings."""
    return draw(score(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte over the distinct words, with its table made by a fold over eight bits.
ORACLE_SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda x: list_reduce([CAST(x AS BIGINT)] || range(8),
           lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS step),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
g AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT r, unnest(words) AS w FROM d),
gw AS (SELECT unnest(words) AS w FROM g),
b AS (
  SELECT w, xor(list_reduce([4294967295] || list_transform(range(len(hex(encode(w))) // 2), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
              lambda c, y: xor(c // 256, step[CAST(xor(c % 256, y) + 1 AS INT)])), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM gw), tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM gw JOIN b USING (w) GROUP BY bucket),
gain AS (
  SELECT e.bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM dw) + 10000 AS DOUBLE)
         / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM gw) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) e LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
u AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN b USING (w) JOIN gain USING (bucket) GROUP BY r),
x AS (
  SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN u USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM o) // 100 THEN rank END AS rank
FROM x LEFT JOIN o USING (r)
"""
