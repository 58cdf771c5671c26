"""Batches of texts between Spark and Python are bounded in bytes."""

from pyspark.sql import functions as F

from arborlake.llm import texts


def test_texts_come_in_bounded_batches(spark):
    import pyarrow as pa
    from pyspark.sql import types as T

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdefgh"), 1000).alias("text"))

    def start():
        return lambda texts: [pa.array([len(texts)] * len(texts), pa.int64())]

    try:
        out = texts.map_texts(docs, ["doc_id"], [T.StructField("n", T.LongType())], start, 10**9)
        assert out.agg(F.max("n")).first()[0] < 2000 and out.count() == 6000
        spark.conf.set(setting, "1m")
        texts.map_texts(docs, ["doc_id"], [T.StructField("n", T.LongType())], start)
        assert spark.conf.get(setting) in ("1m", "1048576", "1048576b")
    finally:
        spark.conf.unset(setting)
