"""A corpus pipeline of five stages over documents, each by one operator of arborlake.llm.

Stages run in order; each is written as Parquet and reread as the next one's input. Language ID drops documents in
which no language can be told, exact dedup keeps the largest doc_id of equal texts, near-dedup the smallest doc_id of
each group of texts linked by similar sets of five-word shingles, mixing repeats or leaves out documents until each source meets its target and puts
them in training order, and encoding adds the ids of the pieces.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm import exact_dedup, language_id, mixing, near_copies, sentencepiece_codec


def _free(docs: DataFrame, name: str) -> str:
    """The name, with bars in front if docs has it."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text gives enough evidence of a language; lang is that language. The model learns from the labels in docs."""
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    lang = _free(docs, "lang_pred")
    rows = language_id.evident(docs, model, tuple(docs.columns), lang).where(F.col(lang) != language_id.NONE)
    return rows.withColumn("lang", F.col(lang)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text, the one with the largest doc_id."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near copies (five-word shingles, similarity 0.8 or more), the one with the smallest doc_id."""
    return near_copies.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces."""
    return sentencepiece_codec.encode(docs, tuple(docs.columns), name=_free(docs, "ids"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Two stages have no SQL form: the n-gram filter model and the piece encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; intermediate tables go to the shared checkpoint folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="corpus-pipeline")
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{at}/{i}-{name}")
        docs = spark.read.parquet(f"{at}/{i}-{name}")
    return docs
