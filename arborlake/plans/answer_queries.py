"""Queries of answers inside free text: each turn of a conversation stands in a reply of one of ten forms, and is found again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import json_text
from arborlake.session import table

QUERIES, SQL = {}, {}


def replies(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, reply): an object in each turn's reply holds its text, under an odd spelling of a status."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    status = F.element_at(F.array(*map(F.lit, ("Safe", "vuln", "Needs more evidence", "vulnerable"))), (F.pmod("conv_id", F.lit(4)) + 1).cast("int"))
    named = [F.col("conv_id").alias("id"), status.alias("decision_status")]
    fields = F.struct(*named, F.col("text").alias("note"))
    whole, prose = F.to_json(fields), F.translate("text", '[]{}"<>', "")
    cut = F.to_json(F.struct(*named, F.expr("left(text, cast(length(text) div 2 as int))").alias("note")))
    deep = F.to_json(F.struct(*named, F.array(F.struct(F.col("text").alias("note"))).alias("items")))
    forms = [
        whole,
        F.concat(F.lit("```json\n"), whole, F.lit("\n```")),
        F.concat(prose, F.lit(" void f(char *d) { d[0] = 1; } so: "), whole, F.lit(" as said.")),
        F.concat(F.lit("<thinking>"), prose, F.lit(' {"id": 0} </thinking><answer>'), whole, F.lit("</answer>")),
        F.concat(F.lit('<answer>{"id": -1}</answer> rather: < ANSWER >'), whole, F.lit("</ answer ><answer>{")),
        F.to_json(F.struct(prose.alias("thinking"), fields.alias("answer"))),
        F.to_json(F.struct(prose.alias("thinking"), whole.alias("answer"))),
        F.expr("left(x, length(x) - 2)").alias("cut"),
        prose,
        F.expr("left(y, length(y) - 4)").alias("deep"),
    ]
    form = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(forms)))
    chosen = F.coalesce(*[F.when(form == i, reply) for i, reply in enumerate(forms)])
    return rows.withColumns({"x": cut, "y": deep}).select("conv_id", "turn", chosen.alias("reply"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """What is read from each reply."""
    found = replies(spark, d).select("conv_id", "turn", json_text.answer(F.col("reply")).alias("a"))
    value = lambda path: F.get_json_object("a.value", path)
    note = F.coalesce(value("$.note"), value("$.items[0].note"))
    return found.select("conv_id", "turn", "a.source", "a.thinking", "a.how", value("$.id").cast("long").alias("id"), value("$.decision_status").alias("status"), F.md5(note).alias("note_md5"), F.size("a.notes").alias("changes"))


QUERIES["answers_in_replies"] = _answers
SQL["answers_in_replies"] = """
WITH f AS (SELECT conv_id, turn, coalesce(text, '') AS text, (conv_id * 7 + turn) % 10 AS form, conv_id % 4 AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN form IN (3, 4) THEN 'answer_tag' WHEN form IN (5, 6) THEN 'json_key_answer' WHEN form = 8 THEN 'none' ELSE 'bare' END AS source, form = 3 AS thinking,
  CASE WHEN form = 2 THEN 'span' WHEN form IN (7, 9) THEN 'closed' WHEN form = 8 THEN 'none' ELSE 'whole' END AS how,
  CASE WHEN form <> 8 THEN conv_id END AS id, CASE WHEN form <> 8 THEN (['non_vulnerable', 'vulnerable', 'inconclusive', 'vulnerable'])[s + 1] END AS status,
  CASE WHEN form = 7 THEN md5(rtrim(left(text, length(text) // 2))) WHEN form = 9 THEN md5(rtrim(text)) WHEN form <> 8 THEN md5(text) END AS note_md5,
  CAST(CASE WHEN form <> 8 AND s < 3 THEN 1 ELSE 0 END AS INTEGER) AS changes
FROM f
"""


def _forms(spark: SparkSession, d: str) -> DataFrame:
    """How many replies were read in which way."""
    return _answers(spark, d).groupBy("source", "how", "status").agg(F.count(F.lit(1)).alias("n"))


QUERIES["answer_forms"] = _forms
SQL["answer_forms"] = f"SELECT source, how, status, count(*) AS n FROM ({SQL['answers_in_replies']}) GROUP BY ALL"
