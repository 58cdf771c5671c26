"""A text-classification baseline: TF-IDF over code tokens and logistic regression.

Inverse document frequency follows ln((1 + n) / (1 + df)) + 1 with L2-normalised rows: Spark's own IDF lacks the + 1,
so the vector of counts is added to it. Classes are weighted to balance, and regParam is 1 / (C * sum of weights).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z_]\w*|[^\w\s]"


def build_pipeline(weight_sum: float, max_features: int = 5000, c: float = 1.0, max_iter: int = 1000) -> Pipeline:
    """Stages from column `code` and `label` to `prediction` and `probability`."""
    return Pipeline(stages=[
        SQLTransformer(statement="SELECT *, coalesce(code, '') AS _text FROM __THIS__"),
        RegexTokenizer(inputCol="_text", outputCol="_one", pattern=TOKEN, gaps=False, toLowercase=False, minTokenLength=1),
        NGram(n=2, inputCol="_one", outputCol="_two"),
        SQLTransformer(statement="SELECT *, concat(_one, _two) AS _grams FROM __THIS__"),
        CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=max_features),
        IDF(inputCol="_tf", outputCol="_idf"),
        VectorAssembler(inputCols=["_idf", "_tf"], outputCol="_sum"),
        Normalizer(inputCol="_sum", outputCol="features", p=2.0),
        LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1.0 / (c * max(weight_sum, 1.0)), standardization=False, maxIter=max_iter),
    ])


def fit(rows: DataFrame, **options) -> PipelineModel:
    """A model of rows (code, label 0 or 1), each class weighted by n / (2 * its size)."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    weight = F.coalesce(*[F.when(F.col("label") == k, F.lit(total / (len(counts) * n))) for k, n in counts.items()], F.lit(1.0))
    weighted = rows.withColumn("label", F.col("label").cast("double")).withColumn("weight", weight)
    return build_pipeline(float(total), **options).fit(weighted)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with prediction and the probability of class 1."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows)
    return scored.select(*rows.columns, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("probability"))


def save(model: PipelineModel, path: str) -> None:
    """Write a model, replacing what is there."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """Read a model."""
    return PipelineModel.load(path)
