"""Text similarity: matching-block ratios, target validation, greedy statement matching, target location.

Equality and length bounds are checked with built-in expressions first; only rows that are left reach Python, in
Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions.text import code_tokens, gold_statements, normalize_code

EXACT, NEAR, APPROXIMATE = 1.0, 0.98, 0.82
STATEMENT_THRESHOLD = 0.84
LOCATE_THRESHOLD = 0.4


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def _bound(a: str, b: str) -> float:
    """What the ratio of two texts is at most: the characters that both hold, in any order."""
    if not a or not b:
        return 0.0 if a or b else 1.0
    return 2.0 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


def best_ratio(pairs: list[tuple[str, str]]) -> float:
    """The greatest plain ratio (nothing is junk) of the pairs.

    A pair whose bound is no more than what another one reached is not compared, and a text that is a part of the other
    is its longest match, so that its ratio follows from the lengths.
    """
    best = -1.0
    for bound, a, b in sorted(((_bound(a, b), a, b) for a, b in dict.fromkeys(pairs)), reverse=True):
        if bound <= best:
            break
        part = len(a) and len(b) and (a in b or b in a)
        best = max(best, bound if part else SequenceMatcher(None, a, b, autojunk=False).ratio())
    return best


@F.pandas_udf(T.DoubleType())
def _best_ratio(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series) -> pd.Series:
    return pd.Series([best_ratio([(x[i] or "", x[i + 1] or "") for i in (0, 2, 4)]) for x in zip(a, b, c, d, e, f, strict=True)], dtype="float64")


def with_similarity(rows: DataFrame, a: str, b: str, name: str = "similarity", least: float = 0.0) -> DataFrame:
    """rows with the ratio of two code texts, comments and spacing aside: 0 if one is blank, 1 if they are equal.

    Pairs whose lengths alone keep them below `least` get that bound, which is no smaller than their ratio.
    """
    x, y = normalize_code(F.coalesce(a, F.lit(""))), normalize_code(F.coalesce(b, F.lit("")))
    rows = rows.withColumns({"_x": x, "_y": y})
    bound = 2.0 * F.least(F.length("_x"), F.length("_y")) / (F.length("_x") + F.length("_y"))
    blank, same = (F.col("_x") == "") | (F.col("_y") == ""), F.col("_x") == F.col("_y")
    easy = F.when(blank, 0.0).when(same, 1.0).when(bound < least, bound)
    rows = rows.withColumn("_easy", easy)
    # a Python expression is evaluated for all rows it is given, so rows that need none give it empty texts
    hard = F.col("_easy").isNull()
    ratio = _ratio(F.when(hard, F.col("_x")).otherwise(""), F.when(hard, F.col("_y")).otherwise(""))
    return rows.withColumn(name, F.coalesce("_easy", ratio)).drop("_x", "_y", "_easy")


def validate_targets(rows: DataFrame, found: str = "found", wanted: str = "wanted") -> DataFrame:
    """rows with `status`, `similarity` and digests: exact, near exact, approximate, or a mismatch; a missing text is not_found.

    Texts are compared raw, without white space, and as tokens without comments; the best of the three counts.
    """
    a, b = F.col(found), F.col(wanted)
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    tokens = lambda c: F.array_join(code_tokens(c), "\n")
    exact = (a == b) | (squeeze(a) == squeeze(b)) | (tokens(a) == tokens(b))
    rows = rows.withColumns({"_exact": exact, "found_sha256": F.sha2(F.encode(a, "UTF-8"), 256), "wanted_sha256": F.sha2(F.encode(b, "UTF-8"), 256)})
    hard = F.col("_exact").eqNullSafe(False)
    give = lambda c: F.when(hard, c).otherwise("")
    score = _best_ratio(give(a), give(b), give(squeeze(a)), give(squeeze(b)), give(tokens(a)), give(tokens(b)))
    rows = rows.withColumn("similarity", F.when(F.col("_exact"), 1.0).when(hard, score))
    status = F.when(a.isNull() | b.isNull(), "not_found").when(F.col("_exact"), "match_exact").when(F.col("similarity") >= NEAR, "match_near_exact").when(F.col("similarity") >= APPROXIMATE, "match_approximate").otherwise("body_mismatch")
    return rows.withColumn("status", status).drop("_exact")


def match_statements(samples: DataFrame, predictions: DataFrame, threshold: float = STATEMENT_THRESHOLD) -> DataFrame:
    """(sample_id, gold, predicted, matched): one-to-one matches of gold statements to predicted ones, greedily in gold order.

    Each gold statement takes the unused prediction of highest ratio, the first of equal ones, if it reaches the
    threshold. Samples without a prediction row are left out.
    """
    gold = samples.select("sample_id", gold_statements(F.col("changed_statements")).alias("gold"))
    joined = gold.join(predictions.select("sample_id", F.filter("statements", lambda s: F.coalesce(s, F.lit("")) != "").alias("predicted")), "sample_id")
    clean = lambda c: F.transform(c, normalize_code)

    @F.pandas_udf(T.IntegerType())
    def matched(golds: pd.Series, predicted: pd.Series) -> pd.Series:
        out = []
        for gs, ps in zip(golds, predicted, strict=True):
            used: set[int] = set()
            for g in gs:
                best, at = 0.0, -1
                for i, p in enumerate(ps):
                    if i in used or not g or not p or 2 * min(len(g), len(p)) < max(best, threshold) * (len(g) + len(p)):
                        continue
                    ratio = SequenceMatcher(None, g, p).ratio()
                    if ratio > best:
                        best, at = ratio, i
                if at >= 0 and best >= threshold:
                    used.add(at)
            out.append(len(used))
        return pd.Series(out, dtype="int32")

    return joined.select("sample_id", F.size("gold").alias("gold"), F.size("predicted").alias("predicted"), matched(clean(F.col("gold")), clean(F.col("predicted"))).alias("matched"))


def statement_metrics(matches: DataFrame) -> DataFrame:
    """One row of precision, recall and F1 over all matches; 0 where nothing counts."""
    sums = matches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gold", "predicted", "matched")])
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return sums.withColumns({"precision": div(F.col("matched"), F.col("predicted")), "recall": div(F.col("matched"), F.col("gold")), "f1": div(2.0 * F.col("matched"), F.col("gold") + F.col("predicted"))})


def locate_targets(samples: DataFrame, functions: DataFrame) -> DataFrame:
    """(sample_id, node_id, score): the function of each sample: by name and path 1.0, by name 0.7, else the most similar body above 0.4.

    Bodies are compared only for samples that no name finds, and only inside their file.
    """
    f = functions.select(F.col("id").alias("node_id"), F.col("name").alias("func_name"), F.col("file").alias("filepath"), F.col("code").alias("body"))
    exact = samples.join(f.groupBy("func_name", "filepath").agg(F.min("node_id").alias("node_id")), ["func_name", "filepath"]).select("sample_id", "node_id", F.lit(1.0).alias("score"))
    left = samples.join(exact, "sample_id", "left_anti")
    named = left.join(f.groupBy("func_name").agg(F.min("node_id").alias("node_id")), "func_name").select("sample_id", "node_id", F.lit(0.7).alias("score"))
    rest = left.join(named, "sample_id", "left_anti").select("sample_id", "filepath", "func_body")
    compared = with_similarity(rest.join(f.select("node_id", "filepath", "body"), "filepath"), "func_body", "body", "score", LOCATE_THRESHOLD).where(F.col("score") > LOCATE_THRESHOLD)
    best = compared.groupBy("sample_id").agg(F.min_by(F.struct("node_id", "score"), F.struct((-F.col("score")).alias("s"), "node_id")).alias("b")).select("sample_id", "b.*")
    return exact.unionByName(named).unionByName(best)
