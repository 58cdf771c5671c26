"""Evaluation: outcomes, metrics with abstentions, usage, runtime, projections and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that are no decision.
INVALID_STATUSES = ("parse_failed", "inconclusive", "invalid", "error")


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b as a double; `empty` if b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(empty).cast("double"))


def valid_decision(status: Column, parse_error: Column) -> Column:
    """Whether a prediction is a decision: parsed, and with no status that stands for none."""
    return F.coalesce(parse_error, F.lit("")).eqNullSafe("") & ~F.coalesce(status, F.lit("")).isin(*INVALID_STATUSES)


def outcomes(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """(sample_id, truth, pred, outcome) for every sample: TP, TN, FP, FN, INVALID or MISSING."""
    p = predictions.select("sample_id", F.coalesce("is_vulnerable", F.lit(False)).alias("pred"), valid_decision(F.col("decision_status"), F.col("parse_error")).alias("valid"), F.lit(True).alias("there"))
    rows = samples.select("sample_id", F.coalesce("is_vulnerable", F.lit(False)).alias("truth")).join(p, "sample_id", "left")
    hit = F.when(F.col("truth") & F.col("pred"), "TP").when(~F.col("truth") & ~F.col("pred"), "TN").when(F.col("pred"), "FP").otherwise("FN")
    return rows.select("sample_id", "truth", "pred", F.when(F.col("there").isNull(), "MISSING").when(~F.col("valid"), "INVALID").otherwise(hit).alias("outcome"))


def _rates(tp: Column, tn: Column, fp: Column, fn: Column, empty: float | None) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp, empty), ratio(tp, tp + fn, empty)
    return {"accuracy": ratio(tp + tn, tp + tn + fp + fn, empty), "precision": precision, "recall": recall, "f1": ratio(2 * tp, 2 * tp + fp + fn, empty)}


def binary_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates over outcomes, in one pass: strict on decisions only, and with everything else as wrong. Empty rates are 0."""
    count = lambda name: F.count_if(F.col("outcome") == name)
    counts = rows.groupBy(*(by or [])).agg(*[count(n).alias(n.lower()) for n in ("TP", "TN", "FP", "FN", "INVALID", "MISSING")])
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    valid = tp + tn + fp + fn
    out = counts.withColumns({"n_valid": valid, "n_total": valid + F.col("invalid") + F.col("missing"), **_rates(tp, tn, fp, fn, 0.0)})
    out = out.withColumns({"specificity": ratio(tn, tn + fp), "accuracy_all": ratio(tp + tn, F.col("n_total")), "false_positive_rate": ratio(fp, fp + tn), "false_negative_rate": ratio(fn, fn + tp)})
    return out.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def compatible_metrics(rows: DataFrame) -> DataFrame:
    """The same rates with every prediction read as its raw boolean; missing ones are left out."""
    both = lambda t, p: F.count_if((F.col("truth") == t) & (F.col("pred") == p))
    counts = rows.where("pred IS NOT NULL").agg(both(True, True).alias("tp"), both(False, False).alias("tn"), both(False, True).alias("fp"), both(True, False).alias("fn"))
    return counts.withColumns(_rates(*(F.col(c) for c in ("tp", "tn", "fp", "fn")), 0.0))


def live_metrics(rows: DataFrame) -> DataFrame:
    """Metrics of a run in progress over (status, forced, pred, truth): rates are null, not 0, where nothing counts.

    A row is skipped, failed or inconclusive by its status; otherwise it is completed, and its decision is the forced
    one where there is one.
    """
    status = F.lower(F.coalesce("status", F.lit("")))
    state = F.when(status.startswith("skip"), "skipped").when(status.isin("failed", "error", "parse_failed"), "failed").when(status.isin("inconclusive", "abstain", "unknown") & F.col("forced").isNull(), "inconclusive").otherwise("completed")
    decided = F.coalesce("forced", "pred")
    rows = rows.withColumn("state", state).withColumn("decided", F.when(F.col("state") == "completed", decided))
    both = lambda t, p: F.count_if((F.col("truth") == t) & (F.col("decided") == p))
    counts = rows.agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("completed", "failed", "skipped", "inconclusive")],
        both(True, True).alias("tp"), both(False, False).alias("tn"), both(False, True).alias("fp"), both(True, False).alias("fn"),
    )
    return counts.withColumns(_rates(*(F.col(c) for c in ("tp", "tn", "fp", "fn")), None))


def submission_score(labels: DataFrame, submission: DataFrame) -> DataFrame:
    """(n, correct, accuracy) over ids that both have."""
    joined = labels.join(submission, "sample_id")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("correct")).withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def usage_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums and averages of tokens and cost; estimated only if every row is."""
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    out = rows.groupBy(*(by or [])).agg(
        zero("prompt_tokens").alias("prompt_tokens"), zero("completion_tokens").alias("completion_tokens"), zero("total_tokens").alias("total_tokens"),
        zero("cost").alias("cost"), F.bool_and(F.coalesce("estimated", F.lit(True))).alias("estimated"), F.count(F.lit(1)).alias("n"),
    )
    return out.withColumns({"avg_tokens": ratio(F.col("total_tokens"), F.col("n")), "avg_cost": ratio(F.col("cost"), F.col("n"))})


def runtime_rollup(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, seconds, avg_seconds, most_seconds, per_minute)."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("most_seconds"))
    return out.withColumns({"avg_seconds": ratio(F.col("seconds"), F.col("n")), "per_minute": ratio(F.col("n") * 60, F.col("seconds"))})


def projection_grid(summary: DataFrame, samples: list[int], projects: list[int]) -> DataFrame:
    """Linear projection of a one-row summary (per_sample, per_project) over two short lists."""
    grid = summary.select("per_sample", "per_project", F.explode(F.array(*map(F.lit, samples))).alias("samples"))
    grid = grid.select("*", F.explode(F.array(*map(F.lit, projects))).alias("projects"))
    return grid.select("samples", "projects", (F.col("per_sample") * F.col("samples") + F.col("per_project") * F.col("projects")).alias("seconds"))


#: Obligations that speak of a missing guard, the family that may be proven at source level, and the tiers.
GUARD_OBLIGATIONS = ("missing_remaining_bound_guard", "missing_pre_advance_bound_guard", "missing_guard_or_invariant", "missing_domain_guard")
SOURCE_LEVEL_FAMILY = "parser_scaled_pointer_traversal"
CONFIRMED_TIERS = ("confirmed_source_level_vulnerability", "confirmed_reachable_vulnerability")
#: Statuses that withdraw a confirmation, those of them that refute, and the one that is withdrawn.
REFUTING_STATUSES = ("refuted_by_guard", "refuted_by_caller_constraint", "refuted_by_patch_or_changed_logic", "irrelevant_to_target_function")
UNSUPPORTED_STATUSES = ("plausible_but_unproven", *REFUTING_STATUSES, "insufficient_evidence")
CONFIRMED = "confirmed_vulnerability"


def judged(obligations: DataFrame, results: DataFrame) -> DataFrame:
    """obligations (hypothesis_id, obligation_id, name, required, polarity) with result, supports and refutes.

    An obligation that speaks against its hypothesis refutes it when proven; one that speaks for it supports it when
    proven and refutes it when refuted.
    """
    rows = obligations.join(results.select("hypothesis_id", "obligation_id", "result"), ["hypothesis_id", "obligation_id"], "left")
    against, result = F.coalesce("polarity", F.lit("supports_hypothesis")) == "refutes_hypothesis", F.coalesce("result", F.lit("not_answered"))
    return rows.withColumns({"supports": ~against & (result == "proven"), "refutes": F.when(against, result == "proven").otherwise(result == "refuted"), "against": against})


def ledger(obligations: DataFrame, results: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """One row for each hypothesis (hypothesis_id, family, boundary): required obligations, how many are proven and open, and its tier.

    boundary is the strength of its trust boundary. Refuted is what a required obligation, or one that speaks against
    it, refutes; complete is what has all required ones proven; of the rest, three proven with a missing guard among
    them are a strong signal.
    """
    rows = judged(obligations, results)
    proven = F.col("required") & F.col("supports")
    sums = rows.groupBy("hypothesis_id").agg(
        F.count_if("required").alias("required"), F.count_if(proven).alias("proven"), F.count_if(F.col("required") & ~proven).alias("open"),
        F.bool_or(F.col("refutes") & (F.col("required") | F.col("against"))).alias("refuted"), F.bool_or(F.col("supports") & F.col("name").isin(*GUARD_OBLIGATIONS)).alias("guard"),
    )
    source_level = (F.col("family") == SOURCE_LEVEL_FAMILY) & (F.col("boundary") == "source_level")
    complete = F.when(source_level, CONFIRMED_TIERS[0]).otherwise(CONFIRMED_TIERS[1])
    tier = (
        F.when(F.col("refuted"), "refuted").when((F.col("required") > 0) & (F.col("proven") == F.col("required")), complete)
        .when((F.col("proven") >= 3) & F.col("guard"), "high_signal_incomplete").otherwise("incomplete")
    )
    return hypotheses.join(sums, "hypothesis_id").select("hypothesis_id", "required", "proven", "open", "refuted", tier.alias("tier"))


def downgrade(hypotheses: DataFrame, findings: DataFrame) -> DataFrame:
    """hypotheses (hypothesis_id, status, tier) with the state left after counter-review.

    findings are (hypothesis_id, seq, recommended, effect, concrete), applied in order of seq. One that recommends to
    withdraw applies if the status is a confirmation, or if its effect is to refute or weaken. A hypothesis of a
    confirmed tier is withdrawn only by concrete counter-evidence, and confirmed otherwise. The findings of one
    hypothesis are held together.
    """
    one = F.struct("seq", F.coalesce("recommended", F.lit("")).alias("recommended"), F.lower(F.coalesce("effect", F.lit(""))).alias("effect"), F.coalesce("concrete", F.lit(False)).alias("concrete"))
    lists = findings.groupBy("hypothesis_id").agg(F.array_sort(F.collect_list(one)).alias("_found"))
    rows = hypotheses.join(lists, "hypothesis_id", "left")
    confirmed_tier = F.coalesce(F.col("tier").isin(*CONFIRMED_TIERS), F.lit(False))

    def step(state, x):
        wants = x["recommended"].isin(*UNSUPPORTED_STATUSES) & ((state["status"] == CONFIRMED) | F.contains(x["effect"], F.lit("refut")) | F.contains(x["effect"], F.lit("weaken")))
        kept = confirmed_tier & ~x["concrete"]
        status = F.when(~wants, state["status"]).when(kept, F.lit(CONFIRMED)).otherwise(x["recommended"])
        lowered = F.when(x["recommended"].isin(*REFUTING_STATUSES), "refuted").when(confirmed_tier, "high_signal_incomplete").otherwise(state["tier"])
        return F.struct(status.alias("status"), F.when(~wants | kept, state["tier"]).otherwise(lowered).alias("tier"))

    begin = F.struct(F.coalesce("status", F.lit("")).alias("status"), F.coalesce("tier", F.lit("")).alias("tier"))
    state = F.coalesce(F.aggregate("_found", begin, step), begin)
    return rows.withColumn("_state", state).withColumns({"status": F.col("_state.status"), "tier": F.col("_state.tier")}).drop("_state", "_found")


def proof_gate(rows: DataFrame, fields: list[str], existing: DataFrame) -> DataFrame:
    """rows with `passes`: every field is filled and every cited id exists. cited is an array; existing has evidence_id."""
    cited = rows.select("hypothesis_id", F.explode("cited").alias("evidence_id")).join(existing.select("evidence_id"), "evidence_id", "left_anti")
    missing = cited.groupBy("hypothesis_id").agg(F.count(F.lit(1)).alias("missing"))
    filled = [F.coalesce(F.trim(F.col(f)), F.lit("")) != "" for f in fields]
    ok = F.col("missing").isNull() & (F.size("cited") > 0)
    for f in filled:
        ok = ok & f
    return rows.join(missing, "hypothesis_id", "left").withColumn("passes", ok).drop("missing")


def registry_check(public: DataFrame, registry: DataFrame, labels: DataFrame, graphs: DataFrame) -> DataFrame:
    """(kg_id, violation) of every public row whose registry entry, label or graph is missing."""
    has = lambda df, name: df.select("kg_id", F.lit(True).alias(name)).distinct()
    rows = public.select("kg_id").join(has(registry, "r"), "kg_id", "left").join(has(labels, "l"), "kg_id", "left").join(has(graphs, "g"), "kg_id", "left")
    found = F.array_compact(F.array(F.when(F.col("r").isNull(), "no_registry"), F.when(F.col("l").isNull(), "no_label"), F.when(F.col("g").isNull(), "no_graph")))
    return rows.select("kg_id", F.explode(found).alias("violation"))


def stage_calls(stages: DataFrame, calls: DataFrame) -> DataFrame:
    """stages with the first model call of each, by seq."""
    first = calls.groupBy("stage").agg(F.min_by(F.struct(*[c for c in calls.columns if c != "stage"]), "seq").alias("call"))
    return stages.join(first, "stage", "left")


def project_rows(rows: DataFrame, role: str, private: list[str]) -> DataFrame:
    """rows as a role may see them: only an admin sees the private columns."""
    return rows if role == "admin" else rows.drop(*private)


def leaks(rows: DataFrame, tokens: list[str], column: str = "kg_id") -> DataFrame:
    """Rows whose id holds a forbidden token, in any case."""
    low = F.lower(F.col(column).cast("string"))
    return rows.where(F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(low, t)))


def dedupe_hypotheses(rows: DataFrame) -> DataFrame:
    """The best row of each signature, the first of equal ones by seq, best first."""
    best = Window.partitionBy("signature").orderBy(F.desc("score"), "seq")
    return rows.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place").orderBy(F.desc("score"), "seq")
