"""Selective-prediction metrics over scores.

scores: arm, case_id, expected, decision, forced_decision, criteria_coverage,
trap, provenance. All metrics are grouped by arm in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.functions.stats import clopper_pearson, share

ABSTAINED = "needs_review"


def answered() -> Column:
    return F.col("decision") != ABSTAINED


def correct() -> Column:
    return F.col("decision") == F.col("expected")


def unsafe(decision: str = "decision") -> Column:
    return (F.col(decision) == "eligible") & (F.col("expected") != "eligible")


def summary(scores: DataFrame) -> DataFrame:
    """One row an arm: cases, correct, unsafe, coverage, selective_risk, false_abstention, coverage_at_zero_unsafe, accuracy and its exact interval."""
    decidable = F.col("expected") != ABSTAINED
    counts = scores.groupBy("arm").agg(
        F.count("*").alias("cases"),
        F.count_if(correct()).alias("correct"),
        F.count_if(unsafe()).alias("unsafe"),
        F.count_if(answered()).alias("answered"),
        F.count_if(answered() & ~correct()).alias("wrong"),
        F.count_if(decidable).alias("decidable"),
        F.count_if(decidable & ~answered()).alias("abstained"),
    )
    interval = clopper_pearson(F.col("correct"), F.col("cases"))
    return counts.select(
        "arm", "cases", "correct", "unsafe",
        share(F.col("answered"), F.col("cases")).alias("coverage"),
        share(F.col("wrong"), F.col("answered")).alias("selective_risk"),
        share(F.col("abstained"), F.col("decidable")).alias("false_abstention"),
        F.when(F.col("unsafe") > 0, 0.0).otherwise(share(F.col("answered"), F.col("cases"))).alias("coverage_at_zero_unsafe"),
        share(F.col("correct"), F.col("cases")).alias("accuracy"),
        interval.alias("accuracy_interval"),
    )


def slices(scores: DataFrame) -> DataFrame:
    """arm, field, name, cases, correct, unsafe, abstained by trap, provenance and expected outcome, in one pass."""
    long = scores.select("arm", "decision", "expected", F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("name")) for x in ("trap", "provenance", "expected")])).alias("s"))
    return long.groupBy("arm", "s.field", "s.name").agg(F.count("*").alias("cases"), F.count_if(correct()).alias("correct"), F.count_if(unsafe()).alias("unsafe"), F.count_if(~answered()).alias("abstained"))


def balanced_accuracy(scores: DataFrame) -> DataFrame:
    """arm, balanced_accuracy: the mean accuracy over the outcomes that are expected at all."""
    by = scores.groupBy("arm", "expected").agg(share(F.count_if(correct()), F.count("*")).alias("accuracy"))
    return by.groupBy("arm").agg(F.avg("accuracy").alias("balanced_accuracy"))


def risk_coverage_curve(scores: DataFrame) -> DataFrame:
    """arm, threshold, coverage, risk, unsafe, answered for every coverage rounded to 6 places, and for 0.

    A case answers at a threshold up to its own, unrounded coverage, so one that
    rounds up drops out at its own threshold. Counts by exact coverage come
    first, and one running sum over those meets all thresholds.
    """
    by = scores.groupBy("arm", "criteria_coverage").agg(F.count("*").alias("n"), F.count_if(F.col("forced_decision") != F.col("expected")).alias("wrong"), F.count_if(unsafe("forced_decision")).alias("unsafe"))
    counts = ("n", "wrong", "unsafe")
    own = F.struct(F.col("criteria_coverage").alias("at"), F.lit(0).alias("threshold"), *counts)
    mark = lambda x: F.struct(x.alias("at"), F.lit(1).alias("threshold"), *[F.lit(0).cast("long").alias(c) for c in counts])
    rows = by.select("arm", F.explode(F.array(own, mark(F.round("criteria_coverage", 6)), mark(F.lit(0.0)))).alias("x")).select("arm", "x.*")
    # one running sum from the highest coverage down; those that reach a threshold come before it
    every = Window.partitionBy("arm")
    down = every.orderBy(F.desc("at"), "threshold").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("arm", "at", "threshold", *[F.sum(c).over(down).alias(c) for c in counts], F.sum("n").over(every).alias("cases"))
    met = rows.filter("threshold = 1 AND n > 0").select("arm", F.col("at").alias("threshold"), *counts, "cases").distinct()
    return met.select("arm", "threshold", share(F.col("n"), F.col("cases")).alias("coverage"), share(F.col("wrong"), F.col("n")).alias("risk"), "unsafe", F.col("n").alias("answered"))


def kappa(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """n, observed, expected, kappa of two raters; rows that one of them left out don't count."""
    cells = pairs.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(F.col(first).cast("string").alias("a"), F.col(second).cast("string").alias("b")).agg(F.count("*").alias("n"))
    n = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    sums = lambda x: cells.groupBy(F.col(x).alias("label")).agg(F.sum("n").alias(f"n_{x}"))
    chance = sums("a").join(sums("b"), "label").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("chance"))
    both = n.crossJoin(chance)  # two single rows
    seen, by_chance = F.col("agree") / F.col("n"), F.coalesce("chance", F.lit(0)) / (F.col("n") * F.col("n"))
    return both.select("n", seen.alias("observed"), by_chance.alias("expected"), F.try_divide(seen - by_chance, 1 - by_chance).alias("kappa"))


def most_accurate(summaries: DataFrame) -> DataFrame:
    """arm, accuracy of the best arm that reads no chart (always_ or random), the base rate to beat."""
    degenerate = summaries.filter(F.col("arm").startswith("always_") | (F.col("arm") == "random"))
    return degenerate.orderBy(F.desc("accuracy"), "arm").limit(1).select("arm", "accuracy")


def cost_rollup(steps: DataFrame) -> DataFrame:
    """agent (null: all), calls, priced, unpriced, usd of recorded calls; steps: agent, usd."""
    return steps.rollup("agent").agg(F.count("*").alias("calls"), F.count("usd").alias("priced"), F.count_if(F.col("usd").isNull()).alias("unpriced"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))
