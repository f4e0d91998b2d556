"""Arms of an evaluation: their scores, tables for a report, comparisons between keys.

scores: arm, case_id, expected, decision, forced_decision, criteria_coverage,
trap, provenance. A case that could not be run is a failure and no abstention.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.functions.stats import share
from screenlake.operators import metrics

CASE = ("case_id", "expected", "trap", "provenance")


def degenerate(arm: str = "arm") -> Column:
    """Whether an arm answers without reading a chart, by its name."""
    return F.col(arm).startswith("always_") | (F.col(arm) == "random")


def screened(cases: DataFrame, screenings: DataFrame, arm: str) -> tuple[DataFrame, DataFrame]:
    """Scores of an arm that screens, and its failures (arm, case_id, stage): cases without a screening. Both by nct_id and patient_id."""
    found = screenings.select("nct_id", "patient_id", "decision", "forced_decision", F.col("coverage").alias("criteria_coverage"), F.lit(True).alias("ran"))
    rows = cases.join(found, ["nct_id", "patient_id"], "left")
    scores = rows.filter("ran").select(F.lit(arm).alias("arm"), *CASE, "decision", "forced_decision", "criteria_coverage")
    return scores, rows.filter("ran IS NULL").select(F.lit(arm).alias("arm"), "case_id", F.lit("screen").alias("stage"))


def answered(cases: DataFrame, decision: Column, arm: str) -> DataFrame:
    """Scores of an arm that gives one answer for each case, at full coverage; null answers are failures and leave no score."""
    rows = cases.withColumn("decision", decision).filter("decision IS NOT NULL")
    return rows.select(F.lit(arm).alias("arm"), *CASE, "decision", F.col("decision").alias("forced_decision"), F.lit(1.0).alias("criteria_coverage"))


def fixed(cases: DataFrame) -> DataFrame:
    """The three arms that always give the same answer."""
    outcomes = F.explode(F.array(*[F.lit(x) for x in ("eligible", "ineligible", "needs_review")]))
    rows = cases.withColumn("decision", outcomes)
    return rows.select(F.concat(F.lit("always_"), "decision").alias("arm"), *CASE, "decision", F.col("decision").alias("forced_decision"), F.lit(1.0).alias("criteria_coverage"))


def recorded(cases: DataFrame, answers: DataFrame, arm: str) -> DataFrame:
    """An arm whose answers (case_id, decision) were recorded: a prompt, or draws of a generator that can't be repeated here."""
    return answered(cases.join(answers.select("case_id", F.col("decision").alias("said")), "case_id", "left"), F.col("said"), arm)


def report(scores: DataFrame) -> DataFrame:
    """metrics.summary with the balanced accuracy, real arms first and those that read no chart last, by name."""
    out = metrics.summary(scores).join(metrics.balanced_accuracy(scores), "arm").withColumn("degenerate", degenerate())
    return out.withColumn("place", F.row_number().over(Window.orderBy("degenerate", "arm")))  # a row an arm


def by_expected(scores: DataFrame) -> DataFrame:
    """expected, cases and a column for each arm: correct answers of cases, as 3/5."""
    rows = scores.groupBy("expected", "arm").agg(F.concat(F.count_if(metrics.correct()).cast("string"), F.lit("/"), F.count("*").cast("string")).alias("cell"), F.count("*").alias("n"))
    return rows.groupBy("expected").agg(F.max("n").alias("cases")).join(rows.groupBy("expected").pivot("arm").agg(F.first("cell")), "expected")


def by_trap(scores: DataFrame) -> DataFrame:
    """trap and a column for each arm: correct of cases, and unsafe."""
    n = lambda c: c.cast("string")
    rows = scores.groupBy("trap", "arm").agg(F.concat(n(F.count_if(metrics.correct())), F.lit("/"), n(F.count("*")), F.lit(" correct, "), n(F.count_if(metrics.unsafe())), F.lit(" unsafe")).alias("cell"))
    return rows.groupBy("trap").pivot("arm").agg(F.first("cell"))


def compare(here: DataFrame, there: DataFrame) -> DataFrame:
    """arm, accuracy, unsafe under one key and, if there, under another; the same decisions, so that the key makes the difference."""
    of = lambda df, tail: df.groupBy("arm").agg(share(F.count_if(metrics.correct()), F.count("*")).alias(f"accuracy{tail}"), F.count_if(metrics.unsafe()).alias(f"unsafe{tail}"))
    return of(here, "").join(of(there, "_there"), "arm", "left").withColumn("degenerate", degenerate())


def moved(comparison: DataFrame) -> DataFrame:
    """Arms in both that commit an unsafe error under one key only: where there is none, the conclusion stands."""
    return comparison.filter(F.col("unsafe_there").isNotNull() & ((F.col("unsafe") > 0) != (F.col("unsafe_there") > 0))).select("arm")


def interval_width(summaries: DataFrame) -> DataFrame:
    """width: the median width of the accuracy intervals."""
    return summaries.agg(F.percentile(F.col("accuracy_interval.high") - F.col("accuracy_interval.low"), 0.5).alias("width"))


def base_rate(scores: DataFrame) -> DataFrame:
    """arm, accuracy, balanced_accuracy, expected, cases_expected, cases: the best arm that reads no chart, beside the commonest expected outcome."""
    rows = scores.filter(degenerate())
    best = report(rows).orderBy(F.desc("accuracy"), "arm").limit(1).select("arm", "accuracy", "balanced_accuracy", "cases")
    largest = rows.groupBy("arm", "expected").agg(F.count("*").alias("cases_expected"))
    common = largest.groupBy("arm").agg(F.max(F.struct("cases_expected", "expected")).alias("x")).select("arm", "x.*")
    return best.join(common, "arm")


def cohort(measured: DataFrame, reasons: DataFrame) -> DataFrame:
    """nct_id, decision, n, mean_resolved, least_gaps, most_gaps: screenings by decision, with the open criteria that a query could close.

    measured: screening.measures(...) with nct_id; reasons: reasons.explain(...).
    """
    gaps = reasons.filter("verdict IS NULL AND blocking AND query <> ''").groupBy("nct_id", "patient_id").agg(F.count("*").alias("gaps"))
    rows = measured.select("nct_id", "patient_id", "decision", "criteria_resolved").join(gaps, ["nct_id", "patient_id"], "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    return rows.groupBy("nct_id", "decision").agg(F.count("*").alias("n"), F.avg("criteria_resolved").alias("mean_resolved"), F.min("gaps").alias("least_gaps"), F.max("gaps").alias("most_gaps"))


def span_coverage(claims: DataFrame) -> DataFrame:
    """claimed, spans: summed over protocols and not averaged. claims: protocol_text.claims(...)."""
    return claims.agg(F.count_if(F.col("claim") != "unclaimed").alias("claimed"), F.count("*").alias("spans"))


def write(scores: DataFrame, path: str) -> None:
    """Scores as JSON, a folder an arm; what a report needs is counted again from them."""
    scores.repartition("arm").write.mode("overwrite").partitionBy("arm").json(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema("case_id string, expected string, trap string, provenance string, decision string, forced_decision string, criteria_coverage double, arm string").json(path)
