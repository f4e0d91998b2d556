"""A reviewer's queue of screenings: filters, orders, and constructed charts beside their source.

rows: nct_id, patient_id, decision, criteria_total, criteria_resolved,
open_retrievable, open_person, and for constructed charts case_id,
base_patient_id and edits (array of sentences).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEARCHED = ("patient_id", "patient_summary", "blocking", "blocked_by", "blocking_criterion_id", "case_id", "deciding_ids", "edits")


def rows(measured: DataFrame, reasons: DataFrame) -> DataFrame:
    """Queue rows from screening.measures(...) and reasons.explain(...): what is open, and whether a query or a person closes it."""
    open_ = reasons.filter("verdict IS NULL AND blocking")
    query = F.col("query") != ""
    first = F.min(F.struct((~query).alias("person"), "ord", "criterion_id", "missing"))
    counted = open_.groupBy("nct_id", "patient_id").agg(F.count_if(query).alias("open_retrievable"), F.count_if(~query).alias("open_person"), first.alias("first"))
    out = measured.join(counted, ["nct_id", "patient_id"], "left")
    return out.withColumns({"open_retrievable": F.coalesce("open_retrievable", F.lit(0)), "open_person": F.coalesce("open_person", F.lit(0)), "blocking_criterion_id": F.col("first.criterion_id"), "blocking": F.col("first.missing")}).drop("first")


def matches(df: DataFrame, find: str = "", decision: str | None = None, constructed: bool | None = None) -> Column:
    """Whether a row passes: decision, kind of chart, and a text that some field has, case aside."""
    out = F.lit(True)
    if decision is not None:
        out &= F.col("decision") == decision
    if constructed is not None:
        out &= F.col("case_id").isNotNull() if constructed else F.col("case_id").isNull()
    if find:
        kinds = dict(df.dtypes)
        fields = [F.concat_ws("\x1f", F.col(c)) if kinds[c].startswith("array") else F.col(c).cast("string") for c in SEARCHED if c in kinds]
        out &= F.exists(F.array(*fields), lambda x: F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lit(find.lower())))
    return out


def distance() -> Column:
    """How far a screening is from a decision: gaps that a query closes first, then those that wait for a person, then the decided ones."""
    three = lambda a, b, c: F.array(F.lit(a).cast("long"), b.cast("long"), c.cast("long"))
    query, person, none = F.col("open_retrievable"), F.col("open_person"), F.lit(0)
    waits = F.when(query > 0, three(0, query, person)).otherwise(three(1, person, none))
    return F.when(F.col("decision") == "needs_review", waits).when(F.col("decision") == "eligible", three(2, none, none)).otherwise(three(3, none, none))


def _resolved() -> Column:
    return F.when(F.col("criteria_total") > 0, F.col("criteria_resolved") / F.col("criteria_total")).otherwise(F.lit(-1.0))


def _decision() -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in ("needs_review", "eligible", "ineligible")]), F.col("decision"))


ORDERS = {
    "nearest": (lambda: [distance()], True),
    "patient": (lambda: [F.col("patient_id")], True),
    "verdict": (lambda: [_decision()], True),
    "resolved": (lambda: [_resolved()], False),
    "retrievable": (lambda: [F.col("open_retrievable"), distance()], True),
    "person": (lambda: [F.col("open_person"), distance()], True),
    "source": (lambda: [F.coalesce("base_patient_id", "patient_id"), F.col("case_id").isNotNull(), F.coalesce("case_id", F.lit(""))], True),
}


def ordered(df: DataFrame, key: str, ascending: bool | None = None) -> DataFrame:
    """Rows in one of the orders, ties by patient: a range-partitioned sort, not one task."""
    keys, up = ORDERS[key]
    up = up if ascending is None else ascending
    return df.orderBy(*[k.asc() if up else k.desc() for k in keys()], F.col("patient_id").asc())


def comparisons(df: DataFrame) -> DataFrame:
    """base_patient_id, patient_id, case_id, decision, own_edits, place: charts that were constructed more than once, the source first, with the edits that not all of a group make."""
    made = df.filter("case_id IS NOT NULL")
    group = Window.partitionBy("base_patient_id")
    made = made.withColumn("members", F.count("*").over(group)).filter("members > 1")
    shared = made.select("base_patient_id", "members", F.explode("edits").alias("edit")).groupBy("base_patient_id", "edit").agg(F.count("*").alias("n"), F.first("members").alias("members")).filter("n >= members")
    common = shared.groupBy("base_patient_id").agg(F.collect_set("edit").alias("common"))
    none = F.array().cast("array<string>")
    made = made.join(common, "base_patient_id", "left").select("base_patient_id", "patient_id", "case_id", "decision", F.array_except("edits", F.coalesce("common", none)).alias("own_edits"))
    source = df.filter("case_id IS NULL").join(made.select(F.col("base_patient_id").alias("patient_id")).distinct(), "patient_id", "left_semi")
    both = made.union(source.select(F.col("patient_id").alias("base_patient_id"), "patient_id", F.lit(None).cast("string"), "decision", none))
    return both.withColumn("place", F.row_number().over(group.orderBy(F.col("case_id").asc_nulls_first())) - 1)
