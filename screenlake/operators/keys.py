"""Answer keys: outcomes from labels, rebuilt charts, refutation by probes, checks before a key is frozen."""

from __future__ import annotations

import hashlib
import json
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.functions.dates import age_years
from screenlake.operators.screening import RESULTS, dead, roll_up

# Fixed values of a key.
OUTCOMES = ("eligible", "ineligible", "needs_review")
VERDICTS = ("met", "not_met", "unknown")
PROVENANCES = ("constructed", "annotated")
TRAPS = ("none", "missing_data", "unit", "temporal", "negation", "family_history", "unsupported", "threshold_edge", "shuffled_pair")
ANNOTATORS = 2
REFUTED, SUPPLIED = "refuted", "supplied"


def derive(cases: DataFrame, labels: DataFrame, patients: DataFrame, as_of: date) -> DataFrame:
    """case_id, patient_id, decision, deciding_ids, unresolved_ids, by_vital_status: outcomes by the rules that screenings follow.

    cases: case_id, patient_id; labels: case_id, criterion_id, kind, ord, verdict
    (met, not_met, unknown). A death ends it before any label.
    """
    one = F.struct(
        F.col("ord").cast("int").alias("ord"), "criterion_id", "kind",
        F.when(F.col("verdict") == "met", True).when(F.col("verdict") == "not_met", False).alias("verdict"),
    )
    sets = labels.groupBy("case_id").agg(F.array_sort(F.collect_list(one)).alias("labels"))
    results = F.transform(F.coalesce("labels", F.array().cast("array<struct<ord:int,criterion_id:string,kind:string,verdict:boolean>>")), lambda x: F.struct(x["criterion_id"].alias("criterion_id"), x["kind"].alias("kind"), x["ord"].alias("ord"), x["verdict"].alias("verdict"), F.lit(True).alias("blocking"), F.array().cast("array<string>").alias("caveats")))
    gone = dead(as_of)
    rows = cases.join(patients.select("patient_id", gone.alias("gone")), "patient_id", "left").join(sets, "case_id", "left")
    rolled = roll_up(rows.withColumn("results", results.cast(RESULTS)))
    none, died = F.array().cast("array<string>"), F.coalesce("gone", F.lit(False))
    return rolled.select("case_id", "patient_id", F.when(died, "ineligible").otherwise(F.col("decision")).alias("decision"), F.when(died, none).otherwise(F.col("deciding_ids")).alias("deciding_ids"), F.when(died, none).otherwise(F.col("unresolved_ids")).alias("unresolved_ids"), died.alias("by_vital_status"))


def label_gaps(expected: DataFrame, labels: DataFrame) -> DataFrame:
    """case_id, criterion_id, gap (missing or extra): labels against the criteria of each case's trial."""
    key = ["case_id", "criterion_id"]
    missing = expected.select(*key).distinct().join(labels.select(*key), key, "left_anti").withColumn("gap", F.lit("missing"))
    return missing.union(labels.select(*key).distinct().join(expected.select(*key), key, "left_anti").withColumn("gap", F.lit("extra")))


#: What tells a record of a chart from the others: a panel has several rows of one resource.
RECORD = ("resource_id", "value", "unit", "date", "system", "code")


def _with_resource(evidence: DataFrame) -> DataFrame:
    return evidence if "resource_id" in evidence.columns else evidence.withColumn("resource_id", F.col("seq"))


def replay(cases: DataFrame, evidence: DataFrame, edits: DataFrame, steps: int) -> tuple[DataFrame, DataFrame]:
    """Charts of cases with their recorded edits applied step by step, and the records that an edit names but the chart has not exactly once.

    cases: case_id, patient_id. edits: case_id, step (from 1), side (before or
    after) and the columns of evidence. A chart with such a record is not the one
    that the key describes.
    """
    rows = cases.select("case_id", "patient_id").join(_with_resource(evidence), "patient_id")
    edits, wrong = _with_resource(edits), []
    columns = rows.columns
    for step in range(1, steps + 1):
        now = edits.filter(F.col("step") == step)
        # a name that any task gives alike: the case and the place in its sorted list
        place = F.row_number().over(Window.partitionBy("case_id").orderBy(*[f"b_{c}" for c in RECORD]))
        before = now.filter("side = 'before'").select("case_id", *[F.col(c).alias(f"b_{c}") for c in RECORD]).withColumn("named", F.struct("case_id", place.alias("place")))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in RECORD])
        tagged = rows.join(before.withColumnRenamed("case_id", "b_case"), (F.col("case_id") == F.col("b_case")) & same, "left")
        hit = tagged.filter("named IS NOT NULL").groupBy("named").agg(F.count("*").alias("found"))
        wrong.append(before.join(hit, "named", "left").filter("found IS NULL OR found <> 1").select("case_id", F.lit(step).alias("step"), F.col("b_resource_id").alias("resource_id"), F.coalesce("found", F.lit(0)).alias("found")))
        kept = tagged.filter("named IS NULL").select(columns)
        after = now.filter("side = 'after'").join(cases.select("case_id", F.col("patient_id").alias("own")), "case_id").withColumn("patient_id", F.col("own"))
        rows = kept.unionByName(after.select([c for c in columns if c in after.columns]), allowMissingColumns=True)
    return rows, reduce(DataFrame.union, wrong)


def problems(cases: DataFrame, patients: DataFrame, trials: DataFrame) -> DataFrame:
    """case_id, problem: whatever keeps a key from being judged against; no row if it is sound.

    cases: case_id, patient_id, nct_id, expected, provenance, trap, rationale, edits (count), annotators (array), adjudicated_by, verdicts (array).
    """
    told = cases.withColumn("copies", F.count("*").over(Window.partitionBy("case_id")))
    told = told.join(patients.select("patient_id", F.lit(True).alias("has_patient")).distinct(), "patient_id", "left").join(trials.select("nct_id", F.lit(True).alias("has_trial")).distinct(), "nct_id", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    annotated = F.col("provenance") == "annotated"
    rules = {
        "duplicate case id": F.col("copies") > 1,
        "expected is no outcome": ~F.coalesce(F.col("expected").isin(*OUTCOMES), F.lit(False)),
        "a label is no verdict": F.exists(F.coalesce("verdicts", F.array().cast("array<string>")), lambda v: ~F.coalesce(v.isin(*VERDICTS), F.lit(False))),
        "provenance is unknown": ~F.coalesce(F.col("provenance").isin(*PROVENANCES), F.lit(False)),
        "trap is unknown": ~F.coalesce(F.col("trap").isin(*TRAPS), F.lit(False)),
        "rationale is blank": blank("rationale"),
        "patient is not in the corpus": F.col("has_patient").isNull(),
        "trial is not in the corpus": F.col("has_trial").isNull(),
        "constructed without an edit": (F.col("provenance") == "constructed") & (F.coalesce("edits", F.lit(0)) < 1),
        "too few annotators": annotated & (F.size(F.array_distinct(F.coalesce("annotators", F.array().cast("array<string>")))) < ANNOTATORS),
        "no adjudicator": annotated & blank("adjudicated_by"),
    }
    return told.select("case_id", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("problem"))


def canonical(key: dict) -> bytes:
    """A key as bytes that don't depend on the order of its cases and fields, nor on when it was frozen. A key is one small document."""
    content = {k: v for k, v in key.items() if k != "frozen_at"}
    if isinstance(content.get("cases"), list):
        content["cases"] = sorted(content["cases"], key=lambda c: str(c.get("id", "")) if isinstance(c, dict) else repr(c))
    return json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def fingerprint(key: dict) -> str:
    return hashlib.sha256(canonical(key)).hexdigest()


def within(value: Column, bounds: dict) -> Column:
    """at_least, at_most, above, below: all that are given."""
    tests = {"at_least": lambda b: value >= b, "at_most": lambda b: value <= b, "above": lambda b: value > b, "below": lambda b: value < b}
    return reduce(lambda a, b: a & b, [tests[k](F.lit(float(v))) for k, v in bounds.items() if k in tests], F.lit(True))


def _terms(term: dict) -> list[tuple[str, object]]:
    """The parts of a probe that look at the chart's rows."""
    (name, body), = term.items()
    if name in ("all_of", "any_of"):
        return [x for sub in body for x in _terms(sub)]
    return [] if name in ("age", "sex") else [(name, body)]


def _hit(name: str, body: dict, as_of: date) -> Column:
    """Whether one row of evidence supports a part. Any result within the bounds does, not just the latest."""
    if name == "observation":
        return (F.col("kind") == "observation") & (F.col("system") == "LOINC") & F.col("code").isin(*body["loinc"]) & F.col("value").isNotNull() & (F.col("date").isNull() | (F.col("date") <= F.lit(as_of))) & within(F.col("value"), body)
    found = (F.col("kind") == ("medication" if name == "medication" else "condition")) & (F.col("system") == body["system"]) & F.col("code").isin(*body["codes"])
    if name != "medication" and body.get("status"):
        found &= F.lower(F.regexp_extract("display", r"\(([^(),]*)[^()]*\)\s*$", 1)) == body["status"]
    if name != "medication" and body.get("onset_on_or_before"):
        found &= F.coalesce(F.col("date") <= F.lit(date.fromisoformat(body["onset_on_or_before"])), F.lit(False))
    return found


def supported(patients: DataFrame, evidence: DataFrame, probes: dict[str, dict], as_of: date) -> DataFrame:
    """patient_id, criterion_id, holds: whether a chart could support the probe of a criterion, true or false and never open.

    All parts of all probes are counted in one aggregation of the evidence. The
    terms: all_of, any_of, age, sex, condition, absent_condition, medication, observation.
    """
    parts = {json.dumps(x, sort_keys=True): x for p in probes.values() for x in _terms(p)}
    place = {k: f"t{i}" for i, k in enumerate(parts)}
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = patients
    if parts:
        seen = evidence.groupBy("patient_id").agg(*[F.max(yes(_hit(*x, as_of))).alias(place[k]) for k, x in parts.items()])
        rows = patients.join(seen, "patient_id", "left")

    def holds(term: dict) -> Column:
        (name, body), = term.items()
        if name in ("all_of", "any_of"):
            return reduce(lambda a, b: a & b if name == "all_of" else a | b, [holds(x) for x in body])
        if name == "age":
            return yes(within(age_years(F.col("birth_date"), F.lit(as_of)).cast("double"), body))
        if name == "sex":
            return yes(F.col("sex").isin(*body))
        found = yes(F.col(place[json.dumps((name, body), sort_keys=True)]))
        return ~found if name == "absent_condition" else found

    return rows.select("patient_id", F.explode(F.array(*[F.struct(F.lit(c).alias("criterion_id"), holds(p).alias("holds")) for c, p in probes.items()])).alias("x")).select("patient_id", "x.criterion_id", "x.holds")


def refute(met: DataFrame, recorded: DataFrame, built: DataFrame) -> DataFrame:
    """case_id, criterion_id, status of labels met that the recorded chart can't support: supplied if the case's own edits do, else refuted.

    met: case_id, patient_id, criterion_id, constructed; recorded and built: what supported() says of both charts (built by case_id).
    """
    flags = met.join(recorded.filter("NOT holds").select("patient_id", "criterion_id"), ["patient_id", "criterion_id"], "left_semi")
    out = flags.join(built.select("case_id", "criterion_id", F.col("holds").alias("after")), ["case_id", "criterion_id"], "left")
    return out.select("case_id", "criterion_id", F.when(F.col("constructed") & F.coalesce("after", F.lit(False)), SUPPLIED).otherwise(REFUTED).alias("status"))


def audit(flags: DataFrame, accepted: DataFrame, declared: DataFrame) -> DataFrame:
    """case_id, criterion_id, problem: refuted labels nobody answers for, answers to what is no longer raised or without a reason, and supplied labels that the case does not declare."""
    key = ["case_id", "criterion_id"]
    raised = flags.filter(F.col("status") == REFUTED).select(*key)
    said = lambda df, what: df.select(*key, F.lit(what).alias("problem"))
    out = said(raised.join(accepted.select(*key), key, "left_anti"), "not answered for")
    out = out.union(said(accepted.join(raised, key, "left_anti"), "no longer raised"))
    out = out.union(said(accepted.filter(F.trim(F.coalesce("reason", F.lit(""))) == ""), "no reason"))
    return out.union(said(flags.filter(F.col("status") == SUPPLIED).join(declared.select(*key), key, "left_anti"), "not declared"))
