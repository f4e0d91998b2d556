"""The gate of drafted rationales: what each criterion of a screening may speak of, and which sentences are printed.

A sentence may name the bounds of its own criterion, the values and days of the
records that its verdict rests on, and the numbers in the engine's rationale and
in the quote. What another criterion may say vouches for nothing here. All of
this is made on the patient's row beside the verdicts, from the one aggregation
of the evidence; only drafts are joined to it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.functions.units import convert
from screenlake.operators import gates
from screenlake.operators.reasons import reasoned
from screenlake.operators.screening import Lookup, settling
from screenlake.plans.criteria import Composite, Demographic, Observation, Presence, Protocol

# Drafts that are read, and how a printed sentence is marked.
DRAFTS = 2
MODEL, FALLBACK = "model", "fallback"
NOT_ASKED = "no model was consulted"
NO_REDRAFT = "no second draft was recorded"
STILL_UNBOUND = "the redraft still carried values the record does not support"
MESSAGES = {"unbound_date": "{0} does not appear in the evidence for {1}", "unbound_number": "{0} is not a value {1} resolved from"}

KEY = ("nct_id", "patient_id", "criterion_id")
RECORD = "struct<value:double,converted:double,date:date>"
HELD = f"struct<numbers:array<double>,codes:array<string>,records:array<{RECORD}>>"
VIOLATION = "array<struct<kind:string,token:string,sentence:string,message:string>>"


def _none() -> Column:
    return F.array().cast(f"array<{RECORD}>")


def records(p, place: dict, as_of: date, policy: str, whole: bool = True) -> Column:
    """The records that a verdict rests on: value, the same in the unit of the predicate, and day. In a composite, those of the members that settle it, as they were recorded."""
    if isinstance(p, Composite):
        members = [records(x, place, as_of, policy, False) for x in p.operands]
        if p.type == "not":
            return members[0]
        return F.flatten(F.array(*[F.when(s, m).otherwise(_none()) for s, m in zip(settling(p, place, as_of, policy), members, strict=True)]))
    if not isinstance(p, Observation | Presence):
        return _none()
    row = F.col(f"l{place[Lookup(p.type, p.concept.text, p.concept.codes, p.window)]}")
    converted = F.lit(None)
    if whole and isinstance(p, Observation):
        converted = convert(row["value"], row["unit"], p.unit, [c for s, c in p.concept.codes if s == "LOINC"])
    one = F.struct(row["value"].alias("value"), converted.alias("converted"), row["date"].alias("date")).cast(RECORD)
    return F.when(row.isNotNull(), F.array(one)).otherwise(_none())


def own_numbers(p) -> list[float]:
    """The bounds of a predicate and the length of its window. A composite has none of its own; its rationale names those of its members."""
    found = [p.value, p.value_high] if isinstance(p, Observation) else [p.value] if isinstance(p, Demographic) else []
    window = getattr(p, "window", None)
    return [float(x) for x in [*found, window.amount if window else None] if isinstance(x, int | float)]


def held(p, place: dict, as_of: date, policy: str) -> Column:
    codes = [] if isinstance(p, Composite) or getattr(p, "concept", None) is None else [c for _, c in p.concept.codes]
    return F.struct(
        F.array(*[F.lit(x) for x in own_numbers(p)]).cast("array<double>").alias("numbers"),
        F.array(*[F.lit(c) for c in codes]).cast("array<string>").alias("codes"),
        records(p, place, as_of, policy).alias("records"),
    )


def entitled(patients: DataFrame, evidence: DataFrame, protocols: list[Protocol], as_of: date, policy: str = "coverage_gated", settlements: DataFrame | None = None) -> DataFrame:
    """nct_id, patient_id, criterion_id, rationale, dates, numbers, codes: what a sentence on each criterion of each patient alive may name.

    A criterion that a person settled rests on no record; the words of the answer count.
    """
    rows = reasoned(patients, evidence, protocols, as_of, policy, settlements, (HELD, held))
    rows = rows.select("nct_id", "patient_id", F.explode("results").alias("x"))
    found = F.when(F.col("x.settled_by").isNotNull(), _none()).otherwise(F.col("x.held.records"))
    rows = rows.select("nct_id", "patient_id", "x.criterion_id", "x.rationale", "x.quote", found.alias("records"), F.col("x.held.numbers").alias("own"), F.col("x.held.codes").alias("codes"))
    values = F.flatten(F.transform("records", lambda r: F.array(r["value"], r["converted"])))
    days = F.array_distinct(F.array_compact(F.transform("records", lambda r: r["date"].cast("string"))))
    numbers = gates.allowed_numbers(F.col("rationale"), F.col("quote"), F.col("codes"), F.concat("own", F.array_compact(values)))
    return rows.select(*KEY, "rationale", days.alias("dates"), numbers.alias("numbers"), "codes")


def _message(x: Column) -> Column:
    said = F.lit(None).cast("string")
    for kind, words in MESSAGES.items():
        between, after = words.removeprefix("{0}").split("{1}")
        said = F.when(x["kind"] == kind, F.concat(x["token"], F.lit(between), F.col("criterion_id"), F.lit(after))).otherwise(said)
    return said


def _held_against(found: Column, draft: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), x["token"].alias("token"), draft.alias("sentence"), _message(x).alias("message")))


def written(entitlements: DataFrame, drafts: DataFrame) -> DataFrame:
    """nct_id, patient_id, criterion_id, sentence, source (model or fallback), violations, rejected, fallback_reason: one row for each entitlement.

    drafts: nct_id, patient_id, criterion_id, draft (from 1), sentence. The first
    draft without a violation is printed, else the engine's own rationale. A
    draft without its predecessor is not read, nor one of no known criterion; of
    two with the same number the greater sentence counts. ``packets`` take the
    result as their sentences; write it to a table first, as it is a screening of its own.
    """
    tidy = F.trim(F.regexp_replace("sentence", r"\s+", " "))
    told = drafts.groupBy(*KEY).agg(*[F.max(F.when(F.col("draft") == i, tidy)).alias(f"draft{i}") for i in range(1, DRAFTS + 1)])
    # drafts outgrow what the sizes of their files promise, so never by a broadcast
    rows = entitlements.join(told.hint("merge"), list(KEY), "left")
    refused, bad = [], []
    before = F.lit(True)  # whether a draft is read: all before it were refused
    for i in range(1, DRAFTS + 1):
        draft = F.col(f"draft{i}")
        rows = rows.withColumn(f"found{i}", F.when(before & draft.isNotNull(), gates.unbound(draft, F.col("dates"), F.col("numbers"), F.col("codes"))))
        found, before = F.col(f"found{i}"), F.coalesce(F.size(f"found{i}") > 0, F.lit(False))
        bad.append(_held_against(found, draft))
        refused.append(F.when(before, draft))
    printed = F.coalesce(*[F.when(F.size(f"found{i}") == 0, F.col(f"draft{i}")) for i in range(1, DRAFTS + 1)])
    rows = rows.select(*KEY, "rationale", printed.alias("printed"), F.flatten(F.array(*[F.coalesce(b.cast(VIOLATION), F.array().cast(VIOLATION)) for b in bad])).alias("violations"), F.array_compact(F.array(*refused)).alias("rejected"))
    reason = F.when(F.size("rejected") == 0, NOT_ASKED).when(F.size("rejected") == DRAFTS, STILL_UNBOUND).otherwise(NO_REDRAFT)
    return rows.select(
        *KEY, F.coalesce("printed", "rationale").alias("sentence"), F.when(F.col("printed").isNotNull(), MODEL).otherwise(FALLBACK).alias("source"),
        "violations", "rejected", F.when(F.col("printed").isNull(), reason).alias("fallback_reason"),
    )
