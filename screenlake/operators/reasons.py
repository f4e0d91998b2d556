"""Why a verdict was reached: sentences, the records they rest on, and what would settle an open one.

Everything is an expression on the patient's row with the latest row of each
lookup, beside the verdict itself, so reasons cost no further join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.functions.dates import age_years
from screenlake.functions.text import short_number
from screenlake.functions.units import convert
from screenlake.operators.screening import Lookup, _start, blocking, caveats, looked_up, settling, verdict
from screenlake.plans.criteria import Composite, Demographic, Observation, Presence, Protocol

# The words that packets and worklists use.
PLACES = {
    "observation": "the laboratory result system or the most recent panel in the chart",
    "condition": "the problem list and recent discharge summaries",
    "medication": "the medication list and the last medication reconciliation",
    "procedure": "the procedure history and operative notes",
    "demographic": "the patient demographics record",
    "at_visit": "the screening visit itself",
    "from_data": "the protocol and the investigator",
}
RESOURCES = {"observation": "Observation", "condition": "Condition", "medication": "MedicationRequest", "procedure": "Procedure"}
NO_RESULT = ("a {0} result", "no {0} result is on file for the required window")
NO_VALUE = ("a numeric value for {0}", "the most recent matching result carries no numeric value")
NOT_COVERED = (
    "confirmation that {0} is genuinely absent rather than merely unrecorded",
    "nothing documents {0} in the required window, and the chart does not show the window was covered",
)
ABSENT = "{0} is not documented in a window the chart covers"
NO_BIRTH = ("the patient's date of birth", "no date of birth is recorded, so age cannot be computed")
NO_SEX = ("the patient's recorded sex", "no sex is recorded")
AT_VISIT = ("confirmation at the screening visit: {0}", "this criterion is settled at the screening visit, not from the record")
JUDGED = ("human judgement: {0}", "this criterion was not formalised because it cannot be decided from data")
DIED = "the chart records that the patient died on {0}, before the screening date"
DIED_UNDATED = "the chart records that the patient has died, without giving a date"


@dataclass(frozen=True)
class Reason:
    """Columns: rationale, evidence (array of CITED), missing, where, query; the last three are null for a decided verdict."""

    rationale: Column
    evidence: Column
    missing: Column
    where: Column
    query: Column


def _none() -> Column:
    return F.lit(None).cast("string")


#: A record that a verdict rests on.
CITED = "struct<seq:string,resource:string,description:string,recorded_on:string,fhir_path:string>"


def _nothing() -> Column:
    return F.array().cast(f"array<{CITED}>")


def _cited(resource: str, row: Column, fields: tuple[str, ...]) -> Column:
    """The row of a lookup as it is printed: what was found, when, and where to open it. Evidence without resources goes by its place."""
    told = F.when(row["value"].isNotNull(), F.concat(F.lit(" "), short_number(row["value"]), F.when(F.coalesce(row["unit"], F.lit("")) != "", F.concat(F.lit(" "), row["unit"])).otherwise("")))
    of_its_own = F.concat(F.lit(f"{resource}/"), row["seq"])
    name = F.coalesce(F.concat(row["resource_type"], F.lit("/"), row["resource_id"]), of_its_own) if {"resource_type", "resource_id"} <= set(fields) else of_its_own
    one = F.struct(
        row["seq"].cast("string").alias("seq"),
        name.alias("resource"),
        F.concat(F.coalesce(row["display"], F.lit("")), F.coalesce(told, F.lit(""))).alias("description"),
        F.coalesce(row["date"].cast("string"), F.lit("not dated")).alias("recorded_on"),
        (F.coalesce(row["fhir_path"], of_its_own) if "fhir_path" in fields else of_its_own).alias("fhir_path"),
    )
    return F.when(row.isNotNull(), F.array(one.cast(CITED))).otherwise(_nothing())


def _day(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("None"))


def citation(resource: Column, value: Column, unit: Column, display: Column, when: Column) -> Column:
    """A record in a few words: its value with the unit, or what it is called, and its day."""
    shown = F.when(value.isNotNull(), F.concat_ws(" ", value.cast("string"), F.coalesce(unit, F.lit("None")))).otherwise(display)
    return F.concat(resource, F.lit(": "), shown, F.lit(" ("), F.coalesce(when.cast("string"), F.lit("undated")), F.lit(")"))


def _query(resource: str, p, as_of: date) -> Column:
    codes = ",".join(c for _, c in p.concept.codes)
    since = _start(p.window, as_of)
    return F.concat(F.lit(f"{resource}?patient="), F.col("patient_id").cast("string"), F.lit((f"&code={codes}" if codes else "") + (f"&date=ge{since.isoformat()}" if since else "")))


def reason(p, place: dict[Lookup, int], as_of: date, policy: str) -> Reason:
    own = verdict(p, place, as_of, policy)
    text = lambda x: F.lit(x)
    if isinstance(p, Composite):
        members = [(verdict(x, place, as_of, policy), reason(x, place, as_of, policy)) for x in p.operands]
        if p.type == "not":
            m = members[0][1]
            return Reason(F.concat(text("not ("), m.rationale, text(")")), m.evidence, m.missing, m.where, m.query)
        # the members that decide speak alone; where none does, all of them
        speaks = settling(p, place, as_of, policy)
        joiner = " and " if p.type == "all_of" else " or "
        rationale = F.array_join(F.array_compact(F.array(*[F.when(s, m.rationale) for s, (_, m) in zip(speaks, members, strict=True)])), joiner)
        evidence = F.flatten(F.array(*[F.when(s, m.evidence).otherwise(_nothing()) for s, (_, m) in zip(speaks, members, strict=True)]))
        first = lambda field: F.coalesce(*[F.when(own.isNull() & v.isNull(), F.coalesce(getattr(m, field), F.lit(""))) for v, m in members])
        return Reason(rationale, evidence, first("missing"), first("where"), first("query"))
    if isinstance(p, Observation):
        name = p.concept.text
        row = F.col(f"l{place[Lookup(p.type, name, p.concept.codes, p.window)]}")
        bare = row["value"].isNull() | row["unit"].isNull()
        value = convert(row["value"], row["unit"], p.unit, [c for s, c in p.concept.codes if s == "LOINC"])
        bound = f"between {float(p.value)} and {float(p.value_high)} {p.unit}" if p.op == "between" else f"{p.op} {float(p.value)} {p.unit}"
        pick = lambda none, empty, alien, fine: F.when(row.isNull(), none).when(bare, empty).when(value.isNull(), alien).otherwise(fine)
        rationale = pick(
            text(NO_RESULT[1].format(name)), text(NO_VALUE[1]),
            F.concat(text("cannot convert "), row["unit"], text(f" to {p.unit} for this analyte")),
            F.concat(short_number(value), text(f" {p.unit} on "), _day(row["date"]), text(f" against {bound}")),
        )
        missing = pick(text(NO_RESULT[0].format(name)), text(NO_VALUE[0].format(name)), F.concat(text(f"{name} in {p.unit} (the chart reports "), row["unit"], text(", which we cannot convert)")), _none())
        open_ = lambda x: F.when(own.isNull(), x)
        return Reason(rationale, _cited("Observation", row, place.get("fields", ())), missing, open_(text(PLACES["observation"])), open_(_query("Observation", p, as_of)))
    if isinstance(p, Presence):
        name = p.concept.text
        row = F.col(f"l{place[Lookup(p.type, name, p.concept.codes, p.window)]}")
        cited = citation(F.concat(text(f"{RESOURCES[p.type]}/"), row["seq"]), row["value"], row["unit"], row["display"], row["date"])
        rationale = F.when(row.isNotNull(), F.concat(text(f"{name} is documented ("), cited, text(")"))).when(own.isNull(), text(NOT_COVERED[1].format(name))).otherwise(text(ABSENT.format(name)))
        open_ = lambda x: F.when(own.isNull(), x)
        return Reason(rationale, _cited(RESOURCES[p.type], row, place.get("fields", ())), open_(text(NOT_COVERED[0].format(name))), open_(text(PLACES[p.type])), open_(_query(RESOURCES[p.type], p, as_of)))
    if isinstance(p, Demographic):
        where, query = text(PLACES["demographic"]), F.concat(text("Patient/"), F.col("patient_id").cast("string"))
        open_ = lambda x: F.when(own.isNull(), x)
        if p.field == "age":
            said = F.concat(text("age "), age_years(F.col("birth_date"), F.lit(as_of)).cast("string"), text(f" years at screening against {p.op} {float(p.value)}"))
            return Reason(F.coalesce(said, text(NO_BIRTH[1])), _nothing(), open_(text(NO_BIRTH[0])), open_(where), open_(query))
        said = F.concat(text("recorded sex '"), F.col("sex"), text(f"' against {p.op} {str(p.value)!r}"))
        return Reason(F.coalesce(said, text(NO_SEX[1])), _nothing(), open_(text(NO_SEX[0])), open_(where), open_(query))
    words = AT_VISIT if p.settlement == "at_visit" else JUDGED
    return Reason(text(words[1]), _nothing(), text(words[0].format(p.reason)), text(PLACES["at_visit" if p.settlement == "at_visit" else "from_data"]), text(""))


#: One criterion of one screening with its reason.
DETAIL = (
    "struct<criterion_id:string,kind:string,ord:int,verdict:boolean,blocking:boolean,caveats:array<string>,quote:string,rationale:string,"
    f"evidence:array<{CITED}>,missing:string,where:string,query:string,settled_by:struct<verdict:string,answered_by:string,answered_on:date,note:string>>"
)


def detail(protocol: Protocol, place: dict[Lookup, int], as_of: date, policy: str, more: tuple[str, Callable] | None = None) -> Column:
    """The criteria of a protocol with verdict and reason, as an array on the patient's row; what ``more`` (a type and a function) gives for a predicate is their field ``held``."""
    def one(i, c):
        r = reason(c.predicate, place, as_of, policy)
        extra = [] if more is None else [more[1](c.predicate, place, as_of, policy).alias("held")]
        return F.struct(
            F.lit(c.id).alias("criterion_id"), F.lit(c.kind).alias("kind"), F.lit(i).alias("ord"),
            verdict(c.predicate, place, as_of, policy).alias("verdict"), blocking(c.predicate, place, as_of, policy).alias("blocking"), caveats(c.predicate, place, as_of, policy).alias("caveats"),
            F.lit(c.quote).alias("quote"), r.rationale.alias("rationale"), r.evidence.alias("evidence"), r.missing.alias("missing"), r.where.alias("where"), r.query.alias("query"),
            F.lit(None).alias("settled_by"), *extra,
        ).cast(kind)

    kind = DETAIL if more is None else f"{DETAIL[:-1]},held:{more[0]}>"
    return F.array(*[one(i, c) for i, c in enumerate(protocol.criteria)]).cast(f"array<{kind}>")


def reasoned(patients: DataFrame, evidence: DataFrame, protocols: list[Protocol], as_of: date, policy: str = "coverage_gated", settlements: DataFrame | None = None, more: tuple[str, Callable] | None = None) -> DataFrame:
    """nct_id, the columns of patients and results (array of DETAIL) for each protocol and patient alive: one lookup of the evidence.

    settlements: nct_id, patient_id, criterion_id, verdict, answered_by,
    answered_on, note. The latest answer counts, and only where the record is silent.
    """
    rows, place = looked_up(patients, evidence, protocols, as_of)
    place["fields"] = tuple(c for c in ("resource_type", "resource_id", "fhir_path") if c in evidence.columns)
    each = F.explode(F.array(*[F.struct(F.lit(p.nct_id).alias("nct_id"), detail(p, place, as_of, policy, more).alias("results")) for p in protocols]))
    out = rows.select(*patients.columns, each.alias("x")).select("x.nct_id", *patients.columns, "x.results")
    if settlements is None:
        return out
    key = ["nct_id", "patient_id"]
    last = settlements.groupBy(*key, "criterion_id").agg(F.max(F.struct("answered_on", "answered_by", "verdict", "note")).alias("s"))
    own = last.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("criterion_id", F.struct("s.verdict", "s.answered_by", "s.answered_on", "s.note")))).alias("answers"))

    def answered(x: Column) -> Column:
        s = F.try_element_at("answers", x["criterion_id"])
        sentence = settled_sentence(s["verdict"], s["answered_by"], s["answered_on"], s["note"])
        settled = x.withField("verdict", s["verdict"] == "MET").withField("rationale", sentence).withField("evidence", _nothing()).withField("settled_by", s)
        for c in ("missing", "where", "query"):
            settled = settled.withField(c, _none())
        return F.when(x["verdict"].isNull() & s.isNotNull(), settled).otherwise(x)

    # answers outgrow what the sizes of their files promise, so never by a broadcast
    return out.join(own.hint("merge"), key, "left").withColumn("results", F.when(F.col("answers").isNull(), F.col("results")).otherwise(F.transform("results", answered))).drop("answers")


def explain(patients: DataFrame, evidence: DataFrame, protocols: list[Protocol], as_of: date, policy: str = "coverage_gated", settlements: DataFrame | None = None) -> DataFrame:
    """nct_id, patient_id, criterion_id, kind, ord, verdict, blocking, rationale, evidence (array of seq), missing, where, query, caveats: one row for each criterion of each patient alive."""
    rows = reasoned(patients, evidence, protocols, as_of, policy, settlements).select("nct_id", "patient_id", F.explode("results").alias("x"))
    return rows.select(
        "nct_id", "patient_id", *[f"x.{c}" for c in ("criterion_id", "kind", "ord", "verdict", "blocking", "rationale")],
        F.transform("x.evidence", lambda e: e["seq"]).alias("evidence"), *[f"x.{c}" for c in ("missing", "where", "query", "caveats")],
    )


def settled_sentence(verdict: Column, answered_by: Column, answered_on: Column, note: Column) -> Column:
    """How a person's answer reads beside what the record says."""
    answer = F.when(verdict == "MET", "met").otherwise("not met")
    return F.concat(F.lit("Settled by "), answered_by, F.lit(" on "), answered_on.cast("string"), F.lit(", not from the record: "), answer, F.lit(". "), F.regexp_replace(note, r"\.+$", ""), F.lit("."))


def vital_sentence(deceased: Column) -> Column:
    """Why a screening stopped before any criterion."""
    before, after = DIED.split("{0}")
    return F.when(deceased.isNotNull(), F.concat(F.lit(before), deceased.cast("string"), F.lit(after))).otherwise(DIED_UNDATED)
