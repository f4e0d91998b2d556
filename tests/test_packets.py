"""Packets, settled reasons, caveats of the members that decide, and tape keys, on small fixtures."""

import hashlib
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from screenlake.functions.canonical import canonical
from screenlake.operators import gates, lookups, packets, reasons, screening
from screenlake.plans.criteria import Composite, Criterion, Demographic, Observation, Presence, Protocol, Unsupported, Window
from screenlake.sources import corpus, fhir
from tests.test_reasons_charts import AS_OF, CREATININE, MI, facts, lab, people, told

ANCHORED = Observation(CREATININE, "<=", 1.5, "mg/dL", None, Window("within", 3, "months", "randomization"))
CAVEAT = "the protocol anchors this window to randomization, which was evaluated against the screening date"


def packet(spark, criteria, rows=(), patient=None, **more):
    p = Protocol("NCT", tuple(Criterion(f"{'INC' if k == 'inclusion' else 'EXC'}-{i:02d}", k, x, f"words {i}") for i, (k, x) in enumerate(criteria, 1)))
    return packets.packets(people(spark, **(patient or {})), facts(spark, *rows), [p], AS_OF, **more).collect()[0]


def test_caveats_are_those_of_the_members_that_settle(spark):
    old, young = Demographic("age", ">=", 18), Demographic("age", "<", 18)
    assert told(spark, ANCHORED).caveats == [CAVEAT]
    assert told(spark, Composite("all_of", (young, ANCHORED)), lab(1.0)).caveats == []  # age alone decides
    assert told(spark, Composite("all_of", (old, ANCHORED)), lab(1.0)).caveats == [CAVEAT]
    assert told(spark, Composite("all_of", (old, ANCHORED)), lab(9.0)).caveats == [CAVEAT]
    assert told(spark, Composite("any_of", (old, ANCHORED)), lab(9.0)).caveats == []
    assert told(spark, Composite("any_of", (young, ANCHORED))).caveats == [CAVEAT]  # open: all members
    assert told(spark, Composite("not", (Composite("any_of", (old, ANCHORED)),))).caveats == []
    # the same in the results of a screening
    p = Protocol("N", (Criterion("A", "inclusion", Composite("all_of", (young, ANCHORED))), Criterion("B", "inclusion", ANCHORED)))
    assert screening.measures(screening.screen(people(spark), facts(spark, lab(1.0)), p, AS_OF)).collect()[0].all_caveats == [CAVEAT]


def test_an_open_packet_lists_what_would_close_it(spark):
    got = packet(spark, [("inclusion", ANCHORED), ("exclusion", Presence("condition", MI)), ("inclusion", Unsupported("consent", "at_visit"))], titles={"NCT": "A title"}, fingerprints={"NCT": "ab12"})
    assert got.decision == "needs_review" and got.verdict == "Needs review before a decision" and got.trial == "NCT - A title" and got.criteria_fingerprint == "ab12"
    assert [x.criterion_id for x in got.open_items] == ["INC-01", "EXC-02"] and got.deciding == []
    first = got.open_items[0]
    assert (first.quote, first.missing, first.fhir_query) == ("words 1", "a creatinine result", "Observation?patient=p&code=2160-0&date=ge2026-03-01")
    assert [(x.criterion_id, x.can_still_exclude, x.quote) for x in got.at_visit] == [("INC-03", False, "words 3")]
    assert [(c.text, c.criterion_ids) for c in got.caveats] == [(CAVEAT, ["INC-01"])] and got.caveat_note == "This screening rests on 1 approximation. The criteria affected are marked in the table below."
    assert got.coverage_note == "0 of 2 decided from the patient record" and got.settlement_note is None and got.stopped_note is None
    assert [r.verdict_slug for r in got.rows] == ["unresolved"] * 3


def test_an_ineligible_packet_leads_with_what_ended_it(spark):
    mi = {"kind": "condition", "system": "SNOMED", "code": "22298006", "display": "MI", "date": date(2020, 1, 2), "seq": "7"}
    got = packet(spark, [("exclusion", Presence("condition", MI)), ("inclusion", ANCHORED), ("exclusion", Unsupported("ask", "at_visit")), ("inclusion", Demographic("age", "<", 18))], [mi])
    assert got.verdict == "Not eligible" and [x.criterion_id for x in got.deciding] == ["INC-04", "EXC-01"] and got.open_items == [] and got.at_visit == []
    assert [e.asDict() for e in got.deciding[1].evidence] == [{"seq": "7", "resource": "Condition/7", "description": "MI", "recorded_on": "2020-01-02", "fhir_path": "Condition/7"}]
    assert [r.decisive for r in got.rows] == [True, False, False, True] and got.rows[0].kind == "Exclusion"


def test_citations_carry_the_pointer_of_the_record(spark):
    resource = {"resourceType": "Observation", "id": "o9", "code": {"coding": [{"system": "http://loinc.org", "code": "2160-0", "display": "Creatinine"}]}, "effectiveDateTime": "2026-05-14", "valueQuantity": {"value": 1.25, "unit": "mg/dL"}}
    patient = {"resourceType": "Patient", "id": "p", "birthDate": "1970-03-01", "gender": "female"}
    bundles = spark.createDataFrame([(json.dumps({"resourceType": "Bundle", "entry": [{"resource": patient}, {"resource": resource}]}),)], "bundle string")
    p = Protocol("NCT", (Criterion("INC-01", "inclusion", ANCHORED, "q"),))
    got = packets.packets(fhir.patients(bundles), fhir.evidence(bundles), [p], AS_OF).collect()[0]
    e = got.rows[0].evidence[0]
    assert (e.resource, e.description, e.recorded_on, e.fhir_path) == ("Observation/o9", "Creatinine 1.25 mg/dL", "2026-05-14", "Bundle.entry[1].resource")


def test_settled_criteria(spark):
    said = lambda c, v, on, note: ("NCT", "p", c, v, "Dr Lin", on, note)
    answers = spark.createDataFrame(
        [said("INC-01", "NOT_MET", date(2026, 5, 1), "old"), said("INC-01", "MET", date(2026, 5, 20), "Seen in clinic.."), said("EXC-02", "MET", date(2026, 5, 20), "no")],
        "nct_id string, patient_id string, criterion_id string, verdict string, answered_by string, answered_on date, note string",
    )
    got = packet(spark, [("inclusion", ANCHORED), ("exclusion", Demographic("age", "<", 18))], settlements=answers)
    row = got.rows[0]
    assert got.decision == "eligible" and row.verdict == "Met" and row.evidence == [] and row.settled_by.answered_on == date(2026, 5, 20)
    assert row.rationale == "Settled by Dr Lin on 2026-05-20, not from the record: met. Seen in clinic."
    assert got.rows[1].verdict == "Not met" and got.rows[1].settled_by is None  # the record decided it
    assert got.settlement_note == "1 criterion on this screening was answered by a person rather than from data." and [(x.criterion_id, x.quote) for x in got.settlements] == [("INC-01", "words 1")]


def test_sentences_of_a_writer(spark):
    written = spark.createDataFrame([("NCT", "p", "INC-01", "Checked.", "model"), ("NCT", "p", "INC-02", "Not checked.", "fallback")], "nct_id string, patient_id string, criterion_id string, sentence string, source string")
    two = [("inclusion", Demographic("age", ">=", 18))] * 2
    got = packet(spark, two, sentences=written)
    assert [(r.rationale, r.engine_written) for r in got.rows] == [("Checked.", False), ("Not checked.", True)] and got.rationale_note.startswith("1 of 2 were written by the screening engine")
    assert packet(spark, two[:1], sentences=written).rationale_note == "every sentence was checked against the record it describes"


@pytest.mark.parametrize(("patient", "summary", "stopped"), [
    ({}, "56 years old at screening, recorded sex female", None),
    ({"deceased": date(2026, 5, 1)}, "56 years old, recorded sex female, died 2026-05-01", "the chart records that the patient died on 2026-05-01, before the screening date"),
    ({"deceased": date(2026, 7, 1)}, "56 years old at screening, recorded sex female, died 2026-07-01, after this screening", None),
    ({"deceased_undated": True}, "56 years old, recorded sex female, recorded as deceased, no date given", "the chart records that the patient has died, without giving a date"),
    ({"birth_date": None, "sex": None}, "no demographics on file", None),
])
def test_the_line_on_the_patient(spark, patient, summary, stopped):
    got = packet(spark, [("inclusion", Demographic("age", ">=", 18))], patient=patient)
    assert got.patient_summary == summary and got.blocked_by == stopped
    if stopped:
        assert got.stopped_note == f"Screening stopped before any criterion was evaluated, because {stopped}." and got.rows == [] and got.decision == "ineligible" and got.rationale_note is None and got.coverage_note.startswith("no criterion was evaluated")


def test_a_packet_of_another_trial_is_refused(spark):
    p = Protocol("NCT", (Criterion("INC-01", "inclusion", ANCHORED),))
    rolled = screening.with_the_dead(screening.roll_up(reasons.reasoned(people(spark), facts(spark), [p], AS_OF)), people(spark).filter("false").withColumn("nct_id", F.lit("")))
    with pytest.raises(Exception, match="no protocol for NCT"):
        packets.assemble(rolled, [Protocol("OTHER", p.criteria)], AS_OF, "coverage_gated").collect()
    with pytest.raises(Exception, match="no compiled criterion for INC-01"):
        packets.assemble(rolled, [Protocol("NCT", (Criterion("INC-09", "inclusion", ANCHORED),))], AS_OF, "coverage_gated").collect()


def key_of(model, messages, schema):
    material = json.dumps({"model": model, "messages": messages, "schema": schema}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(material.encode()).hexdigest()


def test_request_keys_are_those_of_the_recording(spark):
    texts = ["plain", 'a "quote" and \\ back', "line\nbreak\ttab\x07\x1f\x00\x7f", "é ß 漢字 😀", "", " "]
    messages = [[{"role": "system", "content": "s"}, {"role": "user", "content": t}] for t in texts]
    rows = spark.createDataFrame([("m", m, "plan") for m in messages] + [(None, messages[0], ""), ("m", messages[0], None)], "model string, messages array<struct<role:string,content:string>>, schema string")
    got = [r.k for r in rows.select(lookups.request_key(rows).alias("k")).collect()]
    assert got == [key_of("m", m, "plan") for m in messages] + [key_of(None, messages[0], ""), key_of("m", messages[0], "")]
    # parts of a message and a list of maps
    nested = [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "file", "n": 3, "ok": True}]}]
    kind = "model string, messages array<struct<role:string,content:array<struct<type:string,text:string,n:int,ok:boolean>>>>"
    rows = spark.createDataFrame([("m", [("user", [("text", "a", None, None), ("file", None, 3, True)])])], kind)
    assert rows.select(lookups.request_key(rows)).first()[0] == key_of("m", nested, "")
    rows = spark.createDataFrame([("m", [{"role": "user", "content": "x", "Z": "y"}])], "model string, messages array<map<string,string>>")
    assert rows.select(lookups.request_key(rows)).first()[0] == key_of("m", [{"role": "user", "content": "x", "Z": "y"}], "")
    with pytest.raises(TypeError, match="double"):
        canonical(F.lit(1.0), spark.range(1).select(F.lit(1.0)).schema[0].dataType)


def test_a_tape_that_was_written_is_replayed(spark, tmp_path):
    ask = lambda user, schema, agent="a": (agent, "m", [("system", "s"), ("user", user)], schema)
    kind = "agent string, model string, messages array<struct<role:string,content:string>>, schema string"
    asked = spark.createDataFrame([ask("one", "plan"), ask("one", "critique"), ask("two", "plan")], kind)
    tape = lookups.recorded(asked.withColumn("response", F.concat(lookups.said("user"), F.lit(" "), "schema")))
    corpus.write_tape(tape, str(tmp_path / "tape"))
    again = corpus.read_tape(spark, str(tmp_path / "tape"))
    assert {r.key for r in again.collect()} == {key_of("m", [{"role": "system", "content": "s"}, {"role": "user", "content": u}], s) for u, s in [("one", "plan"), ("one", "critique"), ("two", "plan")]}
    got = {(lookups_user(r), r.schema): r.response for r in lookups.replay(asked.withColumn("agent", F.lit("someone else")), again).collect()}
    assert got == {("one", "plan"): "one plan", ("one", "critique"): "one critique", ("two", "plan"): "two plan"}
    new = spark.createDataFrame([ask("one", "plan"), ask("three", "plan"), ask("three", "plan", "b")], kind)
    with pytest.raises(Exception, match="no recorded answer for this request, model m, user three"):
        lookups.replay(new, again).collect()
    assert [lookups_user(r) for r in lookups.to_record(new, again).collect()] == ["three"] and lookups.to_record(new, again, refresh=True).count() == 2


def lookups_user(row):
    return next(m.content for m in row.messages if m.role == "user")


def test_codes_inside_dates_are_no_violation(spark):
    rows = spark.createDataFrame([("c", "last seen on 2026-05-14 with 05 and 7", ["2026-05-14"], [], ["05"])], "criterion_id string, sentence string, dates array<string>, numbers array<double>, codes array<string>")
    assert [(r.kind, r.token) for r in gates.violations(rows).collect()] == [("unbound_number", "7")]
