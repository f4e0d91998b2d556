"""The second reading of bundles, concepts coded from a store, and all matches of a lookup, on small fixtures."""

import json
from datetime import date

from pyspark.sql import functions as F

from screenlake.operators import lookups, screening
from screenlake.plans.criteria import Composite, Concept, Criterion, Observation, Presence, Protocol, Window
from screenlake.sources import fhir, second_reader
from tests.test_reasons_charts import AS_OF, facts, lab, people

LOINC, SNOMED = "http://loinc.org", "http://snomed.info/sct"


def code(system, value, name="n"):
    return {"coding": [{"system": system, "code": value, "display": name}]}


def bundle(spark, *resources, patient="p"):
    own = [{"resource": {"resourceType": "Patient", "id": patient}}] if patient else []
    return spark.createDataFrame([(json.dumps({"resourceType": "Bundle", "entry": own + [{"resource": r} for r in resources]}),)], "bundle string")


def test_both_readers_agree_on_plain_facts(spark):
    b = bundle(
        spark,
        {"resourceType": "Observation", "id": "1", "code": code(LOINC, "2160-0"), "effectiveDateTime": "2026-05-14T10:00:00Z", "valueQuantity": {"value": 1.5, "unit": "mg/dL"}},
        {"resourceType": "Condition", "id": "2", "code": code(SNOMED, "22298006"), "recordedDate": "2020-01-02"},
        {"resourceType": "MedicationRequest", "id": "3", "medicationCodeableConcept": code("http://www.nlm.nih.gov/research/umls/rxnorm", "29046"), "authoredOn": "2021-02-03"},
        {"resourceType": "Encounter", "id": "4", "type": [code(SNOMED, "185349003")], "period": {"start": "2021-02-03"}},
        {"resourceType": "Procedure", "id": "5", "code": code(SNOMED, "80146002"), "performedPeriod": {"start": "2019-12-31"}},
    )
    assert second_reader.differences(b).collect() == []
    got = {(r.kind, r.system, r.code, r.value, r.unit, r.date) for r in second_reader.facts(b).collect()}
    assert ("observation", "LOINC", "2160-0", 1.5, "mg/dL", date(2026, 5, 14)) in got and len(got) == 5


def test_facts_that_only_one_reader_has(spark):
    """The unit from its code, a value that is no number, and a panel without one of its own."""
    b = bundle(spark, {"resourceType": "Observation", "id": "1", "code": code(LOINC, "85354-9"), "issued": "2026-05-14", "component": [{"code": code(LOINC, "8480-6"), "valueQuantity": {"value": "120", "code": "mm[Hg]"}}]})
    got = {(r.code, r.value, r.unit, r.n_first, r.n_second) for r in second_reader.differences(b).collect()}
    assert got == {("8480-6", 120.0, "mm[Hg]", 1, 0), ("8480-6", None, None, 0, 1), ("85354-9", None, None, 0, 1)}


def test_broken_and_empty_bundles(spark):
    rows = spark.createDataFrame([("not json",), (None,), ("{}",), (json.dumps({"entry": [None, {}, {"resource": {"resourceType": "Observation"}}]}),)], "bundle string")
    assert second_reader.facts(rows).collect() == []
    assert second_reader.facts(bundle(spark, {"resourceType": "Condition", "id": "2", "code": code(SNOMED, "1")}, patient=None)).collect() == []


def test_a_protocol_coded_from_the_store_screens_like_one_with_codes(spark):
    crea, mi = Concept("creatinine", (("LOINC", "2160-0"),)), Concept("MI", (("SNOMED", "22298006"),))
    made = lambda c, m: Protocol("N", (Criterion("A", "inclusion", Composite("not", (Presence("condition", m),))), Criterion("B", "inclusion", Observation(c, "<", 2, "mg/dL"))))
    store = spark.createDataFrame([("CREATININE.", [("LOINC", "2160-0", "x")]), ("mi", [("SNOMED", "22298006", "x")]), ("other", []), ("mi ", [])], "text string, codes array<struct<system:string,code:string,display:string>>")
    bare = made(Concept("Creatinine"), Concept("MI"))
    one, two, three = lookups.coded([bare, Protocol("M", bare.criteria[1:]), Protocol("O", (Criterion("C", "inclusion", Presence("condition", Concept("other"))),))], store)
    assert one.criteria[1].predicate.concept.codes == crea.codes and two.criteria[0].predicate == one.criteria[1].predicate and three.criteria[0].predicate.concept.codes == ()
    assert len(screening.lookups([one, two])) == len(screening.lookups([one]))  # shared
    rows = facts(spark, lab(1.0), {"kind": "condition", "system": "SNOMED", "code": "22298006", "display": "nothing like it", "date": date(2020, 1, 2), "seq": "7"})
    with_store, with_own = (screening.screen(people(spark), rows, p, AS_OF).collect()[0] for p in (one, made(crea, mi)))
    assert [(r.criterion_id, r.verdict) for r in with_store.results] == [(r.criterion_id, r.verdict) for r in with_own.results] == [("A", False), ("B", True)]


def test_all_matches_in_order_and_bounded(spark):
    lookup = screening.Lookup("observation", "creatinine", (("LOINC", "2160-0"), ("LOINC", "38483-4")), None)
    near = screening.Lookup("observation", "creatinine", (("LOINC", "2160-0"),), Window("within", 3, "months"))
    rows = [lab(float(i), when=date(2026, 1 + i % 5, 1 + i), seq=f"{i:02d}") for i in range(20)] + [lab(9.0, when=None, seq="99"), lab(1.0, when=date(2027, 1, 1), seq="98")]
    rows += [lab(0.5, when=date(2026, 5, 31), seq="50"), lab(0.5, when=date(2026, 5, 31), seq="50") | {"code": "38483-4"}]  # two codes, one record
    chart = facts(spark, *rows)
    for most in (1, 5, 100):
        got = screening.matches(chart, [lookup, near], AS_OF, most).collect()[0]
        dated = sorted((r for r in rows[:-1] if r["date"] is not None and r["date"] <= AS_OF), key=lambda r: (-r["date"].toordinal(), r["seq"]))
        assert [x.seq for x in got.m0] == [r["seq"] for r in dated + [rows[20]]][:most]
        assert [x.seq for x in got.m1] == [r["seq"] for r in dated if r["date"] >= date(2026, 3, 1)][:most]
    one = screening.latest(chart, [lookup], AS_OF).collect()[0]
    assert one.l0 == screening.matches(chart, [lookup], AS_OF, 1).collect()[0].m0[0]
    plan = screening.matches(chart, [lookup], AS_OF, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle
