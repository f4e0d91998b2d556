import json
from datetime import date

import pytest
from screenlake.sources import fhir

LOINC, SNOMED = "http://loinc.org", "http://snomed.info/sct"


def concept(code, system=LOINC, text=None):
    return {"coding": [{"system": system, "code": code, "display": f"d {code}"}], **({"text": text} if text else {})}


def bundle(*resources, patient=None):
    people = [patient or {"resourceType": "Patient", "id": "p1", "birthDate": "1960-02-29", "gender": "female"}]
    return json.dumps({"resourceType": "Bundle", "entry": [{"fullUrl": f"urn:uuid:{i}", "resource": r} for i, r in enumerate([*people, *resources])]})


def flat(spark, *bundles):
    return fhir.evidence(spark.createDataFrame([(b,) for b in bundles], "bundle string")).orderBy("seq", "code").collect()


def test_panels_and_components(spark):
    own = {"valueQuantity": {"value": 7, "unit": " g "}}
    part = [{"code": concept("8480-6"), "valueQuantity": {"value": "120", "code": "mm[Hg]"}}, {"code": concept("8462-4")}]
    base = {"resourceType": "Observation", "code": concept("85354-9"), "effectiveDateTime": "2018-07-01T23:30:00-05:00"}
    rows = flat(spark, bundle({**base, "component": part}))
    assert [(r.code, r.value, r.unit) for r in rows] == [("8480-6", 120.0, "mm[Hg]"), ("8462-4", None, None)]
    assert {r.date for r in rows} == {date(2018, 7, 1)}
    assert [r.code for r in flat(spark, bundle({**base, **own, "component": part}))] == ["85354-9", "8480-6", "8462-4"]
    assert [(r.code, r.value) for r in flat(spark, bundle(base))] == [("85354-9", None)]


def test_conditions_statuses_and_partial_dates(spark):
    active = {"resourceType": "Condition", "code": concept("1", SNOMED, "MI"), "clinicalStatus": concept("Active"), "onsetDateTime": "2018-07", "recordedDate": "2018-07-02"}
    gone = {**active, "verificationStatus": concept("Refuted")}
    assert [(r.display, r.date) for r in flat(spark, bundle(active, gone))] == [("MI (active)", date(2018, 7, 2))]


def test_medications_inline_referenced_and_missing(spark):
    drug = {"resourceType": "Medication", "id": "m", "code": concept("5", "http://www.nlm.nih.gov/research/umls/rxnorm")}
    by = lambda ref, **more: {"resourceType": "MedicationRequest", "medicationReference": {"reference": ref, **more}, "authoredOn": "2020-01-01"}
    rows = flat(spark, bundle(drug, by("urn:uuid:1"), by("Medication/m"), by("m"), by("x"), by("x", display="Aspirin"), {"resourceType": "MedicationRequest"}))
    assert [(r.code, r.display) for r in rows] == [("5", "d 5")] * 3 + [(None, f"{fhir.UNRESOLVED_MEDICATION} x"), (None, "Aspirin"), (None, fhir.NO_MEDICATION_CODE)]


def test_encounters_procedures_and_unknown_systems(spark):
    rows = flat(
        spark,
        bundle(
            {"resourceType": "Encounter", "type": [concept("1", SNOMED), concept("2", "http://hl7.org/fhir/sid/icd-10-cm")], "period": {"start": "2020-01-02"}},
            {"resourceType": "Encounter", "class": {"code": "AMB"}},
            {"resourceType": "Procedure", "code": concept("3", "http://other"), "performedPeriod": {"start": "2020-01-03T10:00:00Z"}},
            {"resourceType": "Claim", "type": {"coding": []}},
        ),
    )
    assert [(r.kind, r.system, r.code, r.display) for r in rows] == [("encounter", "SNOMED", "1", "d 1"), ("encounter", "ICD10", "2", "d 1"), ("encounter", None, None, "AMB"), ("procedure", None, None, "d 3")]


def test_patients_and_charts_without_one(spark):
    dead = bundle(patient={"resourceType": "Patient", "deceasedBoolean": True, "birthDate": "1960-02", "gender": " "})
    rows = fhir.patients(spark.createDataFrame([(bundle(),), (dead,)], "bundle string")).orderBy("patient_id").collect()
    assert [tuple(r) for r in rows] == [("entry-0", None, None, None, True), ("p1", date(1960, 2, 29), "female", None, False)]
    with pytest.raises(Exception, match="a bundle with 2 patients"):
        flat(spark, bundle({"resourceType": "Patient", "id": "p2"}, {"resourceType": "Procedure"}))


def test_charts_are_joined_without_a_broadcast(spark):
    """Bundles and drafts are many times what the sizes of their files let the planner expect."""
    from screenlake.plans import catalog, rationales, texts

    for made in (catalog.bundles, texts.rich_bundles, rationales.gated):
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        # codes of the lookups are a small table given in the code; those of charts or drafts come from an aggregation
        assert "BroadcastHashJoin" not in "\n".join(x for x in plan.split("\n") if "LeftOuter" in x and ("o_custkey" in x or "criterion_id" in x)), made
