"""Reasons, chart summaries, several protocols, and sources on files, on small fixtures."""

import io
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from screenlake.functions.text import folded, short_number
from screenlake.operators import arms, chart, gates, keys, metrics, protocol_text, reasons, screening
from screenlake.plans.criteria import Composite, Concept, Criterion, Demographic, Observation, Presence, Protocol, Unsupported, Window
from screenlake.sources import corpus

AS_OF = date(2026, 6, 1)
CREATININE = Concept("creatinine", (("LOINC", "2160-0"),))
MI = Concept("myocardial infarction", (("SNOMED", "22298006"),))
EVIDENCE = "patient_id string, kind string, system string, code string, display string, value double, unit string, date date, seq string, source string"


def facts(spark, *rows):
    return spark.createDataFrame([tuple({"patient_id": "p", "source": "structured"} | r for r in [row])[0] for row in rows], EVIDENCE) if rows else spark.createDataFrame([], EVIDENCE)


def people(spark, **more):
    row = {"patient_id": "p", "birth_date": date(1970, 3, 1), "sex": "female", "deceased": None, "deceased_undated": False} | more
    return spark.createDataFrame([row], "patient_id string, birth_date date, sex string, deceased date, deceased_undated boolean")


def lab(value, unit="mg/dL", when=date(2026, 5, 14), seq="1"):
    return {"kind": "observation", "system": "LOINC", "code": "2160-0", "display": "Creatinine", "value": value, "unit": unit, "date": when, "seq": seq}


def told(spark, predicate, *rows, **patient):
    p = Protocol("NCT", (Criterion("INC-01", "inclusion", predicate),))
    return reasons.explain(people(spark, **patient), facts(spark, *rows), [p], AS_OF).collect()[0]


def test_reasons_of_a_result(spark):
    bound = Observation(CREATININE, "<=", 1.5, "mg/dL", None, Window("within", 3, "months"))
    r = told(spark, bound, lab(1.0))
    assert r.verdict and r.rationale == "1 mg/dL on 2026-05-14 against <= 1.5 mg/dL" and r.evidence == ["1"] and r.missing is None
    r = told(spark, bound)
    assert r.verdict is None and r.missing == "a creatinine result" and r.query == "Observation?patient=p&code=2160-0&date=ge2026-03-01" and r.where.startswith("the laboratory")
    r = told(spark, bound, lab(None))
    assert r.rationale == "the most recent matching result carries no numeric value" and r.evidence == ["1"]
    r = told(spark, bound, lab(1.0, "furlongs"))
    assert r.rationale == "cannot convert furlongs to mg/dL for this analyte" and "the chart reports furlongs" in r.missing


def test_reasons_of_composites(spark):
    young, mi = Demographic("age", "<", 18), Presence("condition", MI)
    r = told(spark, Composite("all_of", (young, mi)))
    assert r.verdict is False and r.rationale == "age 56 years at screening against < 18.0"
    r = told(spark, Composite("any_of", (young, mi)))
    assert r.verdict is None and r.rationale.startswith("age 56 years") and " or nothing documents" in r.rationale and r.missing.startswith("confirmation that myocardial")
    r = told(spark, Composite("not", (mi,)), {"kind": "condition", "system": "SNOMED", "code": "22298006", "display": "MI", "date": date(2020, 1, 2), "seq": "7"})
    assert r.verdict is False and r.rationale == "not (myocardial infarction is documented (Condition/7: MI (2020-01-02)))" and r.evidence == ["7"]
    r = told(spark, Unsupported("consent", "at_visit"))
    assert not r.blocking and r.missing == "confirmation at the screening visit: consent" and r.query == ""


def test_blockers_count_every_screening_of_their_trial(spark):
    a = Protocol("A", (Criterion("INC-01", "inclusion", Demographic("age", "<", 18)), Criterion("INC-02", "inclusion", Unsupported("judgement"))))
    b = Protocol("B", (Criterion("INC-01", "inclusion", Unsupported("other")),))
    out = screening.screen_all(people(spark), facts(spark), [a, b], AS_OF)
    assert {(r.nct_id, r.decision) for r in out.collect()} == {("A", "ineligible"), ("B", "needs_review")}
    found = screening.blockers(out, reasons.explain(people(spark), facts(spark), [a, b], AS_OF), spark.createDataFrame([("B", "INC-01", "the quote")], "nct_id string, criterion_id string, quote string"), top=1).collect()
    assert len(found) == 1 and found[0].others == 1 and found[0].screenings == 1 and found[0].missing.startswith("human judgement")


def test_more_lookups_than_one_aggregation_keeps(spark, monkeypatch):
    p = Protocol("N", tuple(Criterion(f"INC-{i}", "inclusion", Observation(CREATININE, "<=", 1.5, "mg/dL", None, Window("within", i + 1, "months"))) for i in range(7)))
    whole = screening.screen(people(spark), facts(spark, lab(1.0)), p, AS_OF).collect()
    monkeypatch.setattr(screening, "WIDTH", 2)
    assert screening.screen(people(spark), facts(spark, lab(1.0)), p, AS_OF).collect() == whole


def test_chart_text(spark):
    rows = facts(
        spark, lab(88.0, "umol/L", date(2025, 1, 1), "1"), lab(1.0, "MG/DL", date(2026, 1, 1), "2"), lab(9.0, "mg/dL", date(2026, 7, 1), "3"),
        {"kind": "condition", "display": "Asthma (resolved, confirmed)", "date": date(2001, 1, 1), "seq": "4"}, {"kind": "condition", "display": "Gout (disorder)", "date": None, "seq": "5"},
        {"kind": "medication", "display": " ", "date": date(2020, 5, 5), "seq": "6"}, {"kind": "encounter", "display": "visit", "date": date(2020, 5, 5), "seq": "7"},
    )
    text = chart.text(people(spark), rows, AS_OF).collect()[0].summary
    assert "1 record dated after the screening date is excluded" in text and "Active conditions (1)" in text and "undated  Gout (disorder)" in text
    assert "Asthma (2001-01-01)" in text and "(unlabelled MedicationRequest)" in text and "1 encounter, 2020-05-05 to 2020-05-05." in text
    assert "2026-01-01  Creatinine [LOINC 2160-0]: 1 MG/DL (2 results since 2025-01-01; previous 88 umol/L on 2025-01-01, unit changed)" in text


def test_nested_protocol_of_many_lines(spark):
    text = "Inclusion Criteria:\n" + "\n".join("  " * (i % 40) + f"* item {i}" for i in range(100_000))
    spans = list(protocol_text.spans_of(text))
    assert len(spans) == 100_000 and spans[41][4] == 40 and spans[40][4] is None and spans[-1][1] == "inclusion"
    assert all(text[s[3] : s[3] + len(s[2])] == s[2] for s in spans[::997])


def test_claims_and_units_of_a_deep_text_of_many_lines(spark):
    """Claims pass down from the nearest claimed line; 100,000 lines, half of them below each other."""
    n = 100_000
    text = "\n".join([" " * i + f"* deep {i:04d}" for i in range(400)] + [f"* top {i}\n  * child {i}" for i in range((n - 400) // 2)])
    spans = protocol_text.segment(spark.createDataFrame([("N", text), ("M", "* deep 0003\n* x"), ("E", None)], "nct_id string, text string"))
    quotes = spark.createDataFrame([("N", "deep 0200"), ("N", "top 7")], "nct_id string, quote string")
    got = {(r.nct_id, r["index"]): r.claim for r in protocol_text.claims(spans, quotes).collect()}
    assert len(got) == n + 2 and got["M", 0] == got["M", 1] == "unclaimed"
    tops = {i: 400 + 2 * i for i in range((n - 400) // 2)}
    assert [got["N", i] for i in (0, 199, 200, 201, 399)] == ["unclaimed", "unclaimed", "direct", "inherited", "inherited"]
    assert got["N", tops[7]] == "direct" and got["N", tops[7] + 1] == "inherited" and got["N", tops[70]] == "direct" and got["N", tops[8]] == "unclaimed"
    units = {r.unit: r.lines for r in protocol_text.plan_units(spans).filter("nct_id = 'N'").collect()}
    assert len(units[0]) == 400 and units[0][399] == "deep 0399" and units[tops[5]] == ["top 5", "child 5"] and len(units) == 1 + (n - 400) // 2


def test_numbers_as_written(spark):
    values = [1.5, 2.0, 0.00001234, 123456.0, 1234567.0, 0.1, 100000.0, -3.25, 0.0]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(short_number(F.col("v")).alias("x")).collect()]
    assert got == [f"{v:g}" for v in values]
    texts = ["Straße", "STRASSE", "ﬁnding", "ΣΊΣΥΦΟΣ", "plain"]
    assert [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(folded(F.col("t")).alias("x")).collect()] == [t.casefold() for t in texts]


def test_prose_and_codes(spark):
    rows = spark.createDataFrame([(1, "Creatinine 1.1 and 2 on 2026-05-14 for ages 18-85", ["2026-05-14"], [1.06, 1.5, 18.0], [])], "id int, sentence string, dates array<string>, numbers array<double>, codes array<string>")
    assert {(r.kind, r.token) for r in gates.violations(rows).collect()} == {("unbound_number", "2"), ("unbound_number", "85")}


def test_key_fingerprint_and_median_width(spark):
    key = {"version": "1", "frozen_at": "x", "cases": [{"id": "b"}, {"id": "a", "x": 1}]}
    assert keys.fingerprint(key) == keys.fingerprint({"cases": [{"x": 1, "id": "a"}, {"id": "b"}], "version": "1"}) != keys.fingerprint({"version": "2"})
    scores = spark.createDataFrame([("a", "1", "eligible", "eligible", "eligible", 1.0, "none", "x"), ("b", "1", "eligible", "ineligible", "eligible", 1.0, "none", "x")], "arm string, case_id string, expected string, decision string, forced_decision string, criteria_coverage double, trap string, provenance string")
    assert arms.interval_width(metrics.summary(scores)).collect()[0].width == pytest.approx(0.975, abs=1e-3)


def test_files_of_a_corpus(spark, tmp_path):
    root = tmp_path
    for name in ("trials", "patients", "notes"):
        (root / name).mkdir()
    (root / "trials/NCT2.json").write_text(json.dumps({"protocolSection": {"identificationModule": {"officialTitle": "Long"}, "eligibilityModule": {"eligibilityCriteria": "x", "sex": "ALL"}}}))
    (root / "trials/NCT1.json").write_text(json.dumps({"protocolSection": {}}))
    (root / "patients/index.json").write_text(json.dumps({"patients": [{"id": "b"}, {"id": "a"}]}))
    (root / "patients/a.json").write_text(json.dumps({"resourceType": "Bundle", "entry": []}))
    note = {"note_id": "n1", "date": "2026-01-01", "type": "visit", "author_role": "nurse", "text": "told"}
    (root / "notes/a.json").write_text(json.dumps([note, note | {"note_id": "n2", "text": " "}]))
    (root / "notes/b.json").write_text(json.dumps([note, note]))
    (root / "notes/c.json").write_text("{}")
    assert [(r.nct_id, r.title) for r in corpus.trials(spark, str(root)).orderBy("nct_id").collect()] == [("NCT1", "NCT1"), ("NCT2", "Long")]
    assert [r.patient_id for r in corpus.patient_ids(spark, str(root)).collect()] == ["a", "b"] and corpus.patient_bundles(spark, str(root), "a").count() == 1
    found, wrong = corpus.notes(spark, str(root))
    assert found.count() == 4 and {r.problem for r in wrong.collect()} == {"no list of notes", "missing text", "id used twice"}
    pointer = found.filter("patient_id = 'a' AND seq = 'n1'").select(F.col("fhir_path").alias("pointer"))
    assert [r.text for r in corpus.resolved(pointer, found).collect()] == ["told"]
    assert [r.p.note_id for r in pointer.select(corpus.pointer_parts(F.col("pointer")).alias("p")).collect()] == ["n1"]
    n = corpus.write_digests(spark, f"file://{root}/notes", f"file://{root}/SUMS")
    (root / "notes/c.json").write_text("changed")
    (root / "notes/b.json").unlink()
    assert n == 3 and {(r.name, r.state) for r in corpus.verify_digests(spark, f"file://{root}/notes", f"file://{root}/SUMS").collect()} == {("a.json", "same"), ("b.json", "missing"), ("c.json", "changed")}
    answers = spark.createDataFrame([("N", "p", "INC-01", "MET", "someone", date(2026, 1, 1), "asked")], "nct_id string, patient_id string, criterion_id string, verdict string, answered_by string, answered_on date, note string")
    corpus.write_settlements(answers, f"file://{root}/answers.json", "log/1")
    assert corpus.read_settlements(spark, f"file://{root}/answers.json", "log/1").collect() == answers.collect()
    with pytest.raises(Exception, match="not a settlement log"):
        corpus.read_settlements(spark, f"file://{root}/answers.json", "log/2").collect()
    store = spark.createDataFrame([("a", [("LOINC", "1", None)], "m", "N")], "text string, codes array<struct<system:string,code:string,display:string>>, model string, nct_id string")
    corpus.replace_store(store, f"file://{root}/store")
    corpus.replace_store(store, f"file://{root}/store")
    assert corpus.read_store(spark, f"file://{root}/store").count() == 1
    with zipfile.ZipFile(root / "z.zip", "w") as z:
        z.writestr("one.json", json.dumps({"resourceType": "Bundle", "entry": []}))
        z.writestr("two.json", "{}")
    assert [r.member for r in corpus.archived_bundles(spark, f"file://{root}/z.zip").collect()] == ["one.json"]
    key = {"version": "1", "cases": [{"id": "c", "patient_id": "a", "criterion_labels": [{"quote": "q", "expected": "met"}]}]}
    corpus.write_key(spark, key, f"file://{root}/key.json", keys.fingerprint(key))
    assert corpus.read_key(spark, f"file://{root}/key.json").collect()[0].criterion_labels[0].expected == "met"
    assert io.open(root / "key.json.sha256").read().startswith(keys.fingerprint(key))
