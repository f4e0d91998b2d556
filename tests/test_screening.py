from datetime import date

import pytest
from screenlake.functions.dates import window_start
from screenlake.operators import edits, metrics, protocol_text, screening
from screenlake.plans.criteria import Composite, Concept, Criterion, Demographic, Observation, Presence, Protocol, Unsupported, Window, from_dict
from screenlake.streaming.charts import latest_stream, screen_batches

AS_OF = date(2026, 6, 1)
CREA = Concept("Creatinine", (("LOINC", "2160-0"),))
MI = Concept("MI", (("SNOMED", "22298006"),))
EVIDENCE = "patient_id long, kind string, system string, code string, display string, value double, unit string, date date, seq string"
PATIENTS = "patient_id long, birth_date date, sex string, deceased date, deceased_undated boolean"


def lab(pid, value, when, seq, unit="mg/dL"):
    return (pid, "observation", "LOINC", "2160-0", "Creatinine", value, unit, when, seq)


def visit(pid, when):
    return (pid, "encounter", "SNOMED", "v", "visit", None, None, when, f"v{when}")


def person(pid, birth=date(1980, 1, 1), sex="female", died=None, undated=False):
    return (pid, birth, sex, died, undated)


def screened(spark, people, rows, *predicates, kinds=None, policy="coverage_gated", settlements=None):
    kinds = kinds or ["inclusion"] * len(predicates)
    protocol = Protocol("N", tuple(Criterion(f"C{i}", k, p) for i, (k, p) in enumerate(zip(kinds, predicates, strict=True))))
    out = screening.screen(spark.createDataFrame(people, PATIENTS), spark.createDataFrame(rows, EVIDENCE), protocol, AS_OF, policy, settlements)
    return {r.patient_id: r for r in out.collect()}


def test_latest_row_wins_even_without_a_value(spark):
    test = Observation(CREA, "<", 2, "mg/dL")
    rows = [lab(1, 1.0, date(2026, 1, 1), "a"), lab(1, None, date(2026, 2, 1), "b"), lab(2, 1.0, date(2026, 2, 1), "a"), lab(2, 9.0, date(2026, 2, 1), "b"), lab(3, 1.0, date(2026, 6, 2), "a"), lab(4, 1.0, None, "a")]
    got = screened(spark, [person(i) for i in range(1, 5)], rows, test)
    assert [got[i].results[0].verdict for i in range(1, 5)] == [None, True, None, True]


@pytest.mark.parametrize(("relation", "expected"), [("within", [None, True, True]), ("before", [True, None, None]), ("after", [None, None, True])])
def test_window_bounds(spark, relation, expected):
    start = window_start(AS_OF, 6, "months")
    rows = [lab(1, 1.0, date(2025, 11, 30), "a"), lab(2, 1.0, start, "a"), lab(3, 1.0, AS_OF, "a")]
    got = screened(spark, [person(i) for i in (1, 2, 3)], rows, Observation(CREA, "<", 2, "mg/dL", None, Window(relation, 6, "months")))
    assert [got[i].results[0].verdict for i in (1, 2, 3)] == expected


def test_absence_needs_a_visit_unless_the_policy_says_otherwise(spark):
    people, rows = [person(1), person(2)], [visit(1, date(2026, 5, 1))]
    test = Presence("condition", MI, "absent", Window("within", 1, "years"))
    for policy, expected in (("coverage_gated", [True, None]), ("closed_world", [True, True]), ("open_world", [None, None])):
        got = screened(spark, people, rows, test, policy=policy)
        assert [got[i].results[0].verdict for i in (1, 2)] == expected


def test_units_and_molar_mass(spark):
    test = Observation(CREA, "between", 0.99, "mg/dL", 1.01)
    rows = [lab(1, 88.4, date(2026, 1, 1), "a", "umol/L"), lab(2, 1.0, date(2026, 1, 1), "a", "furlong"), lab(3, 1.0, date(2026, 1, 1), "a", None)]
    got = screened(spark, [person(i) for i in (1, 2, 3)], rows, test)
    assert [got[i].results[0].verdict for i in (1, 2, 3)] == [True, None, None]


def test_a_decisive_member_settles_a_composite(spark):
    unknown, yes, no = Unsupported("?"), Demographic("age", ">=", 18), Demographic("sex", "==", "male")
    got = screened(spark, [person(1)], [], Composite("all_of", (unknown, no)), Composite("any_of", (unknown, yes)), Composite("all_of", (unknown, yes)), Composite("not", (unknown,)))
    assert [x.verdict for x in got[1].results] == [False, True, None, None]


def test_roll_up(spark):
    visit_only = Unsupported("?", "at_visit")
    assert screened(spark, [person(1)], [], visit_only)[1].decision == "needs_review"  # nothing that blocks
    assert screened(spark, [person(1)], [])[1].decision == "needs_review"
    row = screened(spark, [person(1)], [], visit_only, Demographic("age", ">=", 18))[1]
    assert (row.decision, row.deferred_ids, row.coverage) == ("eligible", ["C0"], 1.0)
    row = screened(spark, [person(1)], [], Unsupported("?"), Demographic("age", ">=", 18), Demographic("sex", "==", "Female"), kinds=["inclusion", "exclusion", "inclusion"])[1]
    assert (row.decision, row.deciding_ids, row.unresolved_ids, row.forced_decision) == ("ineligible", ["C1"], [], "ineligible")


def test_death(spark):
    people = [person(1, died=AS_OF), person(2, died=date(2026, 6, 2)), person(3, undated=True)]
    got = screened(spark, people, [], Demographic("age", ">=", 18))
    assert [(got[i].decision, got[i].blocked_by, got[i].forced_decision) for i in (1, 2, 3)] == [("ineligible", "deceased", "eligible"), ("eligible", None, "eligible"), ("ineligible", "deceased", "eligible")]


def test_settlements_answer_only_what_is_open(spark):
    answers = spark.createDataFrame([("N", 1, "C0", "MET"), ("N", 1, "C1", "NOT_MET")], "nct_id string, patient_id long, criterion_id string, verdict string")
    row = screened(spark, [person(1)], [], Unsupported("?", "at_visit"), Demographic("age", ">=", 18), settlements=answers)[1]
    assert [(x.verdict, x.blocking) for x in row.results] == [(True, False), (True, True)]


def test_leap_day_and_missing_birth(spark):
    got = screened(spark, [person(1, date(2008, 6, 1)), person(2, date(2008, 6, 2)), person(3, None)], [], Demographic("age", ">=", 18))
    assert [got[i].results[0].verdict for i in (1, 2, 3)] == [True, False, None]


def test_edits_must_hit(spark):
    ev = spark.createDataFrame([lab(1, 1.0, date(2026, 1, 1), "a")], EVIDENCE)
    with pytest.raises(edits.NothingToEdit):
        edits.redact_analyte(ev, "4548-4")
    assert edits.redact_analyte(ev, "2160-0").count() == 0


def test_curve_drops_a_case_at_its_own_rounded_threshold(spark):
    rows = [("a", "x", "eligible", "eligible", "eligible", 2 / 3), ("a", "y", "eligible", "needs_review", "eligible", 1.0)]
    scores = spark.createDataFrame(rows, "arm string, case_id string, expected string, decision string, forced_decision string, criteria_coverage double")
    got = {round(r.threshold, 6): r.answered for r in metrics.risk_coverage_curve(scores).collect()}
    assert got == {0.0: 2, 0.666667: 1, 1.0: 1}


def test_segments_keep_their_place_and_parent(spark):
    text = "Inclusion Criteria:\n\n* Adults\n  * of any sex\n* No dialysis\nExclusion Criteria:\n1. Pregnancy"
    rows = protocol_text.segment(spark.createDataFrame([("N", text)], "nct_id string, text string")).orderBy("index").collect()
    assert [(r.section, r.text, r.parent_index) for r in rows] == [("inclusion", "Adults", None), ("inclusion", "of any sex", 0), ("inclusion", "No dialysis", None), ("exclusion", "Pregnancy", None)]
    assert all(text[r.char_start : r.char_end] == r.text for r in rows)


def test_deep_trees_become_unsupported():
    node = {"type": "demographic", "field": "age", "op": ">=", "value": 18}
    for _ in range(6):
        node = {"type": "not", "operands": [node]}
    found = from_dict(node)
    while isinstance(found, Composite):
        found = found.operands[0]
    assert isinstance(found, Unsupported)


def test_streamed_charts(spark, tmp_path):
    people = spark.createDataFrame([person(1), person(2)], PATIENTS)
    protocol = Protocol("N", (Criterion("C0", "inclusion", Observation(CREA, "<", 2, "mg/dL")),))
    src = str(tmp_path / "in")
    spark.createDataFrame([lab(1, 1.0, date(2026, 1, 1), "a")], EVIDENCE).write.parquet(src)
    stream = spark.readStream.schema(EVIDENCE).parquet(src)
    query = screen_batches(stream, people, spark.read.parquet(src), protocol, AS_OF, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.patient_id, r.decision) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "eligible")]
    query = latest_stream(stream, protocol, AS_OF).writeStream.format("memory").queryName("charts_latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("charts_latest").first().l0.value == 1.0


def test_claims_and_units_climb_any_depth(spark):
    from screenlake.operators import protocol_text

    spans = spark.createDataFrame([("N", i, i - 1 if i else None, f"line {i:02d}.", "inclusion") for i in range(41)], "nct_id string, index int, parent_index int, text string, section string")
    got = protocol_text.claims(spans, spark.createDataFrame([("N", "line 00.")], "nct_id string, quote string"))
    assert {r["index"]: r["claim"] for r in got.collect()} == {0: "direct"} | {i: "inherited" for i in range(1, 41)}
    assert [len(r["lines"]) for r in protocol_text.plan_units(spans).collect()] == [41]
