"""Edits as deltas of one aggregation against the same edits of the whole chart, screened twice."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from screenlake.operators import edits, overlay, relations, screening
from screenlake.plans import catalog
from screenlake.plans.catalog import AS_OF, FIRST_ORDER, PROTOCOL

SF = "/root/testdata/sf0.001"
LATE, DAY = date(1998, 1, 1), date(1998, 5, 31)
TWIN = {
    "redact": (overlay.redact_analyte("redact", "2160-0"), lambda e: edits.redact_analyte(e, "2160-0")),
    "shift": (overlay.shift_value("shift", "2160-0", 99.0), lambda e: edits.shift_value(e, "2160-0", 99.0)),
    "convert": (overlay.convert_units("convert", "2160-0", "mg/L", 10.0), lambda e: edits.convert_units(e, "2160-0", "mg/L", 10.0)),
    "date": (overlay.shift_date("date", FIRST_ORDER, DAY), lambda e: edits.shift_date(e, FIRST_ORDER, DAY)),
    "visits": (overlay.remove_encounters("visits", LATE), lambda e: edits.remove_encounters(e, LATE)),
    "condition": (overlay.add_condition("condition", 1, "SNOMED", "1-URGENT", "1-URGENT", DAY), lambda e: e.unionByName(overlay.added_row(e, overlay.add_condition("condition", 1, "SNOMED", "1-URGENT", "1-URGENT", DAY)))),
    "result": (overlay.add_observation("result", 2, "2160-0", "Creatinine", 20.0, "mg/dL", DAY), lambda e: e.unionByName(overlay.added_row(e, overlay.add_observation("result", 2, "2160-0", "Creatinine", 20.0, "mg/dL", DAY)))),
    "late result": (overlay.add_observation("late result", 2, "2160-0", "Creatinine", 20.0, "mg/dL", date(2000, 1, 1)), lambda e: e),
}


@pytest.fixture(scope="module")
def charts(spark):
    return tuple(df.cache() for df in catalog.tables(spark, SF))


@pytest.fixture(scope="module")
def together(spark, charts):
    return overlay.edited(*charts, PROTOCOL, AS_OF, [e for e, _ in TWIN.values()]).cache()


@pytest.mark.parametrize("name", TWIN)
def test_an_overlay_equals_the_edit_of_the_whole_chart(charts, together, name):
    people, evidence = charts
    plain = relations.paired(screening.screen(people, evidence, PROTOCOL, AS_OF), screening.screen(people, TWIN[name][1](evidence), PROTOCOL, AS_OF))
    shown = ("patient_id", "decision_b", "decision_a", "coverage_b", "coverage_a", "blocked_b", "blocked_a", "b", "a", "moved")
    want = {r.patient_id: r for r in plain.select(*shown).collect()}
    got = {r.patient_id: r for r in together.filter(F.col("edit") == name).select(*shown).collect()}
    assert got and all(want[i] == r for i, r in got.items())
    # charts that the edit doesn't touch don't move
    assert all(not r.moved for i, r in want.items() if i not in got)


def test_a_recorded_death(charts):
    got = overlay.edited(*charts, PROTOCOL, AS_OF, [overlay.record_death("death", 5, AS_OF), overlay.record_death("later", 6, date(1999, 1, 1))]).collect()
    by = {r.edit: r for r in got}
    assert len(got) == 2 and by["death"].blocked_a and by["death"].decision_a == "ineligible" and by["death"].results_a == [] and by["death"].coverage_a == 1.0
    assert not by["later"].blocked_a and by["later"].moved == []


def test_one_scan_for_all_edits(spark, tmp_path):
    people, evidence = catalog.tables(spark, SF)
    people.write.parquet(str(tmp_path / "p"))
    evidence.write.parquet(str(tmp_path / "e"))
    out = overlay.edited(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "e")), PROTOCOL, AS_OF, [e for e, _ in TWIN.values()])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("hashpartitioning(patient_id") <= 2


def test_suite_pairs_edits_with_their_relations(charts):
    rows = overlay.suite(overlay.edited(*charts, PROTOCOL, AS_OF, [e for e, _ in TWIN.values()]), {"redact": {"unknown": relations.becomes_unknown("INC-02")}, "convert": {"nothing": relations.nothing_moves()}}).collect()
    assert {(r.edit, r.relation) for r in rows} == {("redact", "unknown"), ("convert", "nothing")}
    assert {r.problem for r in rows if r.edit == "redact"} <= {None, "INC-02 was already unknown", "INC-02 is not among the criteria screened"}  # the dead have no criteria
