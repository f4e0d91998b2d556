"""Plans of queries that grew faster than their input."""

import pytest

import __spark_entry__ as registered

SF = "/root/testdata/sf0.001"


def plan(spark, query):
    return registered.queries()[query](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_same_codes_reads_conditions_alone(spark):
    assert "lineitem" not in plan(spark, "same_codes")


def test_an_edit_is_one_aggregation_of_both_sides(spark):
    assert plan(spark, "edit_record").count("part.parquet") <= 2


def test_what_a_redaction_takes_away_is_not_shuffled_in_whole_rows(spark):
    from screenlake.operators import edits

    # of the evidence only keys meet, and both sides are not compared
    assert "l_suppkey" not in plan(spark, "edit_record") and "part.parquet" not in plan(spark, "edit_record")
    rows = [("p", "observation", "LOINC", code, 1.0, s) for code in ("1", "1", "2", None) for s in ("a", None)] + [("p", "condition", "LOINC", "1", None, "a"), ("q", None, "LOINC", "1", 2.0, "b")]
    chart = spark.createDataFrame(rows, "patient_id string, kind string, system string, code string, value double, seq string")
    same = lambda df: sorted(map(str, df.collect()))
    assert same(edits.removal(chart, edits.analyte("1"))) == same(edits.changes(chart, edits.redact_analyte(chart, "1"))) != []
    with pytest.raises(edits.NothingToEdit):
        edits.removal(chart, edits.analyte("3"))


def test_notes_take_from_the_evidence_only_what_they_share(spark):
    assert "LeftSemi" in plan(spark, "notes_merge")


def test_a_chart_summary_does_not_repeat_rows_for_distinct_counts(spark):
    assert "Expand" not in plan(spark, "chart_summary")


def parses(spark, query, field):
    """How often a plan parses JSON whose schema begins with a field."""
    return registered.queries()[query](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count(f"from_json(StructField({field},")


def test_a_bundle_is_parsed_once_in_summaries(spark):
    assert parses(spark, "fhir_bundle_codes", "entry") == 1
    assert parses(spark, "fhir_summaries", "entry") == 1


def test_a_summary_shuffles_charts_and_not_entries(spark):
    from screenlake.sources import fhir

    entry = '{"resource":{"resourceType":"%s","id":"%s"%s}}'
    visits = ",".join(entry % ("Encounter", i, ',"period":{"start":"2020-01-0%d"}' % (1 + i)) for i in range(5))
    chart = lambda *people: '{"entry":[' + ",".join([*(entry % ("Patient", p, "") for p in people), visits]) + "]}"
    # two bundles of one patient are one row; a bundle of two patients is none
    rows = fhir.summaries(spark.createDataFrame([(chart("a"),), (chart("a"),), (chart("b", "c"),), (chart("d"),), (None,)], "bundle string"))
    assert "explode" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.patient_id, r.visits, r.first_visit, r.last_visit, r.n_entries) for r in rows.orderBy("patient_id").collect()] == [("a", 10, "2020-01-01", "2020-01-05", 12), ("d", 5, "2020-01-01", "2020-01-05", 6)]
