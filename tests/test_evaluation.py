"""Published figures, keys, relations and the queue on small fixtures."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from screenlake.functions import text
from screenlake.operators import arms, edits, gates, keys, metrics, queue, relations, screening
from screenlake.plans.criteria import Concept, Criterion, Observation, Presence, Protocol

AS_OF = date(2026, 6, 1)
SCORES = "arm string, case_id string, expected string, decision string, forced_decision string, criteria_coverage double, trap string, provenance string"


def test_agreement_of_two_passes(spark):
    """The published contingency table of 491 paired labels."""
    names = ("met", "not_met", "unknown")
    table = ((60, 0, 0), (2, 216, 0), (11, 23, 179))
    pairs = [(a, b) for a, row in zip(names, table, strict=True) for b, n in zip(names, row, strict=True) for _ in range(n)]
    k = metrics.kappa(spark.createDataFrame([*pairs, ("met", None)], "a string, b string"), "a", "b").collect()[0]
    assert (k.n, round(k.observed, 6), round(k.expected, 6), round(k.kappa, 4)) == (491, 0.926680, 0.392437, 0.8793)


def test_published_rates_of_arms_that_read_nothing(spark):
    """51 cases: 6 eligible, 41 ineligible, 4 for review."""
    cases = [(str(i), e) for i, e in enumerate(["eligible"] * 6 + ["ineligible"] * 41 + ["needs_review"] * 4)]
    df = spark.createDataFrame(cases, "case_id string, expected string").selectExpr("*", "'none' AS trap", "'annotated' AS provenance")
    out = {r.arm: r for r in arms.report(arms.fixed(df)).collect()}
    shown = {a: tuple(round(100 * x) for x in (r.accuracy, r.balanced_accuracy, r.accuracy_interval.low, r.accuracy_interval.high, r.coverage, r.false_abstention, r.coverage_at_zero_unsafe)) + (r.unsafe,) for a, r in out.items()}
    assert shown == {"always_eligible": (12, 33, 4, 24, 100, 0, 0, 45), "always_ineligible": (80, 33, 67, 90, 100, 0, 100, 0), "always_needs_review": (8, 33, 2, 19, 0, 100, 0, 0)}
    best = arms.base_rate(arms.fixed(df)).collect()[0]
    assert (best.arm, best.expected, best.cases_expected) == ("always_ineligible", "ineligible", 41)


def test_real_arms_come_first_and_comparisons_tell_what_moved(spark):
    rows = [(a, str(i), e, d, d, 1.0, "none", "x") for a in ("zeta", "always_eligible", "alpha") for i, (e, d) in enumerate((("eligible", "eligible"), ("ineligible", "eligible" if a != "alpha" else "ineligible")))]
    here = spark.createDataFrame(rows, SCORES)
    assert [r.arm for r in arms.report(here).orderBy("place").collect()] == ["alpha", "zeta", "always_eligible"]
    there = here.withColumn("expected", F.when(F.col("arm") == "zeta", F.lit("eligible")).otherwise(F.col("expected"))).filter("arm <> 'alpha'")
    found = arms.compare(here, there)
    assert {r.arm: (r.unsafe, r.unsafe_there) for r in found.collect()} == {"zeta": (1, 0), "always_eligible": (1, 1), "alpha": (0, None)}
    assert [r.arm for r in arms.moved(found).collect()] == ["zeta"]


EVIDENCE = "patient_id string, kind string, system string, code string, display string, value double, unit string, date date, seq string, resource_id string"


def rows(spark, *xs):
    return spark.createDataFrame([("p", k, "LOINC" if k == "observation" else "SNOMED", c, c, v, u, d, s, r) for k, c, v, u, d, s, r in xs], EVIDENCE)


def test_replay_needs_every_named_record_once(spark):
    chart = rows(spark, ("observation", "1", 5.0, "g", date(2026, 1, 1), "a", "panel"), ("observation", "2", 6.0, "g", date(2026, 1, 1), "b", "panel"), ("observation", "3", None, None, None, "c", "x"), ("observation", "3", None, None, None, "d", "x"))
    cases = spark.createDataFrame([("c1", "p"), ("c2", "p")], "case_id string, patient_id string")
    wide = lambda case, step, side, df: df.drop("patient_id").select(F.lit(case).alias("case_id"), F.lit(step).alias("step"), F.lit(side).alias("side"), "*")
    five, seven = rows(spark, ("observation", "1", 5.0, "g", date(2026, 1, 1), "a", "panel")), rows(spark, ("observation", "1", 7.0, "g", date(2026, 1, 1), "a", "panel"))
    twice = rows(spark, ("observation", "3", None, None, None, "c", "x"))
    log = wide("c1", 1, "before", five).union(wide("c1", 1, "after", seven)).union(wide("c1", 2, "before", seven)).union(wide("c2", 1, "before", twice))
    charts, wrong = keys.replay(cases, chart, log, 2)
    assert sorted(r.code for r in charts.filter("case_id = 'c1'").collect()) == ["2", "3", "3"]
    assert [(r.case_id, r.found) for r in wrong.collect()] == [("c2", 2)]


def test_probes_take_any_value_and_are_never_open(spark):
    chart = rows(spark, ("observation", "1", 5.0, "g", date(2026, 1, 1), "a", "r"), ("observation", "1", 9.0, "g", date(2020, 1, 1), "b", "s"), ("condition", "9", None, None, date(2020, 1, 1), "c", "t"))
    who = spark.createDataFrame([("p", None, "female"), ("q", date(1980, 1, 1), None)], "patient_id string, birth_date date, sex string")
    probes = {"A": {"observation": {"loinc": ["1"], "above": 8}}, "B": {"all_of": [{"age": {"at_least": 18}}, {"absent_condition": {"system": "SNOMED", "codes": ["9"]}}]}, "C": {"any_of": [{"sex": ["female"]}, {"medication": {"system": "RxNorm", "codes": ["1"]}}]}}
    got = {(r.patient_id, r.criterion_id): r.holds for r in keys.supported(who, chart, probes, AS_OF).collect()}
    assert got == {("p", "A"): True, ("p", "B"): False, ("p", "C"): True, ("q", "A"): False, ("q", "B"): True, ("q", "C"): False}


def test_relations_tell_what_went_wrong(spark):
    creatinine, mi = Concept("creatinine", (("LOINC", "2160-0"),)), Concept("mi", (("SNOMED", "22298006"),))
    protocol = Protocol("N", (Criterion("INC-01", "inclusion", Observation(creatinine, "<=", 1.5, "mg/dL")), Criterion("EXC-01", "exclusion", Presence("condition", mi))))
    who = spark.createDataFrame([("p", date(1970, 1, 1), "female", None, False)], "patient_id string, birth_date date, sex string, deceased date, deceased_undated boolean")
    chart = spark.createDataFrame([("p", "observation", "LOINC", "2160-0", "Creatinine", 1.0, "mg/dL", date(2026, 1, 1), "1"), ("p", "encounter", None, None, "visit", None, None, date(2026, 1, 1), "2")], "patient_id string, kind string, system string, code string, display string, value double, unit string, date date, seq string")
    run = lambda people, ev: screening.screen(people, ev, protocol, AS_OF)
    told = lambda a, b, **named: {r.relation: r.problem for r in relations.check(relations.paired(a, b), named).collect()}
    before = run(who, chart)
    out = told(before, run(who, edits.redact_analyte(chart, "2160-0")), unknown=relations.becomes_unknown("INC-01"), flip=relations.flips("INC-01"), only=relations.only_moves("INC-01"), still=relations.nothing_moves(), coverage=relations.coverage_holds())
    assert out == {"unknown": None, "flip": "INC-01 is not decided on both sides", "only": None, "still": "verdicts moved: INC-01", "coverage": "coverage fell"}
    out = told(before, run(who, edits.shift_value(chart, "2160-0", 9.0)), flip=relations.flips("INC-01"), outcome=relations.outcome_holds(), both=relations.all_hold(relations.outcome_holds(), relations.nothing_moves()))
    assert out["flip"] is None and out["outcome"] == "the decision moved from eligible to ineligible" and out["both"].endswith("; verdicts moved: INC-01")
    dead = run(edits.record_death(who.withColumn("patient_id", F.lit("p")), "p", AS_OF), chart)
    assert told(before, dead, ok=relations.blocked(False, True), no=relations.blocked(True, True)) == {"ok": None, "no": "the first run was evaluated"}


def test_queue_orders_and_separators(spark):
    schema = "patient_id string, decision string, criteria_total int, criteria_resolved int, open_retrievable long, open_person long, case_id string, base_patient_id string, edits array<string>"
    df = spark.createDataFrame([
        ("a", "ineligible", 0, 0, 0, 0, None, None, None), ("b", "needs_review", 4, 1, 3, 0, None, None, None), ("c", "needs_review", 4, 3, 1, 2, "K1", "b", ["x", "y"]), ("d", "eligible", 4, 4, 0, 0, "K2", "b", ["x", "z"]), ("e", "needs_review", 4, 2, 0, 1, "K3", "a", ["x"]),
    ], schema)
    order = lambda key: [r.patient_id for r in queue.ordered(df, key).collect()]
    assert order("nearest") == ["c", "b", "e", "d", "a"] and order("resolved") == ["d", "c", "e", "b", "a"] and order("source") == ["a", "e", "b", "c", "d"]
    assert [r.patient_id for r in df.filter(queue.matches(df, "k2")).collect()] == ["d"] and df.filter(queue.matches(df, "", "needs_review", False)).count() == 1
    assert [(r.patient_id, r.own_edits, r.place) for r in queue.comparisons(df).orderBy("place").collect()] == [("b", [], 0), ("c", ["y"], 1), ("d", ["z"], 2)]


def test_gate_on_findings(spark):
    notes = spark.createDataFrame([("n", "Has a\n  cough. No fever.")], "note_id string, text string")
    found = spark.createDataFrame([("n", 1, "Cough.", "present", "a cough."), ("n", 2, "cough", "present", "a cough."), ("n", 3, "fever", "absent", "no fever."), ("n", 4, "gout", "present", "a cough."), ("n", 5, "cough", "family", "a cough.")], "note_id string, ord int, concept string, assertion string, sentence string")
    out = {r.ord: r for r in gates.findings(found, notes, spark.createDataFrame([("cough",), ("fever",)], "concept string")).collect()}
    assert out[1].quote == "a\n  cough." and out[1].reason is None and not out[1].repeated and out[2].repeated
    assert out[3].reason == gates.NOT_QUOTED and out[4].reason == gates.UNKNOWN_CONCEPT and out[5].reason.startswith("assertion 'family'")


def test_a_verbatim_sentence_is_quoted_with_its_line_break(spark):
    notes = spark.createDataFrame([("n", "A cough.\nNo fever.")], "note_id string, text string")
    found = spark.createDataFrame([("n", 1, "cough", "present", " A cough.\n"), ("n", 2, "cough", "present", "\u00a0A cough. "), ("n", 3, "fever", "absent", "cough.  No"), ("n", 4, "fever", "absent", "  "), ("n", 5, "fever", "absent", None)], "note_id string, ord int, concept string, assertion string, sentence string")
    out = {r.ord: r.quote for r in gates.findings(found, notes, spark.createDataFrame([("cough",), ("fever",)], "concept string")).collect()}
    assert out == {1: "A cough.\n", 2: "A cough.", 3: "cough.\nNo", 4: None, 5: None}


def test_an_observation_that_is_not_the_latest_tests_nothing(spark):
    chart = spark.createDataFrame([("p", "observation", "LOINC", "1", "x", 1.0, "g", date(2026, 1, 1), "1")], "patient_id string, kind string, system string, code string, display string, value double, unit string, date date, seq string")
    with pytest.raises(edits.NothingToEdit):
        edits.add_observation(chart, "p", "1", "x", 2.0, "g", date(2025, 1, 1))
    more = edits.add_observation(chart, "p", "1", "x", 2.0, "g", date(2026, 2, 1))
    assert [(r.side, r.value) for r in edits.changes(chart, more).collect()] == [("after", 2.0)]


def test_a_verbatim_quote_is_its_own_part(spark):
    """Of places that differ in white space alone, the one that says it as the quote does; else the first."""
    rows = [("a a\na a a", " a a a "), ("a  a\na", "a a"), ("ab cd abcd", "ab  cd"), ("abcd", "ab cd"), ("a", " "), (None, "a")]
    out = spark.createDataFrame(rows, "text string, quote string").coalesce(1).select(text.located(F.col("text"), F.col("quote")).alias("x")).collect()
    assert [r.x for r in out] == ["a a a", "a  a", "ab cd", None, None, None]
