"""What a sentence on a criterion may say, and which drafts are printed."""

from pyspark.sql import functions as F

from screenlake.operators import gates, packets, rationale
from screenlake.plans.criteria import Composite, Criterion, Demographic, Observation, Presence, Protocol, Unsupported, Window
from tests.test_reasons_charts import AS_OF, CREATININE, MI, facts, lab, people

CEILING = Observation(CREATININE, "<=", 1.5, "mg/dL", None, Window("within", 6, "months"))
ADULT = Demographic("age", ">=", 18)


def protocol(*predicates, quote="Serum creatinine <= 1.5 mg/dL within 6 months"):
    return Protocol("NCT", tuple(Criterion(f"INC-{i:02d}", "inclusion", p, quote) for i, p in enumerate(predicates, 1)))


OWN = "criterion_id string, dates array<string>, numbers array<double>, codes array<string>"
_made: dict[str, list] = {}


def said(spark, sentence, *rows, predicates=(CEILING,), quote="Serum creatinine <= 1.5 mg/dL within 6 months", criterion="INC-01", settlements=None):
    """Violations of one sentence on a criterion. What it may name is made once for all sentences."""
    name = repr((rows, predicates, quote, settlements is None))
    if name not in _made:
        own = rationale.entitled(people(spark), facts(spark, *rows), [protocol(*predicates, quote=quote)], AS_OF, settlements=settlements)
        _made[name] = own.select("criterion_id", "dates", "numbers", "codes").collect()
    told = spark.createDataFrame([r for r in _made[name] if r.criterion_id == criterion], OWN).withColumn("sentence", F.lit(sentence))
    return [(r.kind, r.token) for r in gates.violations(told).collect()]


def day(spark, *rows):
    return str(facts(spark, *rows).collect()[0].date)


def test_values_bounds_and_days_of_the_record_are_bound(spark):
    on = day(spark, lab(1.2))
    for ok in (f"Creatinine was 1.2 mg/dL on {on}, within the 1.5 mg/dL ceiling.", "The protocol allows up to 1.5 mg/dL within 6 months of screening.", "No creatinine result is on file.", f"Measured {on}.", "Resolved from LOINC 2160-0.", "See Bundle.entry[7].resource for the source."):
        assert said(spark, ok, lab(1.2)) == []


def test_what_the_record_does_not_say_is_reported(spark):
    assert said(spark, "Creatinine was 0.9 mg/dL, under the ceiling.", lab(1.2)) == [("unbound_number", "0.9")]
    assert said(spark, "Creatinine was 1.2 mg/dL on 2020-01-02.", lab(1.2)) == [("unbound_date", "2020-01-02")]
    assert said(spark, "Neither of the 2 requested results is on file.", lab(1.2)) == [("unbound_number", "2")]
    assert said(spark, "Acceptable range is 18-85 mg/dL.", lab(1.2)) == [("unbound_number", "18"), ("unbound_number", "85")]
    # a bound of another criterion vouches for nothing
    assert said(spark, "The patient is at least 18.", lab(1.2), predicates=(CEILING, ADULT)) == [("unbound_number", "18")]
    assert said(spark, "The patient is at least 18.", lab(1.2), predicates=(CEILING, ADULT), criterion="INC-02") == []


def test_a_value_may_be_named_in_both_units_and_rounded_to_a_decimal(spark):
    rows = [lab(100.0, unit="umol/L")]
    assert said(spark, "Creatinine was 100 umol/L, that is 1.13 mg/dL.", *rows) == []
    assert said(spark, "Creatinine was 1.2 mg/dL.", lab(1.199)) == []
    assert said(spark, "Creatinine was 1 mg/dL.", lab(1.199)) == [("unbound_number", "1")]


def test_a_composite_speaks_for_the_members_that_settle_it(spark):
    on = day(spark, lab(9.0))
    old, young = Demographic("age", ">=", 18), Demographic("age", "<", 18)
    # the laboratory result decides: its value and its day
    assert said(spark, f"It was 9 on {on}.", lab(9.0), predicates=(Composite("all_of", (old, CEILING)),), quote="") == []
    # age alone decides: nothing of the result
    assert said(spark, f"It was 1.4 on {on}.", lab(1.4), predicates=(Composite("all_of", (young, CEILING)),), quote="") == [("unbound_date", on), ("unbound_number", "1.4")]
    # a composite exempts no codes
    assert ("unbound_number", "2160") in said(spark, "By 2160-0.", lab(9.0), predicates=(Composite("all_of", (old, CEILING)),), quote="")


def test_settled_criteria_rest_on_no_record(spark):
    answers = spark.createDataFrame([("NCT", "p", "INC-01", "MET", "Dr Lin", AS_OF, "Seen at 1.3.")], "nct_id string, patient_id string, criterion_id string, verdict string, answered_by string, answered_on date, note string")
    alien = lab(7.0, unit="furlongs")
    on = day(spark, alien)
    assert said(spark, f"It was 7 on {on}.", alien, quote="") == []  # open, but the record is cited
    assert said(spark, f"It was 7 on {on}.", alien, quote="", settlements=answers) == [("unbound_date", on), ("unbound_number", "7")]
    assert said(spark, "A person saw 1.3.", alien, quote="", settlements=answers) == []


def test_presence_and_unsupported(spark):
    gone = Presence("condition", MI, "present", Window("within", 12, "months"))
    assert said(spark, "None within 12 months.", predicates=(gone,), quote="") == []
    assert said(spark, "A person must judge 3 things.", predicates=(Unsupported("ask"),), quote="") == [("unbound_number", "3")]
    empty = rationale.entitled(people(spark).limit(0), facts(spark), [protocol(CEILING)], AS_OF)
    assert empty.count() == 0


def test_first_clean_draft_is_printed_else_the_engine_speaks(spark):
    p = protocol(*[CEILING] * 6)
    own = rationale.entitled(people(spark), facts(spark, lab(1.2)), [p], AS_OF)
    on = day(spark, lab(1.2))
    texts = [
        ("INC-01", 1, f"It was\n  1.2 on {on}. "),
        ("INC-02", 1, "It was 4."), ("INC-02", 2, "It was 1.2."),
        ("INC-03", 1, "It was 4."), ("INC-03", 2, "It was 5 on 2020-02-02."), ("INC-03", 3, "It was 1.2."),
        ("INC-04", 1, "It was 4."),
        ("INC-05", 2, "It was 1.2."),
        ("INC-99", 1, "Nothing."),
    ]
    drafts = spark.createDataFrame([("NCT", "p", *x) for x in texts], "nct_id string, patient_id string, criterion_id string, draft int, sentence string")
    gated = rationale.written(own, drafts)
    out = spark.createDataFrame(gated.collect(), gated.schema)
    got = {r.criterion_id: r for r in out.collect()}
    engine = {r.criterion_id: r.rationale for r in own.collect()}
    assert len(got) == 6
    assert (got["INC-01"].sentence, got["INC-01"].source, got["INC-01"].violations, got["INC-01"].fallback_reason) == (f"It was 1.2 on {on}.", "model", [], None)
    # a redraft that passes keeps what was held against the first
    assert (got["INC-02"].sentence, got["INC-02"].rejected) == ("It was 1.2.", ["It was 4."])
    assert [v.asDict() for v in got["INC-02"].violations] == [{"kind": "unbound_number", "token": "4", "sentence": "It was 4.", "message": "4 is not a value INC-02 resolved from"}]
    # there is no third try
    assert (got["INC-03"].sentence, got["INC-03"].source, got["INC-03"].fallback_reason) == (engine["INC-03"], "fallback", rationale.STILL_UNBOUND)
    assert [v.message for v in got["INC-03"].violations] == ["4 is not a value INC-03 resolved from", "2020-02-02 does not appear in the evidence for INC-03", "5 is not a value INC-03 resolved from"]
    assert got["INC-04"].fallback_reason == rationale.NO_REDRAFT and got["INC-04"].rejected == ["It was 4."]
    assert got["INC-05"].fallback_reason == got["INC-06"].fallback_reason == rationale.NOT_ASKED and got["INC-05"].violations == []
    rate = gates.fallback_rate(out.select((F.col("source") == "fallback").alias("fallback"))).collect()[0]
    assert (rate.sentences, rate.fallbacks) == (6, 4)
    # packets print what passed the gate
    doc = packets.packets(people(spark), facts(spark, lab(1.2)), [p], AS_OF, sentences=out.select(*rationale.KEY, "sentence", "source")).collect()[0]
    assert [(r.rationale, r.engine_written) for r in doc.rows][:3] == [(f"It was 1.2 on {on}.", False), ("It was 1.2.", False), (engine["INC-03"], True)]
    assert doc.engine_written == 4


def test_the_engine_s_own_words_always_pass(spark):
    p = protocol(CEILING, ADULT, Composite("any_of", (CEILING, Presence("condition", MI))), quote="")
    for rows in ((), (lab(130.0, unit="umol/L"),), (lab(None),)):
        own = rationale.entitled(people(spark), facts(spark, *rows), [p], AS_OF)
        loose = gates.violations(own.withColumn("sentence", F.col("rationale")).drop("rationale")).filter("kind = 'unbound_number'")
        assert loose.count() == 0
