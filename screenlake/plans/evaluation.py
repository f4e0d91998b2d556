"""Queries on evaluations, keys and relations between screenings, with their DuckDB SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.operators import arms, edits, keys, metrics, protocol_text, relations, traces
from screenlake.plans.catalog import _BASE, _REDACTED, _SCORES, AS_OF, _screen, documents_claims, documents_lines, documents_quotes, patients, scores, screened
from screenlake.plans import oracles
from screenlake.sources.testdata import evidence


def cases(spark, d) -> DataFrame:
    """A case for each patient, of the first trial; what the key expects follows from the id."""
    return patients(spark, d).select(F.col("patient_id").cast("string").alias("case_id"), "patient_id", F.lit("NCT-A").alias("nct_id"), F.expr("CASE WHEN patient_id % 5 = 0 THEN 'eligible' WHEN patient_id % 5 = 1 THEN 'needs_review' ELSE 'ineligible' END").alias("expected"), F.expr("if(patient_id % 4 = 0, 'unit', 'none')").alias("trap"), F.expr("if(patient_id % 3 = 0, 'constructed', 'annotated')").alias("provenance"))


def all_scores(spark, d) -> DataFrame:
    """Scores of an arm that screens, the three that never look, and one whose answers were recorded for most cases."""
    own, _ = arms.screened(cases(spark, d), screened(spark, d).withColumn("nct_id", F.lit("NCT-A")), "screening")
    said = cases(spark, d).filter("patient_id % 11 <> 0").select("case_id", F.expr("CASE WHEN patient_id % 2 = 0 THEN 'ineligible' ELSE 'eligible' END").alias("decision"))
    return own.unionByName(arms.fixed(cases(spark, d))).unionByName(arms.recorded(cases(spark, d), said, "random"))


def labels(spark, d) -> DataFrame:
    """Three labels for each case by rule."""
    three = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("criterion_id"), F.lit(k).alias("kind")) for i, (c, k) in enumerate((("INC-01", "inclusion"), ("INC-02", "inclusion"), ("EXC-01", "exclusion")))]))
    rows = cases(spark, d).select("case_id", "patient_id", three.alias("x")).select("case_id", "patient_id", "x.*")
    return rows.withColumn("verdict", F.expr("CASE WHEN (patient_id + ord) % 7 < 5 THEN if(kind = 'inclusion', 'met', 'not_met') WHEN (patient_id + ord) % 7 = 5 THEN 'unknown' ELSE if(kind = 'inclusion', 'not_met', 'met') END"))


def records(spark, d) -> DataFrame:
    """Edits that a key records: the latest condition of some patients gets another day, and for some the key names one that isn't there."""
    rows = evidence(spark, d).filter("kind = 'condition' AND patient_id % 25 = 0").groupBy("patient_id").agg(F.max_by(F.struct("kind", "system", "code", "display", "value", "unit", "date", "seq"), "seq").alias("r"))
    rows = rows.select(F.col("patient_id").cast("string").alias("case_id"), F.lit(1).alias("step"), "patient_id", "r.*")
    before = rows.withColumn("side", F.lit("before")).withColumn("code", F.expr("if(patient_id % 100 = 0, 'not there', code)"))
    after = rows.withColumn("side", F.lit("after")).withColumn("date", F.lit(AS_OF))
    return before.unionByName(after).withColumn("resource_id", F.col("seq")).drop("patient_id")


def replayed(spark, d):
    some = cases(spark, d).filter("patient_id % 25 = 0")
    return keys.replay(some, evidence(spark, d), records(spark, d), 1)


PROBES = {
    "INC-01": {"all_of": [{"age": {"at_least": 30, "below": 70}}, {"observation": {"loinc": ["2160-0"], "above": 40}}]},
    "INC-02": {"any_of": [{"sex": ["female"]}, {"condition": {"system": "SNOMED", "codes": ["1-URGENT", "2-HIGH"], "onset_on_or_before": "1996-06-30"}}]},
    "EXC-01": {"all_of": [{"absent_condition": {"system": "SNOMED", "codes": ["5-LOW"]}}, {"medication": {"system": "RxNorm", "codes": ["PROMO"]}}]},
}


def supported(spark, d, ev=None) -> DataFrame:
    return keys.supported(patients(spark, d), evidence(spark, d) if ev is None else ev, PROBES, AS_OF)


def flags(spark, d) -> DataFrame:
    """Labels met that the charts can't support; constructed cases have one more condition and one more drug."""
    met = labels(spark, d).filter("verdict = 'met'").join(cases(spark, d).select("case_id", (F.col("provenance") == "constructed").alias("constructed")), "case_id")
    more = cases(spark, d).filter("provenance = 'constructed'").select("patient_id", F.lit("condition").alias("kind"), F.lit("SNOMED").alias("system"), F.lit("1-URGENT").alias("code"), F.lit("1-URGENT").alias("display"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(date(1996, 1, 1)).alias("date"), F.lit("added").alias("seq"))
    built = supported(spark, d, evidence(spark, d).unionByName(more)).withColumn("case_id", F.col("patient_id").cast("string"))
    return keys.refute(met, supported(spark, d), built)


def checked_cases(spark, d) -> DataFrame:
    """Cases with faults by rule."""
    rows = cases(spark, d).withColumns({
        "expected": F.expr("if(patient_id % 31 = 0, 'perhaps', expected)"), "rationale": F.expr("if(patient_id % 37 = 0, ' ', 'read twice')"), "nct_id": F.expr("if(patient_id % 41 = 0, 'NCT-X', nct_id)"),
        "edits": F.expr("if(patient_id % 6 = 0, 0, 1)"), "annotators": F.expr("if(patient_id % 7 = 0, array('a', 'a'), array('a', 'b'))"), "adjudicated_by": F.expr("if(patient_id % 8 = 0, null, 'c')"), "verdicts": F.expr("if(patient_id % 43 = 0, array('met', 'maybe'), array('met'))"),
    })
    return rows.unionByName(rows.filter("patient_id % 47 = 0"))


def pairs(spark, d) -> DataFrame:
    return relations.paired(screened(spark, d), screened(spark, d, ev=lambda e: relations.chain(e, lambda x: edits.redact_analyte(x, "2160-0"), lambda x: edits.remove_encounters(x, date(1998, 1, 1)))))


RELATIONS = {
    "INC-02 becomes unknown": lambda: relations.becomes_unknown("INC-02"),
    "INC-02 flips": lambda: relations.flips("INC-02"),
    "nothing moves": relations.nothing_moves,
    "only INC-02 moves": lambda: relations.only_moves("INC-02"),
    "coverage holds": relations.coverage_holds,
    "outcome holds": relations.outcome_holds,
    "evaluated twice": lambda: relations.blocked(False, False),
    "outcome and coverage hold": lambda: relations.all_hold(relations.outcome_holds(), relations.coverage_holds()),
}


def per_relation(df: DataFrame) -> DataFrame:
    return df.groupBy("relation").agg(F.count_if(F.col("problem").isNull()).alias("held"), F.count("problem").alias("failed"))


def made_criteria(spark, d) -> DataFrame:
    """Criteria without ids: an inclusion for each even document, an exclusion for the others, by author of ten."""
    return documents_quotes(spark, d).select((F.col("nct_id") % 10).alias("nct_id"), F.expr("if(nct_id % 2 = 0, 'inclusion', 'exclusion')").alias("kind"), F.col("nct_id").alias("ord"))


def trace_steps(spark, d) -> DataFrame:
    """Turns of conversations as steps: every third one was asked twice, and those of every fifth conversation have no price."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    one = lambda invalid: F.struct(
        F.lit("json").alias("tier"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"), F.col("text").alias("raw_response"),
        F.struct(F.length("text").cast("long").alias("prompt_tokens"), F.col("turn").cast("long").alias("completion_tokens")).alias("usage"), F.when(F.col("conv_id") % 5 != 0, F.lit(0.25)).alias("usd"), F.lit(invalid).cast("string").alias("validation_error"), F.lit(None).cast("string").alias("error"),
    ).cast(traces.ATTEMPT)
    attempts = F.when(F.col("turn") % 3 == 0, F.array(one("bad"), one(None))).otherwise(F.array(one(None)))
    skipped = F.array().cast("array<array<string>>")
    return c.select(F.col("conv_id").cast("string").alias("trace"), (F.col("turn") + 1).cast("int").alias("step"), F.lit("t").alias("timestamp"), F.col("role").alias("agent"), F.lit("p").alias("provider"), F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), F.lit("s").alias("system_prompt"), F.col("text").alias("user_prompt"), attempts.alias("attempts"), skipped.alias("skipped_tiers"), F.parse_json(F.lit("null")).alias("parsed"))


QUERIES = {
    "trace_overview": lambda s, d: traces.overview(trace_steps(s, d)),
    "trace_costs_by_model": lambda s, d: traces.ledger(trace_steps(s, d), "model").withColumn("usd", F.round("usd", 6)),
    "arm_report": lambda s, d: arms.report(all_scores(s, d)).select("arm", "place", "cases", "correct", "unsafe", F.round("accuracy", 6).alias("accuracy"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"), "degenerate"),
    "arm_by_expected": lambda s, d: arms.by_expected(all_scores(s, d)),
    "arm_by_trap": lambda s, d: arms.by_trap(all_scores(s, d)),
    "arm_comparison": lambda s, d: arms.compare(scores(s, d), scores(s, d, "coverage_gated")).select("arm", F.round("accuracy", 6).alias("accuracy"), "unsafe", F.round("accuracy_there", 6).alias("accuracy_there"), "unsafe_there"),
    "arm_moved": lambda s, d: arms.moved(arms.compare(scores(s, d, "open_world", "open_world"), scores(s, d, "closed_world", "open_world"))),
    "base_rate": lambda s, d: arms.base_rate(all_scores(s, d)).select("arm", F.round("accuracy", 6).alias("accuracy"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"), "cases", "expected", "cases_expected"),
    "unsafe_errors": lambda s, d: scores(s, d, "open_world", "open_world").filter(metrics.unsafe()).select("arm", "case_id"),
    "derived_outcomes": lambda s, d: keys.derive(cases(s, d).select("case_id", "patient_id"), labels(s, d), patients(s, d), AS_OF).select("case_id", "decision", F.array_join("deciding_ids", ",").alias("deciding_ids"), F.array_join("unresolved_ids", ",").alias("unresolved_ids"), "by_vital_status"),
    "label_gaps": lambda s, d: keys.label_gaps(labels(s, d), labels(s, d).filter("(patient_id + ord) % 13 <> 0").withColumn("criterion_id", F.expr("if((patient_id + ord) % 17 = 0, 'EXC-09', criterion_id)"))),
    "replayed_charts": lambda s, d: replayed(s, d)[0].groupBy("case_id").agg(F.count("*").alias("n"), F.count_if((F.col("kind") == "condition") & (F.col("date") == F.lit(AS_OF))).alias("moved")),
    "replay_problems": lambda s, d: replayed(s, d)[1],
    "key_problems": lambda s, d: keys.problems(checked_cases(s, d), patients(s, d), s.createDataFrame([("NCT-A",)], "nct_id string")).groupBy("problem").agg(F.count("*").alias("n")),
    "probe_support": lambda s, d: supported(s, d),
    "refuted_labels": lambda s, d: flags(s, d),
    "audited_flags": lambda s, d: keys.audit(flags(s, d), labels(s, d).filter("patient_id % 9 = 0").select("case_id", "criterion_id", F.expr("if(patient_id % 2 = 0, ' ', 'seen')").alias("reason")), labels(s, d).filter("patient_id % 4 = 0").select("case_id", "criterion_id")).groupBy("problem").agg(F.count("*").alias("n")),
    "metamorphic_relations": lambda s, d: per_relation(relations.check(pairs(s, d), {k: f() for k, f in RELATIONS.items()})),
    "perturb_add_observation": lambda s, d: edits.add_observation(evidence(s, d), 1, "2160-0", "Creatinine", 20.0, "mg/dL", date(2002, 1, 1)).filter("code = '2160-0' AND value IS NOT NULL AND date IS NOT NULL").groupBy("patient_id").agg(F.count("*").alias("n"), F.max("date").cast("string").alias("last"), F.max_by("value", F.struct("date", "seq")).alias("value")),
    "edit_record": lambda s, d: edits.removal(evidence(s, d), edits.analyte("4548-4")).groupBy("side", "kind").agg(F.count("*").alias("n")),
    "span_coverage": lambda s, d: arms.span_coverage(documents_claims(s, d)),
    "ordinal_ids": lambda s, d: protocol_text.ordinal_ids(made_criteria(s, d)),
    "protocol_fingerprints": lambda s, d: protocol_text.fingerprints(documents_lines(s, d)),
    "downgraded_criteria": lambda s, d: protocol_text.downgraded(documents_quotes(s, d).withColumn("type", F.lit("condition")), documents_lines(s, d)).select("nct_id", "criterion_id", "type", "reason"),
    "rendered_units": lambda s, d: protocol_text.rendered_units(protocol_text.plan_units(protocol_text.segment(documents_lines(s, d)))).select("nct_id", "unit", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5")),
}


def _q(select: str, *ctes: str) -> str:
    return ", ".join([_BASE, *ctes]) + "\n" + select


_CASES = """cases AS (SELECT CAST(patient_id AS VARCHAR) AS case_id, patient_id, 'NCT-A' AS nct_id, CASE WHEN patient_id % 5 = 0 THEN 'eligible' WHEN patient_id % 5 = 1 THEN 'needs_review' ELSE 'ineligible' END AS expected,
  CASE WHEN patient_id % 4 = 0 THEN 'unit' ELSE 'none' END AS trap, CASE WHEN patient_id % 3 = 0 THEN 'constructed' ELSE 'annotated' END AS provenance FROM patients)"""
_ALL = [_screen(), _CASES, """scores AS (SELECT 'screening' AS arm, c.*, d.decision FROM cases c JOIN decided d USING (patient_id)
 UNION ALL SELECT 'always_' || o, c.*, o FROM cases c, (VALUES ('eligible'), ('ineligible'), ('needs_review')) v(o)
 UNION ALL SELECT 'random', c.*, CASE WHEN patient_id % 2 = 0 THEN 'ineligible' ELSE 'eligible' END FROM cases c WHERE patient_id % 11 <> 0)"""]
_LABELS = """labels3 AS (SELECT case_id, patient_id, ord, criterion_id, kind, CASE WHEN (patient_id + ord) % 7 < 5 THEN CASE WHEN kind = 'inclusion' THEN 'met' ELSE 'not_met' END WHEN (patient_id + ord) % 7 = 5 THEN 'unknown' WHEN kind = 'inclusion' THEN 'not_met' ELSE 'met' END AS verdict
 FROM cases, (VALUES (0, 'INC-01', 'inclusion'), (1, 'INC-02', 'inclusion'), (2, 'EXC-01', 'exclusion')) v(ord, criterion_id, kind))"""
_AGE = f"(date_diff('year', p.birth_date, DATE '{AS_OF}') - CASE WHEN p.birth_date + to_years(CAST(date_diff('year', p.birth_date, DATE '{AS_OF}') AS INTEGER)) > DATE '{AS_OF}' THEN 1 ELSE 0 END)"


def _supported(name: str, ev: str) -> str:
    has = lambda where: f"EXISTS (SELECT 1 FROM {ev} e WHERE e.patient_id = p.patient_id AND {where})"
    return f"""{name} AS (SELECT patient_id, 'INC-01' AS criterion_id, coalesce({_AGE} >= 30 AND {_AGE} < 70, false) AND {has(f"kind = 'observation' AND code = '2160-0' AND value > 40 AND (date IS NULL OR date <= DATE '{AS_OF}')")} AS holds FROM patients p
 UNION ALL SELECT patient_id, 'INC-02', sex = 'female' OR {has("kind = 'condition' AND code IN ('1-URGENT', '2-HIGH') AND date <= DATE '1996-06-30'")} FROM patients p
 UNION ALL SELECT patient_id, 'EXC-01', NOT {has("kind = 'condition' AND code = '5-LOW'")} AND {has("kind = 'medication' AND code = 'PROMO'")} FROM patients p)"""


_FLAGS = [_CASES, _LABELS, "more AS (SELECT patient_id, kind, code, value, date FROM evidence UNION ALL SELECT patient_id, 'condition', '1-URGENT', NULL, DATE '1996-01-01' FROM cases WHERE provenance = 'constructed')", _supported("sup", "evidence"), _supported("built", "more"),
          """flags AS (SELECT l.case_id, l.criterion_id, CASE WHEN c.provenance = 'constructed' AND b.holds THEN 'supplied' ELSE 'refuted' END AS status FROM labels3 l JOIN cases c USING (case_id) JOIN sup s ON s.patient_id = l.patient_id AND s.criterion_id = l.criterion_id JOIN built b ON b.patient_id = l.patient_id AND b.criterion_id = l.criterion_id WHERE l.verdict = 'met' AND NOT s.holds)"""]
_REPLAY = [_CASES, "last AS (SELECT patient_id, max(seq) AS seq FROM evidence WHERE kind = 'condition' AND patient_id % 25 = 0 GROUP BY patient_id)"]
_COMPARED = _SCORES + ", there AS (SELECT arm, s.decision, k.decision AS expected FROM (SELECT 'coverage_gated' AS arm, * FROM decided_g UNION ALL SELECT 'open_world', * FROM decided_o) s JOIN decided_g k USING (patient_id)), compared AS (SELECT * FROM (SELECT arm, avg((decision = expected)::INT) AS accuracy, count(*) FILTER (decision = 'eligible' AND expected <> 'eligible') AS unsafe FROM scores GROUP BY arm) LEFT JOIN (SELECT arm, avg((decision = expected)::INT) AS accuracy_there, count(*) FILTER (decision = 'eligible' AND expected <> 'eligible') AS unsafe_there FROM there GROUP BY arm) USING (arm))"
#: Two arms against a key that never takes silence for absence, and one that always does.
_OPEN_KEY = "(SELECT arm, CAST(a.patient_id AS VARCHAR) AS case_id, a.decision, o.decision AS expected, c.decision AS expected_there FROM (SELECT 'coverage_gated' AS arm, * FROM decided_g UNION ALL SELECT 'closed_world', * FROM decided_c) a JOIN decided_o o USING (patient_id) JOIN decided_c c USING (patient_id))"
_CUT = "cut AS (SELECT * FROM redacted WHERE NOT coalesce(kind = 'encounter' AND date > DATE '1998-01-01', false))"

_STEPS = "steps AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN 2 ELSE 1 END AS n, length(text) AS p, turn AS c, conv_id % 5 <> 0 AS priced FROM conversations)"

SQL = {
    "trace_overview": f"""WITH {_STEPS} SELECT CAST(conv_id AS VARCHAR) AS trace, CAST(turn + 1 AS INTEGER) AS step, '| ' || (turn + 1) || ' | ' || role || ' | p/m' || (conv_id % 3) || ' | `json` | ' || (n - 1) || ' | ' || (n * (p + c)) || ' | ' || CASE WHEN priced THEN CASE n WHEN 1 THEN '$0.2500' ELSE '$0.5000' END ELSE 'unpriced' END || ' | validated |' AS text FROM steps""",
    "trace_costs_by_model": f"WITH {_STEPS} SELECT 'm' || (conv_id % 3) AS model, count(*) AS calls, count(*) FILTER (priced) AS priced, sum(n * p)::BIGINT AS prompt_tokens, sum(n * c)::BIGINT AS completion_tokens, round(sum(n * 0.25::DOUBLE) FILTER (priced), 6) AS usd FROM steps GROUP BY ALL",
    "arm_report": _q("""SELECT arm, CAST(row_number() OVER (ORDER BY degenerate, arm) AS INTEGER) AS place, cases, correct, unsafe, accuracy, round(balanced, 6) AS balanced_accuracy, degenerate FROM (
  SELECT arm, count(*) AS cases, count(*) FILTER (decision = expected) AS correct, count(*) FILTER (decision = 'eligible' AND expected <> 'eligible') AS unsafe, round(avg((decision = expected)::INT), 6) AS accuracy, arm LIKE 'always%' OR arm = 'random' AS degenerate FROM scores GROUP BY arm)
 JOIN (SELECT arm, avg(a) AS balanced FROM (SELECT arm, expected, avg((decision = expected)::INT) AS a FROM scores GROUP BY ALL) GROUP BY arm) USING (arm)""", *_ALL),
    "arm_by_expected": _q("""PIVOT_ALIAS""", *_ALL).replace("PIVOT_ALIAS", "SELECT expected, max(n) AS cases, " + ", ".join(f"any_value(cell) FILTER (arm = '{a}') AS {a}" for a in ("always_eligible", "always_ineligible", "always_needs_review", "random", "screening")) + " FROM (SELECT expected, arm, count(*) AS n, count(*) FILTER (decision = expected) || '/' || count(*) AS cell FROM scores GROUP BY ALL) GROUP BY expected"),
    "arm_by_trap": _q("SELECT trap, " + ", ".join(f"any_value(cell) FILTER (arm = '{a}') AS {a}" for a in ("always_eligible", "always_ineligible", "always_needs_review", "random", "screening")) + " FROM (SELECT trap, arm, count(*) FILTER (decision = expected) || '/' || count(*) || ' correct, ' || count(*) FILTER (decision = 'eligible' AND expected <> 'eligible') || ' unsafe' AS cell FROM scores GROUP BY ALL) GROUP BY trap", *_ALL),
    "arm_comparison": _q("SELECT arm, round(accuracy, 6) AS accuracy, unsafe, round(accuracy_there, 6) AS accuracy_there, unsafe_there FROM compared", _COMPARED),
    "arm_moved": _q(f"SELECT arm FROM {_OPEN_KEY} GROUP BY arm HAVING (count(*) FILTER (decision = 'eligible' AND expected <> 'eligible') > 0) <> (count(*) FILTER (decision = 'eligible' AND expected_there <> 'eligible') > 0)", _SCORES),
    "base_rate": _q("""SELECT arm, round(accuracy, 6) AS accuracy, round(balanced, 6) AS balanced_accuracy, cases, expected, cases_expected FROM (SELECT arm, avg((decision = expected)::INT) AS accuracy, count(*) AS cases FROM scores WHERE arm <> 'screening' GROUP BY arm ORDER BY accuracy DESC, arm LIMIT 1)
 JOIN (SELECT arm, avg(a) AS balanced FROM (SELECT arm, expected, avg((decision = expected)::INT) AS a FROM scores GROUP BY ALL) GROUP BY arm) USING (arm) JOIN (SELECT arm, unnest(max({'cases_expected': n, 'expected': expected})) FROM (SELECT arm, expected, count(*) AS n FROM scores GROUP BY arm, expected) GROUP BY arm) USING (arm)""", *_ALL),
    "unsafe_errors": _q(f"SELECT arm, case_id FROM {_OPEN_KEY} WHERE decision = 'eligible' AND expected <> 'eligible'", _SCORES),
    "derived_outcomes": _q(f"""SELECT case_id, CASE WHEN gone THEN 'ineligible' WHEN deciding <> '' THEN 'ineligible' WHEN unresolved <> '' THEN 'needs_review' ELSE 'eligible' END AS decision, CASE WHEN gone THEN '' ELSE deciding END AS deciding_ids, CASE WHEN gone OR deciding <> '' THEN '' ELSE unresolved END AS unresolved_ids, gone AS by_vital_status FROM (
  SELECT l.case_id, any_value(coalesce(p.deceased <= DATE '{AS_OF}', false) OR p.deceased_undated) AS gone, coalesce(string_agg(criterion_id, ',' ORDER BY kind DESC, ord) FILTER ((kind = 'inclusion' AND verdict = 'not_met') OR (kind = 'exclusion' AND verdict = 'met')), '') AS deciding, coalesce(string_agg(criterion_id, ',' ORDER BY ord) FILTER (verdict = 'unknown'), '') AS unresolved
  FROM labels3 l JOIN patients p USING (patient_id) GROUP BY l.case_id)""", _CASES, _LABELS),
    "label_gaps": _q("""SELECT case_id, criterion_id, 'missing' AS gap FROM labels3 WHERE (patient_id + ord) % 13 = 0 OR (patient_id + ord) % 17 = 0
 UNION ALL SELECT DISTINCT case_id, 'EXC-09', 'extra' FROM labels3 WHERE (patient_id + ord) % 13 <> 0 AND (patient_id + ord) % 17 = 0""", _CASES, _LABELS),
    "replayed_charts": _q(f"""SELECT CAST(e.patient_id AS VARCHAR) AS case_id, count(*) + CASE WHEN e.patient_id % 100 = 0 AND any_value(l.seq) IS NOT NULL THEN 1 ELSE 0 END AS n,
  count(*) FILTER (kind = 'condition' AND date = DATE '{AS_OF}' AND (e.patient_id % 100 = 0 OR e.seq <> l.seq)) + CASE WHEN any_value(l.seq) IS NOT NULL THEN 1 ELSE 0 END AS moved FROM evidence e LEFT JOIN last l USING (patient_id) WHERE e.patient_id % 25 = 0 GROUP BY e.patient_id""", *_REPLAY),
    "replay_problems": _q("SELECT CAST(patient_id AS VARCHAR) AS case_id, 1 AS step, seq AS resource_id, 0::BIGINT AS found FROM last WHERE patient_id % 100 = 0", *_REPLAY),
    "key_problems": _q("""SELECT problem, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY case_id) AS copies FROM (SELECT * FROM cases UNION ALL SELECT * FROM cases WHERE patient_id % 47 = 0)), LATERAL (SELECT unnest([
   CASE WHEN copies > 1 THEN 'duplicate case id' END, CASE WHEN patient_id % 31 = 0 THEN 'expected is no outcome' END, CASE WHEN patient_id % 43 = 0 THEN 'a label is no verdict' END, CASE WHEN patient_id % 37 = 0 THEN 'rationale is blank' END, CASE WHEN patient_id % 41 = 0 THEN 'trial is not in the corpus' END,
   CASE WHEN provenance = 'constructed' AND patient_id % 6 = 0 THEN 'constructed without an edit' END, CASE WHEN provenance = 'annotated' AND patient_id % 7 = 0 THEN 'too few annotators' END, CASE WHEN provenance = 'annotated' AND patient_id % 8 = 0 THEN 'no adjudicator' END]) AS problem) WHERE problem IS NOT NULL GROUP BY problem""", _CASES),
    "probe_support": _q("SELECT patient_id, criterion_id, holds FROM sup", _supported("sup", "evidence")),
    "refuted_labels": _q("SELECT case_id, criterion_id, status FROM flags", *_FLAGS),
    "audited_flags": _q("""SELECT problem, count(*) AS n FROM (SELECT case_id, criterion_id, 'not answered for' AS problem FROM flags WHERE status = 'refuted' AND CAST(case_id AS BIGINT) % 9 <> 0
  UNION ALL SELECT case_id, criterion_id, 'no longer raised' FROM labels3 WHERE patient_id % 9 = 0 AND (case_id, criterion_id) NOT IN (SELECT case_id, criterion_id FROM flags WHERE status = 'refuted')
  UNION ALL SELECT case_id, criterion_id, 'no reason' FROM labels3 WHERE patient_id % 9 = 0 AND patient_id % 2 = 0
  UNION ALL SELECT case_id, criterion_id, 'not declared' FROM flags WHERE status = 'supplied' AND CAST(case_id AS BIGINT) % 4 <> 0) GROUP BY problem""", *_FLAGS),
    "metamorphic_relations": _q("""SELECT relation, count(*) FILTER (holds) AS held, count(*) FILTER (NOT holds) AS failed FROM (
  SELECT d.patient_id, d.blocked_by IS NOT NULL AS gone, d.decision = r.decision AS same, r.coverage >= d.coverage AS covered, v.was, v.now, coalesce(v.moved, 0) AS moved, coalesce(v.others, 0) AS others FROM decided d JOIN decided_r r USING (patient_id)
  LEFT JOIN (SELECT a.patient_id, bool_or(a.verdict) FILTER (a.criterion_id = 'INC-02') AS was, bool_or(b.verdict) FILTER (a.criterion_id = 'INC-02') AS now, count(*) FILTER (a.verdict IS DISTINCT FROM b.verdict) AS moved, count(*) FILTER (a.verdict IS DISTINCT FROM b.verdict AND a.criterion_id <> 'INC-02') AS others FROM verdicts a JOIN verdicts_r b ON a.patient_id = b.patient_id AND a.criterion_id = b.criterion_id GROUP BY a.patient_id) v ON v.patient_id = d.patient_id
 ), LATERAL (SELECT * FROM (VALUES ('INC-02 becomes unknown', NOT gone AND was IS NOT NULL AND now IS NULL), ('INC-02 flips', NOT gone AND was IS NOT NULL AND now IS NOT NULL AND was <> now), ('nothing moves', moved = 0), ('only INC-02 moves', moved > 0 AND others = 0), ('coverage holds', covered), ('outcome holds', same), ('evaluated twice', NOT gone), ('outcome and coverage hold', same AND covered)) x(relation, holds)) GROUP BY relation""", _REDACTED, _CUT, _screen(), _screen(ev="cut", tag="_r")),
    "perturb_add_observation": _q("SELECT patient_id, count(*) AS n, CAST(max(date) AS VARCHAR) AS last, arg_max(value, {'d': date, 's': seq}) AS value FROM added WHERE code = '2160-0' AND value IS NOT NULL AND date IS NOT NULL GROUP BY patient_id", "added AS (SELECT patient_id, code, value, date, seq FROM evidence UNION ALL SELECT 1, '2160-0', 20.0, DATE '2002-01-01', 'added')"),
    "edit_record": _q("SELECT 'before' AS side, kind, count(*) AS n FROM evidence WHERE code = '4548-4' AND kind = 'observation' GROUP BY kind"),
    "span_coverage": oracles.CLAIMS + " SELECT count(*) FILTER (claim <> 'unclaimed') AS claimed, count(*) AS spans FROM claims",
    "ordinal_ids": "SELECT doc_id % 10 AS nct_id, CASE WHEN doc_id % 2 = 0 THEN 'inclusion' ELSE 'exclusion' END AS kind, doc_id AS ord, CASE WHEN doc_id % 2 = 0 THEN 'INC-' ELSE 'EXC-' END || CASE WHEN k < 10 THEN '0' ELSE '' END || k AS criterion_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) AS k FROM documents)",
    "protocol_fingerprints": "SELECT doc_id AS nct_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "downgraded_criteria": f"SELECT doc_id AS nct_id, 'INC-01' AS criterion_id, CASE WHEN w.nct_id IS NOT NULL THEN 'unsupported' ELSE 'condition' END AS type, CASE WHEN w.nct_id IS NOT NULL THEN 'the quote is not in the protocol' END AS reason FROM documents LEFT JOIN ({oracles.QUOTES}) w ON w.nct_id = doc_id",
    "rendered_units": oracles.SPANS + """, climbs AS (SELECT nct_id, index, index AS root, parent_index FROM spans UNION ALL SELECT c.nct_id, c.index, s.index, s.parent_index FROM climbs c JOIN spans s ON s.nct_id = c.nct_id AND s.index = c.parent_index),
 units AS (SELECT nct_id, index, root AS unit FROM climbs WHERE parent_index IS NULL)
 SELECT s.nct_id, u.unit, md5('Section: ' || arg_min(s.section, s.index) || chr(10) || string_agg(CASE WHEN s.index = u.unit THEN s.text ELSE '  - ' || s.text END, chr(10) ORDER BY s.index)) AS prompt_md5 FROM spans s JOIN units u ON u.nct_id = s.nct_id AND u.index = s.index GROUP BY s.nct_id, u.unit""",
}
