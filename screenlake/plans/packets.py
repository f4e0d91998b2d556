"""Queries on packets of two trials, with their DuckDB SQL.

The third trial has windows that are counted from other events, composites that
one member decides, a question for the visit and a criterion that people answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.operators import packets
from screenlake.plans.catalog import _BASE, AS_OF, CREATININE, GLUCOSE, LOW, SECOND, SECOND_SQL, URGENT, _latest, _within, patients, tables
from screenlake.sources import viewer
from screenlake.plans.criteria import Composite, Criterion, Demographic, Observation, Presence, Protocol, Unsupported, Window

THIRD = Protocol("NCT-C", (
    Criterion("INC-01", "inclusion", Composite("all_of", (Demographic("age", ">=", 18), Observation(CREATININE, "between", 2, "mg/dL", 45, Window("within", 24, "months", "randomization")))), "Adults with a creatinine of 2 to 45"),
    Criterion("INC-02", "inclusion", Observation(GLUCOSE, ">=", 5, "mg/dL", None, Window("within", 18, "months", "enrollment")), "Glucose of 5 or more"),
    Criterion("INC-03", "inclusion", Unsupported("consent at the visit", "at_visit"), "Consents"),
    Criterion("EXC-01", "exclusion", Composite("any_of", (Presence("condition", URGENT, "present", Window("within", 12, "months", "last_dose")), Demographic("age", ">", 85))), "Urgent or above 85"),
    Criterion("EXC-02", "exclusion", Presence("condition", LOW, "present", Window("within", 9, "months", "last_dose")), "Low priority"),
))
TITLES = {"NCT-C": "A third trial"}


def answered(spark, d) -> DataFrame:
    """Answers of people by rule: every seventh patient has one for the glucose criterion, and one for a criterion the record decides."""
    own = patients(spark, d).filter("patient_id % 7 = 0").select(F.lit("NCT-C").alias("nct_id"), "patient_id", F.explode(F.array(F.lit("INC-02"), F.lit("EXC-02"))).alias("criterion_id"))
    return own.select("*", F.expr("if(patient_id % 2 = 0, 'MET', 'NOT_MET')").alias("verdict"), F.lit("Dr Lin").alias("answered_by"), F.lit("1998-05-20").cast("date").alias("answered_on"), F.lit("Seen in clinic.").alias("note"))


def documents(spark, d) -> DataFrame:
    people, evidence = tables(spark, d)
    return packets.packets(people, evidence, [THIRD, SECOND], AS_OF, settlements=answered(spark, d), titles=TITLES, fingerprints={"NCT-C": "c0ffee"})


def _cited(rows: DataFrame) -> DataFrame:
    cited = F.array_join(F.transform("evidence", lambda e: F.concat_ws(", ", e["resource"], e["description"], e["recorded_on"], e["fhir_path"])), "; ")
    return rows.select(
        "nct_id", "patient_id", "place", "criterion_id", "kind", "quote", "verdict", "verdict_slug", "rationale", "engine_written", "decisive",
        F.array_join("caveats", "; ").alias("caveats"), F.col("settled_by.answered_by").alias("answered_by"), cited.alias("evidence"),
    )


QUERIES = {
    "packet_headers": lambda s, d: documents(s, d).select(
        "nct_id", "patient_id", "trial", "patient_summary", "decision", "verdict", "blocked_by", "stopped_note", "caveat_note", "settlement_note", "absence_policy_note", "criteria_fingerprint",
        "criteria_resolved", "criteria_total", "coverage_note", "engine_written", "rationale_note",
    ),
    "packet_rows": lambda s, d: _cited(packets.rows(documents(s, d))),
    "packet_items": lambda s, d: packets.items(documents(s, d)),
    "packet_caveats": lambda s, d: packets.caveats(documents(s, d)).withColumn("criterion_ids", F.array_join("criterion_ids", ",")),
    "viewer_index": lambda s, d: viewer.entries(documents(s, d)).drop("patient_summary", "screened_on").withColumn("deciding_criterion_ids", F.array_join("deciding_criterion_ids", ",")),
}

_AGE = "CASE WHEN age IS NULL THEN 'no date of birth is recorded, so age cannot be computed' ELSE 'age ' || age || ' years at screening against {0}' END"
_LAB = "CASE WHEN {0}_seq IS NULL THEN 'no {1} result is on file for the required window' WHEN {0}_value IS NULL THEN 'the most recent matching result carries no numeric value' ELSE printf('%g', {2}) || ' mg/dL on ' || {0}_date || ' against {3} mg/dL' END"
_NO_LAB = "CASE WHEN {0}_seq IS NULL THEN 'a {1} result' WHEN {0}_value IS NULL THEN 'a numeric value for {1}' END"
_LAB_CITED = "CASE WHEN {0}_seq IS NULL THEN '' ELSE 'Observation/' || {0}_seq || ', {1}' || CASE WHEN {0}_value IS NULL THEN '' ELSE ' ' || printf('%g', {0}_value) || ' ' || {0}_unit END || ', ' || {0}_date || ', Observation/' || {0}_seq END"
_FOUND = """CASE WHEN {0}_seq IS NOT NULL THEN '{1} is documented (Condition/' || {0}_seq || ': ' || {0}_display || ' (' || {0}_date || '))' WHEN {2} THEN '{1} is not documented in a window the chart covers'
 ELSE 'nothing documents {1} in the required window, and the chart does not show the window was covered' END"""
_FOUND_CITED = "CASE WHEN {0}_seq IS NULL THEN '' ELSE 'Condition/' || {0}_seq || ', ' || {0}_display || ', ' || {0}_date || ', Condition/' || {0}_seq END"
_CONFIRM = "'confirmation that {0} is genuinely absent rather than merely unrecorded'"
_CAVEAT = "'the protocol anchors this window to {0}, which was evaluated against the screening date'"


def _condition(name: str, code: str, amount: int) -> str:
    return f"{name} AS (SELECT patient_id, display, date, seq FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY date DESC NULLS LAST, seq) AS k FROM evidence WHERE kind = 'condition' AND code = '{code}' AND {_within(amount, 'months')}) WHERE k = 1)"


_A, _C = _AGE.format(">= 18.0"), _LAB.format("cr", "Creatinine", "m", "between 2.0 and 45.0")
_U, _OLD = _FOUND.format("ur", "urgent", "covered12"), _AGE.format("> 85.0")
_EITHER = "concat_ws(' {0} ', CASE WHEN {1} THEN {2} END, CASE WHEN {3} THEN {4} END)"

PACKET_SQL = ", ".join([
    SECOND_SQL,
    _latest("cr", f"kind = 'observation' AND code = '2160-0' AND {_within(24, 'months')}"),
    _condition("ur", "1-URGENT", 12),
    f"v12 AS (SELECT DISTINCT patient_id FROM evidence WHERE kind = 'encounter' AND {_within(12, 'months')})",
    f"""members AS (SELECT *, age >= 18 AS a, m BETWEEN 2 AND 45 AS c, (a AND c) AS v1, CASE WHEN ur_seq IS NOT NULL THEN true WHEN covered12 THEN false END AS u, age > 85 AS o, (u OR o) AS v4 FROM (
  SELECT x.*, gl.unit AS gl_unit, cr.seq AS cr_seq, cr.date AS cr_date, cr.value AS cr_value, cr.unit AS cr_unit, CASE cr.unit WHEN 'mg/dL' THEN cr.value WHEN 'umol/L' THEN cr.value * 1.0 * 113.12 / 1000.0 / 10.0 END AS m,
   ur.seq AS ur_seq, ur.date AS ur_date, ur.display AS ur_display, v12.patient_id IS NOT NULL AS covered12, CASE WHEN x.patient_id % 7 = 0 THEN x.patient_id % 2 = 0 END AS answer
  FROM alive2 x LEFT JOIN gl USING (patient_id) LEFT JOIN cr USING (patient_id) LEFT JOIN ur USING (patient_id) LEFT JOIN v12 USING (patient_id)))""",
    f"""settled AS (SELECT *, 'Settled by Dr Lin on 1998-05-20, not from the record: ' || CASE WHEN answer THEN 'met' ELSE 'not met' END || '. Seen in clinic.' AS told FROM members)""",
    f"""prows AS (
 SELECT 'NCT-C' AS nct_id, patient_id, 0 AS ord, 'INC-01' AS criterion_id, 'Adults with a creatinine of 2 to 45' AS quote, v1 AS verdict, true AS blocking,
   {_EITHER.format('and', 'v1 IS DISTINCT FROM false OR a = false', _A, 'v1 IS DISTINCT FROM false OR c = false', _C)} AS rationale,
   CASE WHEN v1 IS NULL THEN CASE WHEN a IS NULL THEN 'the patient''s date of birth' ELSE {_NO_LAB.format('cr', 'Creatinine')} END END AS missing,
   CASE WHEN v1 IS DISTINCT FROM false OR c = false THEN {_CAVEAT.format('randomization')} ELSE '' END AS caveats, CAST(NULL AS VARCHAR) AS answered_by,
   CASE WHEN v1 IS DISTINCT FROM false OR c = false THEN {_LAB_CITED.format('cr', 'Creatinine')} ELSE '' END AS evidence FROM settled
 UNION ALL SELECT 'NCT-C', patient_id, 1, 'INC-02', 'Glucose of 5 or more', coalesce(g >= 5, answer), true, CASE WHEN g IS NULL AND answer IS NOT NULL THEN told ELSE {_LAB.format('gl', 'Glucose', 'g', '>= 5.0')} END,
   CASE WHEN g IS NULL AND answer IS NULL THEN {_NO_LAB.format('gl', 'Glucose')} END, {_CAVEAT.format('enrollment')}, CASE WHEN g IS NULL AND answer IS NOT NULL THEN 'Dr Lin' END,
   CASE WHEN g IS NULL AND answer IS NOT NULL THEN '' ELSE {_LAB_CITED.format('gl', 'Glucose')} END FROM settled
 UNION ALL SELECT 'NCT-C', patient_id, 2, 'INC-03', 'Consents', CAST(NULL AS BOOLEAN), false, 'this criterion is settled at the screening visit, not from the record', 'confirmation at the screening visit: consent at the visit', '', NULL, '' FROM settled
 UNION ALL SELECT 'NCT-C', patient_id, 3, 'EXC-01', 'Urgent or above 85', v4, true, {_EITHER.format('or', 'v4 IS DISTINCT FROM true OR u', _U, 'v4 IS DISTINCT FROM true OR o', _OLD)},
   CASE WHEN v4 IS NULL THEN CASE WHEN u IS NULL THEN {_CONFIRM.format('urgent')} ELSE 'the patient''s date of birth' END END,
   CASE WHEN v4 IS DISTINCT FROM true OR u THEN {_CAVEAT.format('last_dose')} ELSE '' END, NULL, CASE WHEN v4 IS DISTINCT FROM true OR u THEN {_FOUND_CITED.format('ur')} ELSE '' END FROM settled
 UNION ALL SELECT 'NCT-C', patient_id, 4, 'EXC-02', 'Low priority', coalesce(CASE WHEN lo_seq IS NOT NULL THEN true WHEN covered THEN false END, answer), true,
   CASE WHEN lo_seq IS NULL AND NOT covered AND answer IS NOT NULL THEN told ELSE {_FOUND.format('lo', 'low priority', 'covered')} END, CASE WHEN lo_seq IS NULL AND NOT covered AND answer IS NULL THEN {_CONFIRM.format('low priority')} END,
   {_CAVEAT.format('last_dose')}, CASE WHEN lo_seq IS NULL AND NOT covered AND answer IS NOT NULL THEN 'Dr Lin' END, {_FOUND_CITED.format('lo')} FROM settled
 UNION ALL SELECT 'NCT-B', patient_id, ord, criterion_id, '', verdict, blocking, rationale, missing, '', NULL,
   CASE criterion_id WHEN 'INC-02' THEN {_LAB_CITED.format('gl', 'Glucose')} WHEN 'EXC-01' THEN {_FOUND_CITED.format('lo')} ELSE '' END FROM second JOIN settled USING (patient_id))""",
    """placed AS (SELECT *, coalesce((criterion_id LIKE 'INC%' AND NOT verdict) OR (criterion_id LIKE 'EXC%' AND verdict), false) AS decisive FROM prows)""",
    """heads AS (SELECT nct_id, patient_id, CASE WHEN bool_or(decisive) THEN 'ineligible' WHEN bool_or(verdict IS NULL AND blocking) THEN 'needs_review' ELSE 'eligible' END AS decision, NULL AS blocked_by,
  count(*) FILTER (blocking AND verdict IS NOT NULL) AS resolved, count(*) FILTER (blocking) AS total, count(*) AS n_rows, count(DISTINCT nullif(caveats, '')) AS n_caveats, count(answered_by) AS n_answered FROM placed GROUP BY ALL
 UNION ALL SELECT t.nct_id, patient_id, 'ineligible', CASE WHEN deceased IS NULL THEN 'the chart records that the patient has died, without giving a date' ELSE 'the chart records that the patient died on ' || deceased || ', before the screening date' END, 0, 0, 0, 0, 0
  FROM patients, (VALUES ('NCT-C'), ('NCT-B')) t(nct_id) WHERE coalesce(deceased <= DATE '""" + str(AS_OF) + """', false) OR deceased_undated)""",
])


def _q(select: str) -> str:
    return f"{_BASE}, {PACKET_SQL}\n{select}"


_YEARS = f"date_diff('year', birth_date, DATE '{AS_OF}') - CASE WHEN birth_date + to_years(CAST(date_diff('year', birth_date, DATE '{AS_OF}') AS INTEGER)) > DATE '{AS_OF}' THEN 1 ELSE 0 END"

SQL = {
    "packet_headers": _q(f"""SELECT nct_id, patient_id, CASE WHEN nct_id = 'NCT-C' THEN 'NCT-C - A third trial' ELSE nct_id END AS trial,
  concat_ws(', ', CASE WHEN birth_date IS NOT NULL THEN ({_YEARS}) || ' years old' || CASE WHEN blocked_by IS NULL THEN ' at screening' ELSE '' END END, 'recorded sex ' || sex,
    CASE WHEN deceased IS NOT NULL THEN 'died ' || deceased || CASE WHEN blocked_by IS NULL THEN ', after this screening' ELSE '' END WHEN deceased_undated THEN 'recorded as deceased, no date given' END) AS patient_summary,
  decision, CASE decision WHEN 'eligible' THEN 'Eligible' WHEN 'ineligible' THEN 'Not eligible' ELSE 'Needs review before a decision' END AS verdict, blocked_by,
  'Screening stopped before any criterion was evaluated, because ' || blocked_by || '.' AS stopped_note,
  CASE WHEN n_caveats > 0 THEN 'This screening rests on ' || n_caveats || CASE WHEN n_caveats = 1 THEN ' approximation' ELSE ' approximations' END || '. The criteria affected are marked in the table below.' END AS caveat_note,
  CASE WHEN n_answered > 0 THEN n_answered || CASE WHEN n_answered = 1 THEN ' criterion' ELSE ' criteria' END || ' on this screening was answered by a person rather than from data.' END AS settlement_note,
  'coverage-gated, meaning a finding absent from the chart counts as absent only where an encounter documents the window' AS absence_policy_note, CASE WHEN nct_id = 'NCT-C' THEN 'c0ffee' END AS criteria_fingerprint,
  CAST(resolved AS INTEGER) AS criteria_resolved, CAST(total AS INTEGER) AS criteria_total,
  CASE WHEN blocked_by IS NOT NULL THEN 'no criterion was evaluated; the screening stopped before the protocol was run' ELSE resolved || ' of ' || total || ' decided from the patient record' END AS coverage_note, CAST(n_rows AS INTEGER) AS engine_written,
  CASE WHEN n_rows > 0 THEN n_rows || ' of ' || n_rows || ' were written by the screening engine, because the drafted sentence could not be verified against the record' END AS rationale_note
 FROM heads JOIN patients USING (patient_id)"""),
    "packet_rows": _q("""SELECT nct_id, patient_id, ord AS place, criterion_id, CASE WHEN criterion_id LIKE 'INC%' THEN 'Inclusion' ELSE 'Exclusion' END AS kind, quote, CASE WHEN verdict THEN 'Met' WHEN NOT verdict THEN 'Not met' ELSE 'Unresolved' END AS verdict,
  CASE WHEN verdict THEN 'met' WHEN NOT verdict THEN 'not-met' ELSE 'unresolved' END AS verdict_slug, rationale, true AS engine_written, decisive, caveats, answered_by, evidence FROM placed"""),
    "packet_items": _q("""SELECT nct_id, patient_id, section, CAST(row_number() OVER (PARTITION BY nct_id, patient_id, section ORDER BY criterion_id LIKE 'EXC%' AND section = 'deciding', ord) - 1 AS INTEGER) AS place, criterion_id, text FROM (
  SELECT nct_id, patient_id, ord, criterion_id, 'deciding' AS section, rationale AS text FROM placed WHERE decisive
  UNION ALL SELECT nct_id, patient_id, ord, criterion_id, 'open_items', missing FROM placed JOIN heads USING (nct_id, patient_id) WHERE decision = 'needs_review' AND verdict IS NULL AND blocking
  UNION ALL SELECT nct_id, patient_id, ord, criterion_id, 'at_visit', rationale FROM placed JOIN heads USING (nct_id, patient_id) WHERE decision <> 'ineligible' AND verdict IS NULL AND NOT blocking)"""),
    "viewer_index": _q("""SELECT h.nct_id, h.patient_id, h.nct_id || '--' || h.patient_id || '.json' AS file, decision, CASE decision WHEN 'eligible' THEN 'Eligible' WHEN 'ineligible' THEN 'Not eligible' ELSE 'Needs review before a decision' END AS decision_label, blocked_by,
  CAST(total AS INTEGER) AS criteria_total, CAST(resolved AS INTEGER) AS criteria_resolved, CAST(coalesce(n_open, 0) AS INTEGER) AS open_items, CAST(coalesce(n_asked, 0) AS INTEGER) AS open_retrievable, CAST(coalesce(n_open - n_asked, 0) AS INTEGER) AS open_needing_a_person,
  coalesce(asked.missing, anyone.missing) AS blocking, coalesce(asked.criterion_id, anyone.criterion_id) AS blocking_criterion_id, coalesce(ids, '') AS deciding_criterion_ids, CAST(n_caveats AS INTEGER) AS approximations,
  CAST(CASE WHEN decision <> 'ineligible' THEN coalesce(n_visit, 0) ELSE 0 END AS INTEGER) AS at_visit
 FROM heads h LEFT JOIN (SELECT nct_id, patient_id, count(*) FILTER (NOT blocking AND verdict IS NULL) AS n_visit, string_agg(criterion_id, ',' ORDER BY criterion_id LIKE 'EXC%', ord) FILTER (decisive) AS ids,
   count(*) FILTER (blocking AND verdict IS NULL AND NOT open_decided) AS n_open, count(*) FILTER (blocking AND verdict IS NULL AND NOT open_decided AND has_query) AS n_asked,
   arg_min({'missing': missing, 'criterion_id': criterion_id}, ord) FILTER (blocking AND verdict IS NULL AND NOT open_decided AND has_query) AS asked, arg_min({'missing': missing, 'criterion_id': criterion_id}, ord) FILTER (blocking AND verdict IS NULL AND NOT open_decided) AS anyone
   FROM (SELECT *, bool_or(decisive) OVER (PARTITION BY nct_id, patient_id) AS open_decided, nct_id = 'NCT-C' OR criterion_id <> 'EXC-02' AS has_query FROM placed) GROUP BY ALL) USING (nct_id, patient_id)"""),
    "packet_caveats": _q("""SELECT nct_id, patient_id, CAST(row_number() OVER (PARTITION BY nct_id, patient_id ORDER BY min(ord)) - 1 AS INTEGER) AS place, caveats AS text, string_agg(criterion_id, ',' ORDER BY ord) AS criterion_ids FROM placed WHERE caveats <> '' GROUP BY nct_id, patient_id, caveats"""),
}
