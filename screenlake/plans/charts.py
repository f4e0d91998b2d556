"""Queries on charts and on the reasons of verdicts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.operators import arms, chart, queue, reasons, screening
from screenlake.plans.catalog import _BASE, AS_OF, PROTOCOL, SECOND, SECOND_SQL, _screen, _word, both_trials, day, patients, tables, word
from screenlake.sources.testdata import evidence

_DISPLAY = "CASE WHEN kind = 'condition' AND right(seq, 1) IN ('1', '2') THEN concat(display, ' (resolved, confirmed)') WHEN kind = 'condition' AND right(seq, 1) = '4' THEN concat(display, ' (finding)') WHEN kind <> 'condition' AND right(seq, 1) = '5' THEN '' ELSE display END"
_UNIT = "CASE WHEN right(seq, 1) = '7' THEN upper(unit) ELSE unit END"
#: The evidence with records that have no code, no name, two codes, a status or another spelling of the unit, by the last digit of their place.
CHART_SQL = f"""SELECT patient_id, kind, CASE WHEN right(seq, 1) <> '3' THEN system END AS system, CASE WHEN right(seq, 1) <> '3' THEN code END AS code, {_DISPLAY} AS display, value, {_UNIT} AS unit, date, seq FROM evidence
UNION ALL SELECT patient_id, kind, 'ICD10', concat('X', code), {_DISPLAY}, value, {_UNIT}, date, seq FROM evidence WHERE right(seq, 1) IN ('8', '9')"""


def charts(spark, d) -> DataFrame:
    return spark.sql(CHART_SQL.replace("FROM evidence", "FROM {evidence}"), evidence=evidence(spark, d))


def explained(spark, d) -> DataFrame:
    return reasons.explain(*tables(spark, d), [PROTOCOL, SECOND], AS_OF)


def queue_rows(spark, d) -> DataFrame:
    """Queue rows of both trials; some charts of the first count as constructed from another one."""
    rows = queue.rows(screening.measures(both_trials(spark, d)), explained(spark, d)).filter("nct_id = 'NCT-A'")
    built = F.col("patient_id") % 10
    made = built.between(1, 3)
    return rows.withColumns({
        "case_id": F.when(made, F.concat(F.lit("C-"), "patient_id")),
        "base_patient_id": F.when(made, F.col("patient_id") - built),
        "edits": F.when(made, F.array(F.lit("a visit was added"), F.concat(F.lit("a value was set to "), built.cast("string")))),
    })


QUERIES = {
    "analyte_trend": lambda s, d: chart.analyte_trend(charts(s, d), AS_OF).select("patient_id", "analyte", "loinc", "display", "n", day("first_date").alias("first_date"), "latest", "unit", day("latest_date").alias("latest_date"), "previous", "previous_unit", "trend"),
    "latest_medication": lambda s, d: chart.latest_medication(charts(s, d), AS_OF).withColumn("latest_date", day("latest_date")),
    "chart_counts": lambda s, d: chart.chart_counts(charts(s, d)).withColumns({c: day(c) for c in ("first_date", "last_date")}),
    "chart_conditions": lambda s, d: chart.conditions(charts(s, d), AS_OF).withColumn("date", day("date")),
    "chart_summary": lambda s, d: chart.summary(patients(s, d), charts(s, d), AS_OF).withColumns({c: day(c) for c in ("first_visit", "last_visit")}),
    "criterion_reasons": lambda s, d: explained(s, d).filter("nct_id = 'NCT-B'").select("patient_id", "criterion_id", word(F.col("verdict")).alias("verdict"), "rationale", "missing", "query", F.array_join("evidence", ",").alias("evidence")),
    "blocker_reasons": lambda s, d: screening.blockers(both_trials(s, d).filter("nct_id = 'NCT-B'"), explained(s, d)).select("criterion_id", "n", "screenings", "reason", "missing"),
    "screen_two_trials": lambda s, d: both_trials(s, d).groupBy("nct_id", "decision", "blocked_by").agg(F.count("*").alias("n"), F.round(F.avg("coverage"), 6).alias("mean_coverage")),
    "screening_measures": lambda s, d: screening.measures(both_trials(s, d).filter("nct_id = 'NCT-A'")).select("patient_id", "criteria_total", "criteria_resolved", F.array_join("at_visit_ids", ",").alias("at_visit_ids")),
    "cohort_table": lambda s, d: arms.cohort(screening.measures(both_trials(s, d)), explained(s, d)).filter("nct_id = 'NCT-B'").select("decision", "n", F.round("mean_resolved", 6).alias("mean_resolved"), "least_gaps", "most_gaps"),
    "queue_filter": lambda s, d: (lambda df: df.filter(queue.matches(df, "C-11", "needs_review", True) | queue.matches(df, "EXC-04", "ineligible", False)))(queue_rows(s, d)).select("patient_id", "decision"),
    "queue_order": lambda s, d: queue.ordered(queue_rows(s, d), "nearest").select("patient_id", "decision", "open_retrievable", "open_person", F.array_join(queue.distance(), "/").alias("distance")),
    "chart_comparisons": lambda s, d: queue.comparisons(queue_rows(s, d)).select("base_patient_id", "patient_id", "case_id", "decision", F.array_join("own_edits", "; ").alias("own_edits"), "place"),
}

_FACTS = f"""chart AS ({CHART_SQL}), facts AS (SELECT patient_id, kind, seq, min(display) AS display, min(value) AS value, min(unit) AS unit, min(date) AS date, min(code) FILTER (system = 'LOINC') AS loinc, min(code) FILTER (system = 'RxNorm') AS rxnorm FROM chart GROUP BY ALL),
named AS (SELECT *, coalesce(nullif(trim(display), ''), '(unlabelled ' || CASE kind WHEN 'observation' THEN 'Observation' WHEN 'condition' THEN 'Condition' WHEN 'medication' THEN 'MedicationRequest' ELSE 'Encounter' END || ')') AS label, (date IS NULL OR date <= DATE '{AS_OF}') AS known,
  coalesce('LOINC:' || nullif(loinc, ''), 'display:' || nullif(lower(trim(display)), ''), 'resource:' || seq) AS analyte, coalesce('RxNorm:' || nullif(rxnorm, ''), 'display:' || nullif(lower(trim(display)), ''), 'resource:' || seq) AS drug FROM facts),
conditions AS (SELECT patient_id, seq, date, CASE WHEN ends_with(label, ' (resolved, confirmed)') THEN left(label, length(label) - 22) ELSE label END AS display, CASE WHEN ends_with(label, ' (resolved, confirmed)') THEN 'resolved' END AS status,
  CASE WHEN ends_with(label, ' (resolved, confirmed)') THEN 'confirmed' END AS verification FROM named WHERE kind = 'condition' AND known)"""


def _q(select: str, *ctes: str) -> str:
    return ", ".join([_BASE, *ctes]) + "\n" + select


_OPEN = "opens AS (SELECT patient_id, count(*) FILTER (query <> '') AS retrievable, count(*) FILTER (query = '') AS person FROM asked WHERE verdict IS NULL AND blocking GROUP BY patient_id)"
#: What is open in the first trial; only age and sex have no resource to search, and none is without a query but the visit, which doesn't block.
_QUEUE = [
    _screen(),
    "asked AS (SELECT v.*, 'q' AS query FROM verdicts v)",
    _OPEN,
    "queue AS (SELECT d.patient_id, d.decision, d.deciding_ids, coalesce(o.retrievable, 0) AS retrievable, coalesce(o.person, 0) AS person, d.patient_id % 10 BETWEEN 1 AND 3 AS made FROM decided d LEFT JOIN opens o USING (patient_id))",
]

SQL = {
    "analyte_trend": _q("""SELECT patient_id, analyte, loinc, label AS display, n, CAST(first_date AS VARCHAR) AS first_date, value AS latest, unit, CAST(date AS VARCHAR) AS latest_date, previous, previous_unit,
  CASE WHEN n < 2 THEN NULL WHEN lower(previous_unit) <> lower(unit) THEN 'unit changed' WHEN value > previous THEN 'rising' WHEN value < previous THEN 'falling' ELSE 'unchanged' END AS trend
 FROM (SELECT *, lead(value) OVER w AS previous, lead(unit) OVER w AS previous_unit, row_number() OVER w AS k, count(*) OVER (PARTITION BY patient_id, analyte) AS n, min(date) OVER (PARTITION BY patient_id, analyte) AS first_date
  FROM named WHERE kind = 'observation' AND value IS NOT NULL AND known WINDOW w AS (PARTITION BY patient_id, analyte ORDER BY date DESC NULLS LAST, seq)) WHERE k = 1""", _FACTS),
    "latest_medication": _q("SELECT patient_id, drug, n AS orders, CAST(date AS VARCHAR) AS latest_date, label AS display, seq FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, drug ORDER BY date DESC NULLS LAST, seq) AS k, count(*) OVER (PARTITION BY patient_id, drug) AS n FROM named WHERE kind = 'medication' AND known) WHERE k = 1", _FACTS),
    "chart_counts": _q("SELECT patient_id, kind, count(*) AS n, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, CAST(year(max(date)) - year(min(date)) AS INTEGER) AS span_years FROM facts GROUP BY ALL", _FACTS),
    "chart_conditions": _q("""SELECT patient_id, seq, CAST(date AS VARCHAR) AS date, display, status, verification, status IS NULL AS open,
  CAST(row_number() OVER (PARTITION BY patient_id, status IS NULL ORDER BY coalesce(CAST(date AS VARCHAR), ''), lower(display), seq) AS INTEGER) AS place FROM conditions""", _FACTS),
    "chart_summary": _q(f"""SELECT p.patient_id, CAST(date_diff('year', p.birth_date, DATE '{AS_OF}') - CASE WHEN p.birth_date + to_years(CAST(date_diff('year', p.birth_date, DATE '{AS_OF}') AS INTEGER)) > DATE '{AS_OF}' THEN 1 ELSE 0 END AS INTEGER) AS age_years, p.sex,
  count(*) FILTER (kind = 'condition' AND known AND NOT ends_with(label, '(resolved, confirmed)')) AS open_conditions, count(*) FILTER (kind = 'condition' AND known AND ends_with(label, '(resolved, confirmed)')) AS closed_conditions,
  count(DISTINCT drug) FILTER (kind = 'medication' AND known) AS drugs, count(DISTINCT analyte) FILTER (kind = 'observation' AND known AND value IS NOT NULL) AS analytes, count(*) FILTER (kind = 'observation' AND known AND value IS NULL) AS without_value,
  count(*) FILTER (kind = 'encounter' AND known) AS visits, CAST(min(date) FILTER (kind = 'encounter' AND known) AS VARCHAR) AS first_visit, CAST(max(date) FILTER (kind = 'encounter' AND known) AS VARCHAR) AS last_visit,
  count(*) FILTER (kind = 'note' AND known) AS notes, count(*) FILTER (NOT known) AS left_out FROM patients p LEFT JOIN named n USING (patient_id) GROUP BY ALL""", _FACTS),
    "criterion_reasons": _q(f"SELECT patient_id, criterion_id, {_word('verdict')} AS verdict, rationale, missing, query, evidence FROM second", SECOND_SQL),
    "blocker_reasons": _q("SELECT criterion_id, count(*) AS n, (SELECT count(*) FROM patients) AS screenings, arg_min(rationale, patient_id) AS reason, arg_min(missing, patient_id) AS missing FROM second WHERE verdict IS NULL AND blocking GROUP BY criterion_id", SECOND_SQL),
    "screen_two_trials": _q("""SELECT 'NCT-A' AS nct_id, decision, blocked_by, count(*) AS n, round(avg(coverage), 6) AS mean_coverage FROM decided GROUP BY ALL
 UNION ALL SELECT 'NCT-B', decision, NULL, count(*), round(avg(coverage), 6) FROM (SELECT patient_id, CASE WHEN bool_or((criterion_id LIKE 'INC%' AND NOT verdict) OR (criterion_id LIKE 'EXC%' AND verdict)) THEN 'ineligible' ELSE 'needs_review' END AS decision, count(verdict) / 5 AS coverage FROM second GROUP BY patient_id) GROUP BY ALL
 UNION ALL SELECT 'NCT-B', 'ineligible', 'deceased', count(*), 1.0 FROM decided WHERE blocked_by = 'deceased'""", _screen(), SECOND_SQL),
    "screening_measures": _q("""SELECT patient_id, CAST(count(*) FILTER (blocking) AS INTEGER) AS criteria_total, CAST(count(*) FILTER (blocking AND verdict IS NOT NULL) AS INTEGER) AS criteria_resolved, coalesce(string_agg(criterion_id, ',' ORDER BY ord) FILTER (verdict IS NULL AND NOT blocking), '') AS at_visit_ids FROM verdicts GROUP BY patient_id
 UNION ALL SELECT patient_id, 0, 0, '' FROM decided WHERE blocked_by = 'deceased'""", _screen()),
    "cohort_table": _q("""SELECT decision, count(*) AS n, round(avg(resolved), 6) AS mean_resolved, min(gaps) AS least_gaps, max(gaps) AS most_gaps FROM (
  SELECT CASE WHEN bool_or((criterion_id LIKE 'INC%' AND NOT verdict) OR (criterion_id LIKE 'EXC%' AND verdict)) THEN 'ineligible' ELSE 'needs_review' END AS decision, count(verdict) AS resolved, count(*) FILTER (verdict IS NULL AND query <> '') AS gaps FROM second GROUP BY patient_id
  UNION ALL SELECT 'ineligible', 0, 0 FROM decided WHERE blocked_by = 'deceased') GROUP BY decision""", _screen(), SECOND_SQL),
    "queue_filter": _q("SELECT patient_id, decision FROM queue LEFT JOIN (SELECT patient_id, arg_min(criterion_id, ord) AS first_open FROM verdicts WHERE verdict IS NULL AND blocking GROUP BY patient_id) USING (patient_id) WHERE (decision = 'needs_review' AND made AND contains('c-' || patient_id, 'c-11')) OR (decision = 'ineligible' AND NOT made AND (contains(deciding_ids, 'EXC-04') OR first_open = 'EXC-04'))", *_QUEUE),
    "queue_order": _q("SELECT patient_id, decision, retrievable AS open_retrievable, person AS open_person, CASE WHEN decision = 'needs_review' AND retrievable > 0 THEN '0/' || retrievable || '/' || person WHEN decision = 'needs_review' THEN '1/' || person || '/0' WHEN decision = 'eligible' THEN '2/0/0' ELSE '3/0/0' END AS distance FROM queue", *_QUEUE),
    "chart_comparisons": _q("""SELECT base_patient_id, patient_id, case_id, decision, own_edits, CAST(row_number() OVER (PARTITION BY base_patient_id ORDER BY case_id NULLS FIRST) - 1 AS INTEGER) AS place FROM (
  SELECT patient_id - patient_id % 10 AS base_patient_id, patient_id, 'C-' || patient_id AS case_id, decision, 'a value was set to ' || (patient_id % 10) AS own_edits FROM queue WHERE made AND (SELECT count(*) FROM queue q WHERE q.made AND q.patient_id // 10 = queue.patient_id // 10) > 1
  UNION ALL SELECT patient_id, patient_id, NULL, decision, '' FROM queue WHERE patient_id % 10 = 0 AND (SELECT count(*) FROM queue q WHERE q.made AND q.patient_id // 10 = queue.patient_id // 10) > 1)""", *_QUEUE),
}
