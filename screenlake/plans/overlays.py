"""Queries on many edited charts in one screening, with their DuckDB SQL, which screens each edited corpus anew."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from screenlake.operators import overlay, relations
from screenlake.plans.catalog import _BASE, _latest, _screen, AS_OF, FIRST_ORDER, PROTOCOL, tables  # noqa: F401

DAY, LATE, EARLY = date(1998, 5, 31), date(1998, 1, 1), date(1996, 1, 1)
EDITS = [
    overlay.redact_analyte("no creatinine", "2160-0"),
    overlay.redact_analyte("no a1c", "4548-4"),
    overlay.shift_value("creatinine up", "2160-0", 99.0),
    overlay.shift_value("a1c up", "4548-4", 50.0),
    overlay.convert_units("creatinine in mg/L", "2160-0", "mg/L", 10.0),
    overlay.shift_date("first order moved", FIRST_ORDER, DAY),
    overlay.remove_encounters("no visits of 1998", LATE),
    overlay.remove_encounters("no visits since 1996", EARLY),
    overlay.add_condition("urgent added", 1, "SNOMED", "1-URGENT", "1-URGENT", DAY),
    overlay.add_observation("creatinine added", 2, "2160-0", "Creatinine", 20.0, "mg/dL", DAY),
    overlay.record_death("death recorded", 5, AS_OF),
]
RELATIONS = {
    "no creatinine": {"becomes unknown": relations.becomes_unknown, "only it moves": relations.only_moves},
    "no a1c": {"only it moves": relations.only_moves, "coverage holds": relations.coverage_holds},
    "creatinine up": {"flips": relations.flips},
    "a1c up": {"flips": relations.flips},
    "creatinine in mg/L": {"nothing moves": relations.nothing_moves},
    "first order moved": {"outcome holds": relations.outcome_holds},
    "no visits of 1998": {"coverage holds": relations.coverage_holds},
    "no visits since 1996": {"outcome and coverage hold": lambda: relations.all_hold(relations.outcome_holds(), relations.coverage_holds())},
    "urgent added": {"only it moves": relations.only_moves},
    "creatinine added": {"coverage holds": relations.coverage_holds, "outcome holds": relations.outcome_holds},
    "death recorded": {"stops": lambda: relations.blocked(False, True)},
}
#: The criterion that a relation is about.
ABOUT = {"no creatinine": "INC-02", "no a1c": "EXC-03", "creatinine up": "INC-02", "a1c up": "EXC-03", "urgent added": "EXC-01"}
_OF_ONE = ("becomes unknown", "only it moves", "flips")


def pairs(spark, d):
    return overlay.edited(*tables(spark, d), PROTOCOL, AS_OF, EDITS)


def expected():
    return {e: {n: f(ABOUT[e]) if n in _OF_ONE else f() for n, f in named.items()} for e, named in RELATIONS.items()}


QUERIES = {
    "edited_screenings": lambda s, d: pairs(s, d).select(
        "edit", "patient_id", F.col("decision_b").alias("before"), F.col("decision_a").alias("after"), F.round("coverage_b", 6).alias("coverage_before"), F.round("coverage_a", 6).alias("coverage_after"), F.array_join("moved", ",").alias("moved"),
    ),
    "metamorphic_suite": lambda s, d: overlay.suite(pairs(s, d), expected()),
}

_OBS = "kind = 'observation' AND code = '{0}'"
_RANKED = "SELECT patient_id, kind, system, code, display, CASE WHEN {0} AND k = 1 THEN {1} ELSE value END AS value, unit, date, seq FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, {0} ORDER BY date DESC NULLS LAST, seq) AS k FROM evidence)"
_ROW = "SELECT * FROM evidence UNION ALL SELECT {0}, '{1}', '{2}', '{3}', '{4}', {5}, {6}, DATE '1998-05-31', 'added'"
#: For each edit the evidence after it and the charts that it touches.
_AFTER = {
    "no creatinine": (f"SELECT * FROM evidence WHERE NOT ({_OBS.format('2160-0')})", _OBS.format("2160-0")),
    "no a1c": (f"SELECT * FROM evidence WHERE NOT ({_OBS.format('4548-4')})", _OBS.format("4548-4")),
    "creatinine up": (_RANKED.format(f"({_OBS.format('2160-0')})", "99.0"), _OBS.format("2160-0")),
    "a1c up": (_RANKED.format(f"({_OBS.format('4548-4')})", "50.0"), _OBS.format("4548-4")),
    "creatinine in mg/L": (f"SELECT * REPLACE (CASE WHEN {_OBS.format('2160-0')} AND value IS NOT NULL THEN 'mg/dL' ELSE unit END AS unit) FROM evidence", f"{_OBS.format('2160-0')} AND value IS NOT NULL"),
    "first order moved": (f"SELECT * REPLACE (CASE WHEN seq = '{FIRST_ORDER}' THEN DATE '1998-05-31' ELSE date END AS date) FROM evidence", f"seq = '{FIRST_ORDER}'"),
    "no visits of 1998": ("SELECT * FROM evidence WHERE NOT (kind = 'encounter' AND date > DATE '1998-01-01')", "kind = 'encounter' AND date > DATE '1998-01-01'"),
    "no visits since 1996": ("SELECT * FROM evidence WHERE NOT (kind = 'encounter' AND date > DATE '1996-01-01')", "kind = 'encounter' AND date > DATE '1996-01-01'"),
    "urgent added": (_ROW.format(1, "condition", "SNOMED", "1-URGENT", "1-URGENT", "NULL", "NULL"), "patient_id = 1"),
    "creatinine added": (_ROW.format(2, "observation", "LOINC", "2160-0", "Creatinine", 20.0, "'mg/dL'"), "patient_id = 2"),
    "death recorded": ("SELECT * FROM evidence", "patient_id = 5"),
}


def _edited_sql() -> str:
    ctes, found = [_BASE, _screen()], []
    for i, (name, (rows, touched)) in enumerate(_AFTER.items()):
        screened = _screen(ev=f"ev{i}", tag=f"_{i}")
        if name == "death recorded":
            ctes.append(f"dying AS (SELECT * REPLACE (CASE WHEN patient_id = 5 THEN DATE '{AS_OF}' ELSE deceased END AS deceased) FROM patients)")
            screened = screened.replace("FROM patients", "FROM dying")
        ctes += [f"ev{i} AS ({rows})", screened]
        who = "SELECT patient_id FROM patients" if touched.startswith("patient_id") else "SELECT patient_id FROM evidence"
        found.append(f"SELECT '{name}' AS edit, t.patient_id, 'a' AS side, criterion_id, verdict FROM ({who} WHERE {touched} GROUP BY patient_id) t LEFT JOIN verdicts_{i} USING (patient_id) UNION ALL SELECT '{name}', t.patient_id, 'b', criterion_id, verdict FROM ({who} WHERE {touched} GROUP BY patient_id) t LEFT JOIN verdicts USING (patient_id)")
    ctes.append("sides AS MATERIALIZED (" + " UNION ALL ".join(found) + ")")
    ctes.append("heads AS (" + " UNION ALL ".join(f"SELECT '{name}' AS edit, patient_id, a.decision, a.coverage, a.blocked_by IS NOT NULL AS blocked FROM decided_{i} a" for i, name in enumerate(_AFTER)) + ")")
    ctes.append("""criteria AS (SELECT edit, patient_id, criterion_id, bool_or(verdict) FILTER (side = 'b') AS was, bool_or(verdict) FILTER (side = 'a') AS now, count(DISTINCT side) = 2 AS there FROM sides WHERE criterion_id IS NOT NULL GROUP BY ALL)""")
    ctes.append("""both_runs AS (SELECT s.edit, s.patient_id, b.decision AS before, a.decision AS after, b.coverage AS cb, a.coverage AS ca, b.blocked_by IS NOT NULL AS blocked_b, a.blocked AS blocked_a,
  coalesce((SELECT string_agg(criterion_id, ',' ORDER BY criterion_id) FROM criteria c WHERE c.edit = s.edit AND c.patient_id = s.patient_id AND (was IS DISTINCT FROM now OR NOT there)), '') AS moved
 FROM (SELECT DISTINCT edit, patient_id FROM sides) s JOIN decided b USING (patient_id) JOIN heads a USING (edit, patient_id))""")
    return ", ".join(ctes)


_EDITED = _edited_sql()
_SQL_OF = {
    "becomes unknown": "CASE WHEN there IS NOT TRUE THEN about || ' is not among the criteria screened' WHEN was IS NULL THEN about || ' was already unknown' WHEN now IS NOT NULL THEN about || ' is still decided' END",
    "flips": "CASE WHEN there IS NOT TRUE THEN about || ' is not among the criteria screened' WHEN was IS NULL OR now IS NULL THEN about || ' is not decided on both sides' WHEN was = now THEN about || ' stayed as it was' END",
    "only it moves": "CASE WHEN len(list_filter(string_split(moved, ','), lambda x: x <> about AND x <> '')) > 0 THEN 'other verdicts moved: ' || array_to_string(list_filter(string_split(moved, ','), lambda x: x <> about), ', ') WHEN moved = '' THEN about || ' stayed as it was' END",
    "nothing moves": "CASE WHEN moved <> '' THEN 'verdicts moved: ' || replace(moved, ',', ', ') END",
    "coverage holds": "CASE WHEN ca < cb THEN 'coverage fell' END",
    "outcome holds": "CASE WHEN before <> after THEN 'the decision moved from ' || before || ' to ' || after END",
    "outcome and coverage hold": "nullif(concat_ws('; ', CASE WHEN before <> after THEN 'the decision moved from ' || before || ' to ' || after END, CASE WHEN ca < cb THEN 'coverage fell' END), '')",
    "stops": "CASE WHEN blocked_b THEN 'the first run was blocked' WHEN NOT blocked_a THEN 'the second run was evaluated' END",
}

SQL = {
    "edited_screenings": f"{_EDITED}\nSELECT edit, patient_id, before, after, round(cb, 6) AS coverage_before, round(ca, 6) AS coverage_after, moved FROM both_runs",
    "metamorphic_suite": f"{_EDITED}, asked AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{n}', '{ABOUT.get(e, '')}')" for e, named in RELATIONS.items() for n in named) + ") t(edit, relation, about))\n"
    + "SELECT patient_id, edit, relation, CASE relation " + " ".join(f"WHEN '{n}' THEN {x}" for n, x in _SQL_OF.items()) + " END AS problem"
    + " FROM both_runs JOIN asked USING (edit) LEFT JOIN criteria c ON c.edit = both_runs.edit AND c.patient_id = both_runs.patient_id AND c.criterion_id = about".replace("SELECT patient_id", "SELECT both_runs.patient_id"),
}
SQL["metamorphic_suite"] = SQL["metamorphic_suite"].replace("SELECT patient_id, edit, relation, CASE relation", "SELECT both_runs.patient_id, both_runs.edit, relation, CASE relation")
