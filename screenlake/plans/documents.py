"""Queries on the document of an evaluation and on frozen keys, with their DuckDB SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.operators import key_files, report, screening
from screenlake.plans import catalog
from screenlake.plans.evaluation import _ALL, _CASES, _q, all_scores, cases

DIGEST = hashlib.sha256(b"NCT-A").hexdigest()
#: A text with a bar and a line break for the cell of every blocker.
QUOTE = "Age of 18 | more\n  years"


def document(spark, d) -> DataFrame:
    """All sections but the second key; the arm ``random`` has no answer for every eleventh case."""
    failed = cases(spark, d).filter("patient_id % 11 = 0").select(F.lit("random").alias("arm"), "case_id", F.lit("answer").alias("stage"))
    blockers = screening.blockers(catalog.both_trials(spark, d), top=4).withColumns({"quote": F.lit(QUOTE), "missing": F.lit(None).cast("string")})
    scores = all_scores(spark, d).persist()  # a row a case and arm, read by every table
    return report.document(scores, failed, "screening", DIGEST, cases(spark, d).count(), blockers)


def key_cases(spark, d) -> DataFrame:
    """A key for each hundred patients in a row."""
    rows = cases(spark, d).select(F.expr("patient_id div 100").alias("key_id"), F.col("case_id").alias("id"), "nct_id", "expected", F.expr("""if(patient_id % 37 = 0, null, 'read "twice"')""").alias("rationale"), (F.col("patient_id") % 3 == 0).alias("constructed"))
    return rows.withColumns({"version": F.lit(1), "notes": F.lit(None).cast("string")})


HEADS = ("version", "notes")


def drift(spark, d) -> DataFrame:
    """Some keys had a label changed since they were frozen, some were never frozen, and some are gone."""
    rows = key_cases(spark, d)
    frozen = key_files.digests(rows.filter("key_id % 5 <> 1"), HEADS)
    now = rows.filter("key_id % 5 <> 2").withColumn("expected", F.when((F.col("key_id") % 3 == 0) & (F.col("id").cast("long") % 100 == 7), "perhaps").otherwise(F.col("expected")))
    return key_files.drift(key_files.digests(now, HEADS), frozen)


QUERIES = {
    "report_document": document,
    "key_digests": lambda s, d: key_files.digests(key_cases(s, d), HEADS),
    "key_drift": drift,
}

_NAMES = ("screening", "always_eligible", "always_ineligible", "always_needs_review", "random")
_PCT = "CAST(round_even({0} * 100, 0) AS BIGINT) || '%'"


def _pct(x: str) -> str:
    return _PCT.format(x)


def _fixed(section: int, lines: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({section}, {i}, '{x}')" for i, x in enumerate(lines)) + ") v(section, place, line)"


def _table(section: int, heads: list[str], rule: str, order: str, cells: list[str], source: str) -> str:
    row = " || ' | ' || ".join(f"coalesce(CAST({c} AS VARCHAR), '—')" for c in cells)
    top = _fixed(section, [f"## {report.TITLES[section]}", f"| {' | '.join(heads)} |", rule])
    return f"{top} UNION ALL SELECT {section}, CAST(row_number() OVER (ORDER BY {order}) + 2 AS INTEGER), '| ' || {row} || ' |' FROM {source}"


_ANSWERED, _RIGHT, _UNSAFE = "decision <> 'needs_review'", "decision = expected", "decision = 'eligible' AND expected <> 'eligible'"
_SUMMED = f"""counts AS (SELECT arm, arm LIKE 'always%' OR arm = 'random' AS last, count(*) AS n, count(*) FILTER ({_RIGHT}) AS k, count(*) FILTER ({_UNSAFE}) AS unsafe, count(*) FILTER ({_ANSWERED}) AS answered, count(*) FILTER (expected <> 'needs_review') AS decidable, count(*) FILTER (expected <> 'needs_review' AND NOT {_ANSWERED}) AS abstained FROM scores GROUP BY arm),
balanced AS (SELECT arm, avg(a) AS balanced FROM (SELECT arm, expected, avg(({_RIGHT})::INT) AS a FROM scores GROUP BY ALL) GROUP BY arm),
steps AS (SELECT arm, k, n, 0.0::DOUBLE AS a1, 1.0::DOUBLE AS b1, 0.0::DOUBLE AS a2, 1.0::DOUBLE AS b2, 0 AS step FROM counts
 UNION ALL SELECT arm, k, n, CASE WHEN up < 0.025 THEN (a1 + b1) / 2 ELSE a1 END, CASE WHEN up < 0.025 THEN b1 ELSE (a1 + b1) / 2 END, CASE WHEN down > 0.025 THEN (a2 + b2) / 2 ELSE a2 END, CASE WHEN down > 0.025 THEN b2 ELSE (a2 + b2) / 2 END, step + 1
 FROM (SELECT *, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((a1 + b1) / 2) + (n - i) * ln(1 - (a1 + b1) / 2)))) AS up,
   list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((a2 + b2) / 2) + (n - i) * ln(1 - (a2 + b2) / 2)))) AS down FROM steps WHERE step < 30)),
bounds AS (SELECT arm, CASE WHEN k = 0 THEN 0 ELSE a1 END AS low, CASE WHEN k = n THEN 1 ELSE a2 END AS high FROM steps WHERE step = 30),
summed AS (SELECT *, coalesce(answered / n, 0) AS coverage FROM counts JOIN balanced USING (arm) JOIN bounds USING (arm)),
own AS (SELECT coverage, forced_decision, k.expected FROM decided JOIN cases k USING (patient_id)),
marks AS (SELECT DISTINCT round(coverage, 6) AS t FROM own UNION SELECT 0),
curve AS (SELECT t, count(*) AS met, count(*) FILTER (forced_decision <> expected) AS wrong, count(*) FILTER (forced_decision = 'eligible' AND expected <> 'eligible') AS unsafe FROM marks JOIN own ON coverage >= t GROUP BY t)"""


def _cells(by: str, cell: str) -> str:
    each = ", ".join(f"any_value(cell) FILTER (arm = '{a}') AS {a}" for a in _NAMES)
    return f"(SELECT {by}, max(n) AS n, {each} FROM (SELECT {by}, arm, count(*) AS n, {cell} AS cell FROM scores GROUP BY ALL) GROUP BY {by})"


_CODES = [f"`{a}`" for a in _NAMES]
_N = f"count(*) FILTER ({_RIGHT}) || '/' || count(*)"
_DOCUMENT = " UNION ALL ".join([
    f"SELECT 0, 0, '# Results' UNION ALL SELECT 0, 1, 'Answer key: **' || count(*) || ' cases**, digest `' || left(sha256('NCT-A'), 16) || '…`.' FROM cases",
    _fixed(1, ["## Headline"]),
    f"SELECT 1, 1, '`screening` decided **' || {_pct('coverage')} || '** of ' || n || ' cases without a reader, with ' || unsafe || CASE unsafe WHEN 1 THEN ' unsafe error.' ELSE ' unsafe errors.' END FROM summed WHERE arm = 'screening'",
    "SELECT 1, 2, 'Half of the intervals of the accuracy are at most ' || CAST(round_even(quantile_cont(high - low, 0.5) * 100, 0) AS BIGINT) || ' percentage points wide.' FROM summed",
    _table(2, list(report.ARM_HEADS), "|---|---:|---:|---:|---|---:|---:|---:|---:|", "last, arm", ["'`' || arm || '`'", "n", _pct("(k / n)"), _pct("balanced"), f"{_pct('low')} || '–' || {_pct('high')}", _pct("coverage"), "unsafe", _pct("(abstained / decidable)"), _pct("(CASE WHEN unsafe > 0 THEN 0 ELSE coverage END)")], "summed"),
    _table(3, list(report.BLOCKER_HEADS), "|---|---|---:|---|---|", "place", ["nct_id", "'`' || criterion_id || '`'", "n || ' of ' || screenings", r"'Age of 18 \| more years'", "NULL"], "blocked"),
    "SELECT 3, CAST(count(*) + 3 AS INTEGER), max(others) || ' more criteria blocked fewer screenings.' FROM blocked HAVING max(others) > 0",
    _table(4, ["Key expects", "Cases", *_CODES], "|---|" + "---:|" * 6, "expected", ["'`' || expected || '`'", "n", *_NAMES], _cells("expected", _N)),
    _table(6, list(report.CURVE_HEADS), "|" + "---:|" * 5, "t", ["printf('%.2f', round_even(t, 2))", _pct("(met / (SELECT count(*) FROM own))"), _pct("(wrong / met)"), "unsafe", "met"], "curve"),
    _table(7, ["Trap", *_CODES], "|" + "---|" * 6, "trap", ["'`' || trap || '`'", *_NAMES], _cells("trap", f"{_N} || ' correct, ' || count(*) FILTER ({_UNSAFE}) || ' unsafe'")),
    _fixed(8, ["## Cases that failed to run"]),
    "SELECT 8, 1, '- `random`: `' || case_id || '` at answer' FROM cases WHERE patient_id % 11 = 0",
])

_JSON = """json AS (SELECT patient_id // 100 AS key_id, patient_id, case_id, expected, '","id":"' || case_id || '","nct_id":"NCT-A","rationale":' || CASE WHEN patient_id % 37 = 0 THEN 'null' ELSE '"read \\"twice\\""' END || '}' AS tail, '{"constructed":' || CASE WHEN patient_id % 3 = 0 THEN 'true' ELSE 'false' END || ',"expected":"' AS head FROM cases)"""


def _digest(expected: str = "expected") -> str:
    return f"""sha256('{{"cases":[' || string_agg(head || {expected} || tail, ',' ORDER BY case_id) || '],"notes":null,"version":1}}')"""


SQL = {
    "report_document": _q(f"SELECT section::INTEGER AS section, place::INTEGER AS place, line FROM ({_DOCUMENT}) v(section, place, line)", *_ALL, f"blocked AS ({catalog.SQL['blockers_top10']})", _SUMMED).replace("WITH patients", "WITH RECURSIVE patients", 1),
    "key_digests": _q(f"SELECT key_id, count(*) AS cases, {_digest()} AS digest FROM json GROUP BY key_id", _CASES, _JSON),
    "key_drift": _q(f"""SELECT key_id, CASE WHEN key_id % 5 = 1 THEN 'not frozen' WHEN key_id % 5 = 2 THEN 'gone' WHEN was = now THEN 'sound' ELSE 'edited' END AS state FROM (
  SELECT key_id, {_digest()} AS was, {_digest("CASE WHEN key_id % 3 = 0 AND patient_id % 100 = 7 THEN 'perhaps' ELSE expected END")} AS now FROM json GROUP BY key_id)""", _CASES, _JSON),
}
