"""Queries on what rationales may say and on the gate of drafts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.operators import rationale
from screenlake.plans.catalog import _BASE, AS_OF, SECOND, patients, tables
from screenlake.plans.packets import PACKET_SQL, THIRD, answered

FIRST = ("On 1998-05-20 the value was  5 against 45, code 2345-7.", "The bound is 18 or 85 within 9 months.", "No number is given.")
REDRAFT = ("It was 2 within 18 months.", "The chart settles it.")


def entitled(spark, d) -> DataFrame:
    return rationale.entitled(*tables(spark, d), [THIRD, SECOND], AS_OF, settlements=answered(spark, d))


def drafts(spark, d) -> DataFrame:
    """Sentences that a writer proposes for every criterion, by the patient's number: none, one or two."""
    criteria = F.explode(F.array(*[F.struct(F.lit(p.nct_id).alias("nct_id"), F.lit(c.id).alias("criterion_id")) for p in (THIRD, SECOND) for c in p.criteria]))
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("patient_id") % n + 1).cast("int"))
    both = F.array(F.struct(F.lit(1).alias("draft"), pick(FIRST, 3).alias("sentence")), F.struct(F.lit(2).alias("draft"), F.when(F.col("patient_id") % 4 != 0, pick(REDRAFT, 2)).alias("sentence"))).cast("array<struct<draft:int,sentence:string>>")
    rows = patients(spark, d).filter("patient_id % 5 <> 0").select("patient_id", criteria.alias("c"), F.explode(both).alias("x"))
    return rows.select("c.nct_id", "patient_id", "c.criterion_id", "x.draft", "x.sentence")


def gated(spark, d) -> DataFrame:
    return rationale.written(entitled(spark, d), drafts(spark, d))


QUERIES = {
    "rationale_entitlements": lambda s, d: entitled(s, d).select(
        *rationale.KEY, F.array_join(F.array_sort("dates"), " ").alias("dates"), F.array_join("codes", " ").alias("codes"), F.size("numbers").alias("n_numbers"),
        F.round(F.aggregate("numbers", F.lit(0.0), lambda t, x: t + x), 4).alias("sum_numbers"),
    ),
    "rationale_gate": lambda s, d: gated(s, d).select(
        *rationale.KEY, "sentence", "source", F.array_join("rejected", "|").alias("rejected"), F.array_join(F.transform("violations", lambda v: v["message"]), "|").alias("violations"), "fallback_reason",
    ),
}

_DAY = r"\b\d{4}-\d{2}-\d{2}\b"


def _days(s: str) -> str:
    return f"regexp_extract_all({s}, '{_DAY}')"


def _numbers(s: str) -> str:
    return rf"regexp_extract_all({s}, '(^|[^\d.])(-?\d+(?:\.\d+)?)', 2)"


def _doubles(s: str) -> str:
    """Numbers of a rationale or a quote: its codes go first, then its days."""
    found = _numbers(f"regexp_replace(replace({s}, code, ' '), '{_DAY}', ' ', 'g')")
    return f"list_transform({found}, lambda x: CAST(x AS DOUBLE))"


ENTITLED_SQL = f"""{_BASE}, {PACKET_SQL}, rules(key, own, code) AS (VALUES ('NCT-C INC-01', CAST([] AS DOUBLE[]), 'no code'), ('NCT-C INC-02', [5.0, 18.0], '2345-7'), ('NCT-C INC-03', [], 'no code'), ('NCT-C EXC-01', [], 'no code'), ('NCT-C EXC-02', [9.0], '5-LOW'),
  ('NCT-B INC-01', [85.0], 'no code'), ('NCT-B INC-02', [5.0, 18.0], '2345-7'), ('NCT-B EXC-01', [9.0], '5-LOW'), ('NCT-B EXC-02', [], 'no code'), ('NCT-B EXC-03', [], 'no code')),
resting AS (SELECT nct_id, patient_id, criterion_id, rationale, quote, own, code,
  CASE WHEN answered_by IS NOT NULL THEN NULL WHEN key = 'NCT-C INC-01' AND (v1 IS DISTINCT FROM false OR c = false) THEN cr_value WHEN key LIKE '%INC-02' THEN gl_value END AS value, CASE WHEN answered_by IS NULL AND key LIKE '%INC-02' THEN g END AS converted,
  CASE WHEN answered_by IS NOT NULL THEN NULL WHEN key = 'NCT-C INC-01' AND (v1 IS DISTINCT FROM false OR c = false) THEN cr_date WHEN key LIKE '%INC-02' THEN gl_date
    WHEN key = 'NCT-C EXC-01' AND (v4 IS DISTINCT FROM true OR u) THEN ur_date WHEN key IN ('NCT-C EXC-02', 'NCT-B EXC-01') THEN lo_date END AS day
  FROM prows JOIN (SELECT patient_id, v1, v4, a, c, u, cr_value, cr_date, gl_value, gl_date, g, ur_date, lo_date FROM settled) USING (patient_id) JOIN rules ON key = nct_id || ' ' || criterion_id),
entitled AS (SELECT *, coalesce(CAST(day AS VARCHAR), '') AS dates, list_distinct(list_filter(list_concat(own, [value, converted], {_doubles('rationale')}, {_doubles('quote')}), lambda x: x IS NOT NULL)) AS numbers FROM resting)"""


def _pick(words: tuple[str, ...]) -> str:
    return f"(CASE patient_id % {len(words)} " + " ".join(f"WHEN {i} THEN '{' '.join(w.split())}'" for i, w in enumerate(words)) + " END)"


def _bad(s: str) -> str:
    """Messages of a sentence's violations."""
    said = _numbers(f"replace(regexp_replace({s}, '{_DAY}', ' ', 'g'), code, ' ')")
    loose = f"list_filter({said}, lambda x: len(list_filter(numbers, lambda n: abs(n - CAST(x AS DOUBLE)) < 1e-9)) = 0)"
    return (
        f"list_concat(list_transform(list_filter({_days(s)}, lambda x: x <> dates), lambda x: x || ' does not appear in the evidence for ' || criterion_id), "
        f"list_transform({loose}, lambda x: x || ' is not a value ' || criterion_id || ' resolved from'))"
    )


SQL = {
    "rationale_entitlements": f"{ENTITLED_SQL}\nSELECT nct_id, patient_id, criterion_id, dates, CASE WHEN code = 'no code' THEN '' ELSE code END AS codes, CAST(len(numbers) AS INTEGER) AS n_numbers, round(coalesce(list_sum(numbers), 0), 4) AS sum_numbers FROM entitled",
    "rationale_gate": f"""{ENTITLED_SQL}, drafted AS (SELECT *, CASE WHEN patient_id % 5 <> 0 THEN {_pick(FIRST)} END AS d1, CASE WHEN patient_id % 5 <> 0 AND patient_id % 4 <> 0 THEN {_pick(REDRAFT)} END AS d2 FROM entitled),
judged AS (SELECT *, {_bad('d1')} AS b1, {_bad('d2')} AS b2 FROM drafted),
told AS (SELECT *, d1 IS NOT NULL AND len(b1) = 0 AS ok1, d1 IS NOT NULL AND len(b1) > 0 AND d2 IS NOT NULL AND len(b2) = 0 AS ok2 FROM judged)
SELECT nct_id, patient_id, criterion_id, CASE WHEN ok1 THEN d1 WHEN ok2 THEN d2 ELSE rationale END AS sentence, CASE WHEN ok1 OR ok2 THEN 'model' ELSE 'fallback' END AS source,
 CASE WHEN d1 IS NULL OR ok1 THEN '' WHEN d2 IS NULL OR ok2 THEN d1 ELSE d1 || '|' || d2 END AS rejected,
 CASE WHEN d1 IS NULL OR ok1 THEN '' WHEN d2 IS NULL OR ok2 THEN array_to_string(b1, '|') ELSE array_to_string(list_concat(b1, b2), '|') END AS violations,
 CASE WHEN ok1 OR ok2 THEN NULL WHEN d1 IS NULL THEN 'no model was consulted' WHEN d2 IS NULL THEN 'no second draft was recorded' ELSE 'the redraft still carried values the record does not support' END AS fallback_reason FROM told""",
}
