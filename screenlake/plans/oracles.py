"""Longer pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

_ITEM = r"^(\s*)(?:[*\-•]|\(?\d+[.)]|[a-z][.)])\s+(\S.*)$"

#: spans (nct_id, index, section, text, char_start, char_end, parent_index) of documents as protocols.
SPANS = rf"""WITH RECURSIVE raws AS (SELECT doc_id AS nct_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
placed AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY nct_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM raws),
named AS (SELECT *, nullif(lower(regexp_extract(t, '(?i)^\s*(?:key\s+)?(inclusion|exclusion)\s+criteri(?:on|a)\b\s*:?\s*$', 1)), '') AS header FROM placed WHERE t <> '' AND NOT contains(lower(t), 'the above information is not intended to contain all considerations relevant to a participant''s potential participation in a clinical trial')),
sectioned AS (SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY nct_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unspecified') AS own FROM named),
items AS (SELECT nct_id, CAST(row_number() OVER (PARTITION BY nct_id ORDER BY line) - 1 AS INTEGER) AS index, own, raw, begins, CASE WHEN regexp_matches(raw, '{_ITEM}') THEN length(regexp_extract(raw, '{_ITEM}', 1)) ELSE 0 END AS indent,
  CASE WHEN regexp_matches(raw, '{_ITEM}') THEN rtrim(regexp_extract(raw, '{_ITEM}', 2), ' ' || chr(9) || chr(13)) ELSE t END AS text FROM sectioned WHERE header IS NULL),
tree AS (SELECT i.*, (SELECT max(j.index) FROM items j WHERE j.nct_id = i.nct_id AND j.index < i.index AND j.indent < i.indent) AS parent_index FROM items i),
roots AS (SELECT nct_id, index, own AS section FROM tree WHERE parent_index IS NULL UNION ALL SELECT t.nct_id, t.index, r.section FROM roots r JOIN tree t ON t.nct_id = r.nct_id AND t.parent_index = r.index),
spans AS (SELECT t.nct_id, t.index, r.section, t.text, CAST(begins + position(t.text IN raw) - 1 AS BIGINT) AS char_start, CAST(begins + position(t.text IN raw) - 1 + length(t.text) AS BIGINT) AS char_end, t.parent_index FROM tree t JOIN roots r ON r.nct_id = t.nct_id AND r.index = t.index)"""

CLAIMS = SPANS + r""", quotes AS (SELECT doc_id AS nct_id, lower(regexp_replace(trim(CASE WHEN doc_id % 5 = 0 THEN 'no such sentence here' ELSE upper(split_part(text, chr(10), 1)) END), '\s+', ' ', 'g')) AS q FROM documents),
keyed AS (SELECT s.*, lower(regexp_replace(trim(text), '\s+', ' ', 'g')) AS key FROM spans s), direct AS (SELECT k.nct_id, k.index, k.parent_index, coalesce(contains(key, q) OR contains(q, key), false) AS hit FROM keyed k LEFT JOIN quotes USING (nct_id)),
up AS (SELECT nct_id, index, parent_index AS above FROM direct WHERE parent_index IS NOT NULL UNION ALL SELECT u.nct_id, u.index, d.parent_index FROM up u JOIN direct d ON d.nct_id = u.nct_id AND d.index = u.above WHERE d.parent_index IS NOT NULL),
inherited AS (SELECT DISTINCT u.nct_id, u.index FROM up u JOIN direct d ON d.nct_id = u.nct_id AND d.index = u.above WHERE d.hit),
claims AS (SELECT d.nct_id, d.index, CASE WHEN hit THEN 'direct' WHEN i.index IS NOT NULL THEN 'inherited' ELSE 'unclaimed' END AS claim FROM direct d LEFT JOIN inherited i ON i.nct_id = d.nct_id AND i.index = d.index)"""

CLOPPER_PEARSON = """WITH RECURSIVE c AS (SELECT quality, count(*) FILTER (toxic = 1) AS k, count(*) AS n FROM labels GROUP BY quality),
b AS (SELECT quality, k, n, 0.0::DOUBLE AS a1, 1.0::DOUBLE AS b1, 0.0::DOUBLE AS a2, 1.0::DOUBLE AS b2, 0 AS step FROM c
 UNION ALL SELECT quality, k, n, CASE WHEN up < 0.025 THEN (a1 + b1) / 2 ELSE a1 END, CASE WHEN up < 0.025 THEN b1 ELSE (a1 + b1) / 2 END,
   CASE WHEN down > 0.025 THEN (a2 + b2) / 2 ELSE a2 END, CASE WHEN down > 0.025 THEN b2 ELSE (a2 + b2) / 2 END, step + 1
 FROM (SELECT *, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((a1 + b1) / 2) + (n - i) * ln(1 - (a1 + b1) / 2)))) AS up,
   list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((a2 + b2) / 2) + (n - i) * ln(1 - (a2 + b2) / 2)))) AS down FROM b) WHERE step < 50)
SELECT quality, k, n, round(CASE WHEN k = 0 THEN 0 ELSE a1 END, 6) AS low, round(CASE WHEN k = n THEN 1 ELSE a2 END, 6) AS high FROM b WHERE step = 50"""

QUOTES = r"""WITH q AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'no such sentence here' ELSE upper(split_part(text, chr(10), 1)) END AS quote FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS nct_id, 'INC-01' AS criterion_id FROM q WHERE NOT contains(lower(regexp_replace(trim(text), '\s+', ' ', 'g')), lower(regexp_replace(trim(quote), '\s+', ' ', 'g')))"""


def second(as_of, latest, within, start) -> str:
    """CTEs of the second protocol, ending in second (patient_id, ord, criterion_id, verdict, blocking, rationale, missing, query, evidence)."""
    age = f"CAST(date_diff('year', p.birth_date, DATE '{as_of}') - CASE WHEN p.birth_date + to_years(CAST(date_diff('year', p.birth_date, DATE '{as_of}') AS INTEGER)) > DATE '{as_of}' THEN 1 ELSE 0 END AS INTEGER)"
    return ", ".join([
        latest("gl", f"kind = 'observation' AND code = '2345-7' AND {within(18, 'months')}"),
        f"lo AS (SELECT patient_id, display, date, seq FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY date DESC NULLS LAST, seq) AS k FROM evidence WHERE kind = 'condition' AND code = '5-LOW' AND {within(9, 'months')}) WHERE k = 1)",
        f"v9 AS (SELECT DISTINCT patient_id FROM evidence WHERE kind = 'encounter' AND {within(9, 'months')})",
        f"""alive2 AS (SELECT p.patient_id, p.sex, {age} AS age, gl.seq AS gl_seq, gl.date AS gl_date, gl.value AS gl_value,
  CASE gl.unit WHEN 'mg/dL' THEN gl.value WHEN 'umol/L' THEN gl.value * 1.0 * 180.16 / 1000.0 / 10.0 END AS g, lo.seq AS lo_seq, lo.date AS lo_date, lo.display AS lo_display, v9.patient_id IS NOT NULL AS covered
 FROM patients p LEFT JOIN gl USING (patient_id) LEFT JOIN lo USING (patient_id) LEFT JOIN v9 USING (patient_id) WHERE NOT coalesce(p.deceased <= DATE '{as_of}', false) AND NOT p.deceased_undated)""",
        f"""second AS (
 SELECT patient_id, 0 AS ord, 'INC-01' AS criterion_id, age <= 85 AS verdict, true AS blocking, CASE WHEN age IS NULL THEN 'no date of birth is recorded, so age cannot be computed' ELSE 'age ' || age || ' years at screening against <= 85.0' END AS rationale,
   CASE WHEN age IS NULL THEN 'the patient''s date of birth' END AS missing, CASE WHEN age IS NULL THEN 'Patient/' || patient_id END AS query, '' AS evidence FROM alive2
 UNION ALL SELECT patient_id, 1, 'INC-02', g >= 5, true,
   CASE WHEN gl_seq IS NULL THEN 'no Glucose result is on file for the required window' WHEN gl_value IS NULL THEN 'the most recent matching result carries no numeric value' ELSE printf('%g', g) || ' mg/dL on ' || gl_date || ' against >= 5.0 mg/dL' END,
   CASE WHEN gl_seq IS NULL THEN 'a Glucose result' WHEN gl_value IS NULL THEN 'a numeric value for Glucose' END,
   CASE WHEN g IS NULL THEN 'Observation?patient=' || patient_id || '&code=2345-7&date=ge{start(as_of, 18, 'months')}' END, coalesce(gl_seq, '') FROM alive2
 UNION ALL SELECT patient_id, 2, 'EXC-01', CASE WHEN lo_seq IS NOT NULL THEN true WHEN covered THEN false END, true,
   CASE WHEN lo_seq IS NOT NULL THEN 'low priority is documented (Condition/' || lo_seq || ': ' || lo_display || ' (' || lo_date || '))' WHEN covered THEN 'low priority is not documented in a window the chart covers'
     ELSE 'nothing documents low priority in the required window, and the chart does not show the window was covered' END,
   CASE WHEN lo_seq IS NULL AND NOT covered THEN 'confirmation that low priority is genuinely absent rather than merely unrecorded' END,
   CASE WHEN lo_seq IS NULL AND NOT covered THEN 'Condition?patient=' || patient_id || '&code=5-LOW&date=ge{start(as_of, 9, 'months')}' END, coalesce(lo_seq, '') FROM alive2
 UNION ALL SELECT patient_id, 3, 'EXC-02', CAST(NULL AS BOOLEAN), true, 'this criterion was not formalised because it cannot be decided from data', 'human judgement: the investigator''s view', '', '' FROM alive2
 UNION ALL SELECT patient_id, 4, 'EXC-03', sex <> 'female', true, 'recorded sex ''' || sex || ''' against != ''Female''', NULL, NULL, '' FROM alive2)""",
    ])
