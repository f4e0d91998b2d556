"""Patients and evidence laid over the TPC-H-like tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "1998-06-01"

PATIENTS_SQL = """
SELECT c_custkey AS patient_id,
  CASE WHEN c_custkey % 41 <> 0 THEN {add_days} END AS birth_date,
  CASE WHEN c_nationkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex,
  CASE WHEN c_custkey % 23 = 0 THEN {add_death} END AS deceased,
  c_custkey % 97 = 0 AND c_custkey % 23 <> 0 AS deceased_undated
FROM customer
"""

#: One row for each fact; code is unique by system here, so one code a row is enough.
EVIDENCE_SQL = """
SELECT o_custkey AS patient_id, 'observation' AS kind, 'LOINC' AS system,
  CASE l_returnflag WHEN 'A' THEN '2160-0' WHEN 'N' THEN '4548-4' ELSE '2345-7' END AS code,
  CASE l_returnflag WHEN 'A' THEN 'Creatinine' WHEN 'N' THEN 'Hemoglobin A1c' ELSE 'Glucose' END AS display,
  CASE WHEN l_suppkey <> 13 THEN l_quantity END AS value,
  CASE l_linestatus WHEN 'F' THEN 'mg/dL' ELSE 'umol/L' END AS unit,
  CASE WHEN l_partkey % 37 <> 0 THEN CAST(l_shipdate AS DATE) END AS date,
  concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR(20)), 12, '0'), lpad(CAST(l_linenumber AS VARCHAR(20)), 4, '0'), lpad(CAST(l_partkey AS VARCHAR(20)), 12, '0'), lpad(CAST(l_suppkey AS VARCHAR(20)), 12, '0'), CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20))) AS seq
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL
SELECT o_custkey, 'medication', 'RxNorm', split_part(p_type, ' ', 1), p_type, NULL, NULL, CAST(l_shipdate AS DATE),
  concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR(20)), 12, '0'), lpad(CAST(l_linenumber AS VARCHAR(20)), 4, '0'), lpad(CAST(l_partkey AS VARCHAR(20)), 12, '0'), lpad(CAST(l_suppkey AS VARCHAR(20)), 12, '0'), CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20)))
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
UNION ALL
SELECT o_custkey, 'condition', 'SNOMED', o_orderpriority, o_orderpriority, NULL, NULL, CAST(o_orderdate AS DATE), lpad(CAST(o_orderkey AS VARCHAR(20)), 12, '0')
FROM orders
UNION ALL
SELECT o_custkey, 'encounter', 'SNOMED', 'visit', 'encounter', NULL, NULL, CAST(o_orderdate AS DATE), lpad(CAST(o_orderkey AS VARCHAR(20)), 12, '0')
FROM orders WHERE o_orderstatus <> 'P'
"""

PATIENTS_DUCKDB = PATIENTS_SQL.format(add_days="DATE '1930-01-01' + CAST((c_custkey * 7919) % 25000 AS INTEGER)", add_death="DATE '1998-05-01' + CAST(c_custkey % 60 AS INTEGER)")
PATIENTS_SPARK = PATIENTS_SQL.format(add_days="date_add(DATE '1930-01-01', CAST((c_custkey * 7919) % 25000 AS INT))", add_death="date_add(DATE '1998-05-01', CAST(c_custkey % 60 AS INT))")


def _run(spark: SparkSession, sf_dir: str, sql: str, tables: list[str]) -> DataFrame:
    frames = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in tables}
    return spark.sql(_named(sql, tables), **frames)


def _named(sql: str, tables: list[str]) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", sql)


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, PATIENTS_SPARK, ["customer"])


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, EVIDENCE_SQL, ["lineitem", "orders", "part"])
