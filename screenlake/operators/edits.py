"""Edits of charts for metamorphic tests: each returns new evidence and must change something."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class NothingToEdit(ValueError):
    """An edit that hits no row tests nothing."""


def _must_hit(evidence: DataFrame, hit: Column, what: str) -> None:
    if not evidence.filter(hit).limit(1).count():
        raise NothingToEdit(what)


def analyte(loinc: str) -> Column:
    return (F.col("kind") == "observation") & (F.col("system") == "LOINC") & (F.col("code") == loinc)


def redact_analyte(evidence: DataFrame, loinc: str, check: bool = True) -> DataFrame:
    """Without all results of a code."""
    if check:
        _must_hit(evidence, analyte(loinc), f"no result of {loinc}")
    return evidence.filter(~F.coalesce(analyte(loinc), F.lit(False)))


def shift_value(evidence: DataFrame, loinc: str, to: float, check: bool = True) -> DataFrame:
    """The latest result of a code gets another value, for each patient."""
    if check:
        _must_hit(evidence, analyte(loinc), f"no result of {loinc}")
    order = Window.partitionBy("patient_id", analyte(loinc)).orderBy(F.col("date").desc_nulls_last(), "seq")
    ranked = evidence.withColumn("__rank", F.row_number().over(order))
    return ranked.withColumn("value", F.when(analyte(loinc) & (F.col("__rank") == 1), F.lit(float(to))).otherwise(F.col("value"))).drop("__rank")


def convert_units(evidence: DataFrame, loinc: str, to_unit: str, factor: float, check: bool = True) -> DataFrame:
    """All numeric results of a code in another unit."""
    hit = analyte(loinc) & F.col("value").isNotNull()
    if check:
        _must_hit(evidence, hit, f"no numeric result of {loinc}")
    return evidence.withColumns({"value": F.when(hit, F.col("value") * factor).otherwise(F.col("value")), "unit": F.when(hit, F.lit(to_unit)).otherwise(F.col("unit"))})


def shift_date(evidence: DataFrame, seq: str, to: date, check: bool = True) -> DataFrame:
    """All rows of one record on another day."""
    hit = F.col("seq") == seq
    if check:
        _must_hit(evidence, hit, f"no record {seq}")
    return evidence.withColumn("date", F.when(hit, F.lit(to)).otherwise(F.col("date")))


def remove_encounters(evidence: DataFrame, after: date, check: bool = True) -> DataFrame:
    """Without visits after a day; undated ones stay."""
    hit = (F.col("kind") == "encounter") & (F.col("date") > F.lit(after))
    if check:
        _must_hit(evidence, hit, f"no visit after {after}")
    return evidence.filter(~F.coalesce(hit, F.lit(False)))


def add_condition(evidence: DataFrame, patient_id: int, system: str, code: str, display: str, onset: date) -> DataFrame:
    """With one more condition, which must not be there yet."""
    there = (F.col("patient_id") == patient_id) & (F.col("kind") == "condition") & (F.col("system") == system) & (F.col("code") == code)
    if evidence.filter(there).limit(1).count():
        raise NothingToEdit(f"{code} is on the chart already")
    row = evidence.sparkSession.range(1).select(
        *[F.lit({"patient_id": patient_id, "kind": "condition", "system": system, "code": code, "display": display, "date": onset, "seq": f"added-{code}"}.get(f.name)).cast(f.dataType).alias(f.name) for f in evidence.schema]
    )
    return evidence.unionByName(row)


def add_observation(evidence: DataFrame, patient_id: int, loinc: str, display: str, value: float, unit: str, when: date) -> DataFrame:
    """With one more result, which is the latest of its code or tests nothing."""
    later = analyte(loinc) & (F.col("patient_id") == patient_id) & (F.col("date") >= F.lit(when))
    if evidence.filter(later).limit(1).count():
        raise NothingToEdit(f"{loinc} has a result as late already")
    given = {"patient_id": patient_id, "kind": "observation", "system": "LOINC", "code": loinc, "display": display, "value": float(value), "unit": unit, "date": when, "seq": f"added-{loinc}-{when}"}
    row = evidence.sparkSession.range(1).select(*[F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in evidence.schema])
    return evidence.unionByName(row)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """seq, side (before or after) and the columns of the rows that an edit took away or brought, which is what a key publishes of it."""
    columns = [c for c in before.columns if c in after.columns]
    # both sides meet in one aggregation: how often more a row is there before than after
    both = before.select(*columns, F.lit(1).alias("__n")).unionByName(after.select(*columns, F.lit(-1).alias("__n")))
    off = both.groupBy(*columns).agg(F.sum("__n").alias("__n")).filter("__n <> 0")
    off = off.withColumn("side", F.when(F.col("__n") > 0, "before").otherwise("after"))
    return off.select(*columns, "side", F.explode(F.sequence(F.lit(1), F.abs("__n"))).alias("__i")).drop("__i")


def removal(evidence: DataFrame, hit: Column, check: bool = True) -> DataFrame:
    """changes() of an edit that takes away the rows of a predicate: those rows, as equal rows all leave together, so no sides are compared and nothing is shuffled."""
    if check:
        _must_hit(evidence, hit, "no row to take away")
    return evidence.filter(hit).withColumn("side", F.lit("before"))


def record_death(patients: DataFrame, patient_id: int, on: date) -> DataFrame:
    return patients.withColumn("deceased", F.when(F.col("patient_id") == patient_id, F.lit(on)).otherwise(F.col("deceased")))
