"""A second reading of raw bundles, which shares nothing with the first one.

Keys are checked against it, so that a fault of the reader under test can't hide
in the check. It walks paths of VARIANT values: one fact for each coded result
(a panel's components are results too), condition, order, procedure and visit,
with the value only if it is a number and the unit only as it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.sources import fhir

FACT = ("patient_id", "kind", "system", "code", "value", "unit", "date")
_CODINGS = "array<struct<system:string,code:string>>"
#: Where each kind of resource has its day, the first that is there.
_DAYS = {
    "Observation": ("effectiveDateTime", "issued"), "Condition": ("onsetDateTime", "recordedDate"), "MedicationRequest": ("authoredOn",),
    "Procedure": ("performedDateTime", "performedPeriod.start"), "Encounter": ("period.start",),
}
_KIND = {"Observation": "observation", "Condition": "condition", "MedicationRequest": "medication", "Procedure": "procedure", "Encounter": "encounter"}


def _at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _system(x: Column) -> Column:
    """The short name of a code system, by what its address speaks of."""
    named = F.when(F.contains(F.lower(x), F.lit("loinc")), "LOINC").when(F.contains(F.lower(x), F.lit("snomed")), "SNOMED").when(F.contains(F.lower(x), F.lit("rxnorm")), "RxNorm")
    return F.coalesce(named, x)


def facts(bundles: DataFrame) -> DataFrame:
    """FACT of every coded fact in bundles(bundle), one row a code. Bundles without a patient, and what isn't JSON, have none."""
    whole = bundles.select(F.try_parse_json("bundle").alias("b"))
    resources = F.transform(_at(F.col("b"), "entry", "array<variant>"), lambda e: _at(e, "resource", "variant"))
    rows = whole.select(resources.alias("all"))
    is_patient = lambda r: F.coalesce(_at(r, "resourceType", "string") == "Patient", F.lit(False))
    rows = rows.select(F.try_element_at(F.transform(F.filter("all", is_patient), lambda r: _at(r, "id", "string")), F.lit(1)).alias("patient_id"), F.explode("all").alias("r"))
    r, kind = F.col("r"), _at(F.col("r"), "resourceType", "string")
    rows = rows.filter(F.col("patient_id").isNotNull() & kind.isin(list(_KIND)))

    part = lambda concept, quantity: F.struct(_at(concept, "coding", _CODINGS).alias("codings"), quantity.alias("quantity"))
    none = F.lit(None).cast("variant")
    components = F.transform(F.coalesce(_at(r, "component", "array<variant>"), F.array().cast("array<variant>")), lambda c: part(_at(c, "code", "variant"), _at(c, "valueQuantity", "variant")))
    own = lambda path: F.array(part(_at(r, path, "variant"), none))
    results = F.concat(F.array(part(_at(r, "code", "variant"), _at(r, "valueQuantity", "variant"))), components)
    visits = F.transform(F.coalesce(_at(r, "type", "array<variant>"), F.array().cast("array<variant>")), lambda t: part(t, none))
    parts = F.when(kind == "Observation", results).when(kind == "MedicationRequest", own("medicationCodeableConcept")).when(kind == "Encounter", visits).otherwise(own("code"))
    day = F.lit(None).cast("date")
    for k, paths in _DAYS.items():
        written = F.coalesce(*[F.try_to_date(F.regexp_extract(_at(r, p, "string"), r"^\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd") for p in paths])
        day = F.when(kind == k, written).otherwise(day)
    names = F.create_map(*[F.lit(x) for pair in _KIND.items() for x in pair])
    rows = rows.select("patient_id", names[kind].alias("kind"), day.alias("date"), F.explode(parts).alias("p"))
    number = F.when(F.schema_of_variant(_at(F.col("p.quantity"), "value", "variant")).rlike("(?i)^(bigint|double|decimal|float|int)"), _at(F.col("p.quantity"), "value", "double"))
    unit = F.nullif(_at(F.col("p.quantity"), "unit", "string"), F.lit(""))
    return rows.select("patient_id", "kind", "date", number.alias("value"), unit.alias("unit"), F.explode("p.codings").alias("c")).select("patient_id", "kind", _system(F.col("c.system")).alias("system"), "c.code", "value", "unit", "date")


def differences(bundles: DataFrame) -> DataFrame:
    """FACT, n_first, n_second: how often each reader has a fact that not both have as often. Facts without a code are the first reader's alone and left out."""
    side = lambda df, name: df.select(*FACT, F.lit(name).alias("side"))
    both = side(fhir.evidence(bundles).filter("code IS NOT NULL"), "first").unionByName(side(facts(bundles), "second"))
    counted = both.groupBy(*FACT).agg(F.count_if(F.col("side") == "first").alias("n_first"), F.count_if(F.col("side") == "second").alias("n_second"))
    return counted.filter("n_first <> n_second")
