"""FHIR R4 bundles to patients and evidence.

A bundle is one JSON string, one person's chart. Each entry becomes a row with
its resource still as JSON; only the five kinds that are evidence are parsed, by
their own schema, so a field of another shape costs that field and not the row.
Medication references are resolved by a map in the bundle's own row, so the whole
flattening is one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.functions.dates import written_date

# Code systems by address, statuses that withdraw a diagnosis, and labels.
SYSTEMS = {
    "http://loinc.org": "LOINC",
    "http://snomed.info/sct": "SNOMED",
    "http://www.nlm.nih.gov/research/umls/rxnorm": "RxNorm",
    "http://unitsofmeasure.org": "UCUM",
}
ICD10 = "http://hl7.org/fhir/sid/icd-10"
RETRACTED = ("refuted", "entered-in-error")
NO_MEDICATION_CODE = "medication with no recorded code"
UNRESOLVED_MEDICATION = "unresolved medication reference"

CODING = "array<struct<system:string,code:string,display:string>>"
CONCEPT = f"struct<text:string,coding:{CODING}>"
QUANTITY = "struct<value:string,unit:string,code:string>"
RESOURCE = f"""id string, code {CONCEPT}, effectiveDateTime string, issued string, valueQuantity {QUANTITY},
component array<struct<code:{CONCEPT},valueQuantity:{QUANTITY}>>, clinicalStatus {CONCEPT}, verificationStatus {CONCEPT},
onsetDateTime string, recordedDate string, medicationCodeableConcept {CONCEPT}, medicationReference struct<reference:string,display:string>,
authoredOn string, performedDateTime string, performedPeriod struct<start:string>, type array<{CONCEPT}>, class struct<code:string>, period struct<start:string>"""
KINDS = {"Observation": "observation", "Condition": "condition", "MedicationRequest": "medication", "Procedure": "procedure", "Encounter": "encounter"}


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """bundle: one JSON file each, found by path or glob."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "bundle")


def _text(x: Column) -> Column:
    """Trimmed, null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def system_name(uri: Column) -> Column:
    """The short name of a known code system; others are null and never renamed to a near one."""
    plain = F.rtrim(F.trim(uri), F.lit("/"))
    names = F.create_map(*[F.lit(x) for pair in SYSTEMS.items() for x in pair])
    return F.when(plain.startswith(ICD10), "ICD10").otherwise(F.try_element_at(names, plain))


def codes(concept: Column) -> Column:
    """Codes of known systems, in order."""
    found = F.transform(concept["coding"], lambda c: F.named_struct(F.lit("system"), system_name(c["system"]), F.lit("code"), _text(c["code"])))
    return F.coalesce(F.filter(found, lambda c: c["system"].isNotNull() & c["code"].isNotNull()), F.array().cast("array<struct<system:string,code:string>>"))


def label(concept: Column, fallback: Column) -> Column:
    """The text of a concept, else its first display or code."""
    first = F.filter(F.transform(concept["coding"], lambda c: F.coalesce(_text(c["display"]), _text(c["code"]))), lambda x: x.isNotNull())
    return F.coalesce(_text(concept["text"]), F.try_element_at(first, F.lit(1)), fallback)


def status(concept: Column) -> Column:
    return F.lower(F.try_element_at(F.filter(F.transform(concept["coding"], lambda c: _text(c["code"])), lambda x: x.isNotNull()), F.lit(1)))


def _name(e: Column) -> Column:
    """The id of an entry, else its place."""
    return F.coalesce(_text(e["id"]), F.concat(F.lit("entry-"), e["position"]))


def _charts(bundles: DataFrame) -> DataFrame:
    """patient_id, n_patients, people and entries (position, full_url, type, id, resource as JSON) with a resource: one row for each bundle."""
    parsed = F.from_json("bundle", "entry array<struct<fullUrl:string,resource:string>>")["entry"]
    typed = F.transform(parsed, lambda e, i: F.named_struct(F.lit("position"), i, F.lit("full_url"), e["fullUrl"], F.lit("type"), F.get_json_object(e["resource"], "$.resourceType"), F.lit("id"), F.get_json_object(e["resource"], "$.id"), F.lit("resource"), e["resource"]))
    rows = bundles.select(F.filter(typed, lambda e: F.coalesce(e["type"] != "", F.lit(False))).alias("entries"))
    rows = rows.withColumn("people", F.filter("entries", lambda e: e["type"] == "Patient"))
    return rows.select("*", F.try_element_at(F.transform("people", _name), F.lit(1)).alias("patient_id"), F.size("people").alias("n_patients"))


def entries(bundles: DataFrame) -> DataFrame:
    """patient_id, n_patients, position, type, id, resource (JSON), medication (JSON of the one that an order refers to) of every entry with a resource."""
    drugs = F.filter("entries", lambda e: e["type"] == "Medication")
    # the first resource under a key wins
    keyed = F.flatten(F.transform(drugs, lambda e: F.filter(F.transform(F.array(e["full_url"], F.concat(F.lit("Medication/"), _name(e)), _name(e)), lambda k: F.named_struct(F.lit("k"), k, F.lit("at"), e["position"], F.lit("v"), e["resource"])), lambda x: F.coalesce(x["k"] != "", F.lit(False)))))
    rows = _charts(bundles).withColumn("keyed", F.array_sort(keyed))
    once = F.filter("keyed", lambda x, i: (i == 0) | (F.get("keyed", i - 1)["k"] != x["k"]))
    rows = rows.withColumn("drugs", F.map_from_entries(F.transform(once, lambda x: F.struct(x["k"], x["v"]))))
    rows = rows.select("patient_id", "n_patients", F.explode(F.transform("entries", lambda e: F.struct(e.alias("e"), F.when(e["type"] == "MedicationRequest", F.try_element_at("drugs", F.get_json_object(e["resource"], "$.medicationReference.reference"))).alias("medication")))).alias("x"))
    return rows.select("patient_id", "n_patients", "x.e.position", "x.e.type", _name(F.col("x.e")).alias("id"), "x.e.resource", "x.medication")


def _checked(rows: DataFrame) -> DataFrame:
    """A bundle is one chart; none or several patients fail the job."""
    wrong = F.raise_error(F.concat(F.lit("a bundle with "), F.col("n_patients"), F.lit(" patients"))).cast("string")
    return rows.withColumn("patient_id", F.when(F.col("n_patients") == 1, F.col("patient_id")).otherwise(wrong))


def patients(bundles: DataFrame) -> DataFrame:
    """patient_id, birth_date, sex, deceased, deceased_undated: one row for each bundle."""
    rows = _checked(entries(bundles)).filter("type = 'Patient'")
    x = lambda path: F.get_json_object("resource", f"$.{path}")
    died = written_date(x("deceasedDateTime"))
    return rows.select("patient_id", written_date(x("birthDate")).alias("birth_date"), _text(x("gender")).alias("sex"), died.alias("deceased"), (died.isNull() & F.coalesce(x("deceasedBoolean") == "true", F.lit(False))).alias("deceased_undated"))


def evidence(bundles: DataFrame) -> DataFrame:
    """patient_id, kind, system, code, display, value, unit, date, seq, source: one row for each fact and code, null code if it has none.

    seq keeps the order of the bundle: entry, then component.
    """
    rows = _checked(entries(bundles)).filter(F.col("type").isin(list(KINDS)))
    rows = rows.withColumn("r", F.from_json("resource", RESOURCE))
    r, none = F.col("r"), F.lit("")
    first_date = lambda *xs: F.coalesce(*[written_date(x) for x in xs])

    def fact(display: Column, found: Column, when: Column, quantity: Column | None = None) -> Column:
        value = F.lit(None).cast("double") if quantity is None else quantity["value"].try_cast("double")
        unit = F.lit(None).cast("string") if quantity is None else F.coalesce(_text(quantity["unit"]), _text(quantity["code"]))
        return F.named_struct(F.lit("display"), display, F.lit("codes"), found, F.lit("value"), value, F.lit("unit"), unit, F.lit("date"), when)

    seen = first_date(r["effectiveDateTime"], r["issued"])
    own = F.array(fact(label(r["code"], none), codes(r["code"]), seen, r["valueQuantity"]))
    parts = F.transform(F.filter(F.coalesce(r["component"], F.array().cast(f"array<struct<code:{CONCEPT},valueQuantity:{QUANTITY}>>")), lambda c: c.isNotNull()), lambda c: fact(label(c["code"], none), codes(c["code"]), seen, c["valueQuantity"]))
    # a panel without a value of its own must not come before its components
    alone = F.get_json_object("resource", "$.valueQuantity").isNull() & (F.size(parts) > 0)
    observation = F.when(alone, parts).otherwise(F.concat(own, parts))

    statuses = F.array_compact(F.array(status(r["clinicalStatus"]), status(r["verificationStatus"])))
    named = label(r["code"], none)
    condition = F.array(fact(F.when(F.size(statuses) > 0, F.concat(named, F.lit(" ("), F.array_join(statuses, ", "), F.lit(")"))).otherwise(named), codes(r["code"]), first_date(r["onsetDateTime"], r["recordedDate"])))

    inline = F.get_json_object("resource", "$.medicationCodeableConcept").isNotNull()
    reference = F.nullif(r["medicationReference"]["reference"], F.lit(""))
    referred = F.from_json("medication", f"code {CONCEPT}")["code"]
    concept = F.when(inline, r["medicationCodeableConcept"]).otherwise(referred)
    missing = F.when(~inline & reference.isNotNull() & F.col("medication").isNull(), F.coalesce(_text(r["medicationReference"]["display"]), F.concat(F.lit(f"{UNRESOLVED_MEDICATION} "), reference))).otherwise(F.lit(NO_MEDICATION_CODE))
    medication = F.array(fact(label(concept, missing), codes(concept), written_date(r["authoredOn"])))

    procedure = F.array(fact(named, codes(r["code"]), first_date(r["performedDateTime"], r["performedPeriod"]["start"])))
    labels = F.filter(F.transform(r["type"], lambda t: label(t, none)), lambda x: x != "")
    visit = F.coalesce(F.try_element_at(labels, F.lit(1)), _text(r["class"]["code"]), F.lit("encounter"))
    of_types = F.coalesce(F.flatten(F.transform(r["type"], codes)), F.array().cast("array<struct<system:string,code:string>>"))
    encounter = F.array(fact(visit, of_types, written_date(r["period"]["start"])))

    facts = F.when(F.col("type") == "Observation", observation).when(F.col("type") == "Condition", condition).when(F.col("type") == "MedicationRequest", medication).when(F.col("type") == "Procedure", procedure).otherwise(encounter)
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    withdrawn = (F.col("type") == "Condition") & F.coalesce(status(r["verificationStatus"]).isin(*RETRACTED), F.lit(False))
    rows = rows.filter(~withdrawn).select("patient_id", kinds[F.col("type")].alias("kind"), F.col("type").alias("resource_type"), F.col("id").alias("resource_id"), F.format_string("Bundle.entry[%d].resource", "position").alias("fhir_path"), "position", F.posexplode(facts).alias("part", "f"))
    seq = F.concat_ws("-", F.lpad(F.col("position").cast("string"), 8, "0"), F.lpad(F.col("part").cast("string"), 4, "0"))
    record = ["resource_type", "resource_id", "fhir_path"]
    rows = rows.select("patient_id", "kind", F.explode_outer("f.codes").alias("c"), "f.display", "f.value", "f.unit", "f.date", seq.alias("seq"), F.lit("structured").alias("source"), *record)
    return rows.select("patient_id", "kind", "c.system", "c.code", "display", "value", "unit", "date", "seq", "source", *record)


def embedded_notes(bundles: DataFrame) -> DataFrame:
    """patient_id, resource_id, fhir_path, date, text: the text attachments of a bundle's documents, which are no evidence by themselves.

    Attachments that are not text, not strict base64 or not UTF-8 are left out; a document without any gives no row.
    """
    rows = _checked(entries(bundles)).filter("type = 'DocumentReference'")
    rows = rows.withColumn("r", F.from_json("resource", "date string, content array<struct<attachment:struct<contentType:string,data:string>>>"))
    raw = F.transform("r.content", lambda c: F.when(F.coalesce(F.ltrim(c["attachment"]["contentType"]).startswith("text/"), F.lit(True)), F.try_to_binary(c["attachment"]["data"], F.lit("base64"))))
    texts = F.transform(F.filter(raw, lambda b: b.isNotNull()), lambda b: F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")))
    told = F.array_join(F.filter(texts, lambda t: F.coalesce(t != "", F.lit(False))), "\n\n")
    out = rows.select("patient_id", F.col("id").alias("resource_id"), F.format_string("Bundle.entry[%d].resource", "position").alias("fhir_path"), written_date(F.col("r.date")).alias("date"), told.alias("text"))
    return out.filter("text <> ''")


def dropped_types(bundles: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """type, n of the entries that trimming to some resource types leaves out."""
    parsed = F.from_json("bundle", "entry array<struct<resource:string>>")["entry"]
    types = bundles.select(F.explode(parsed).alias("e")).select(F.coalesce(F.get_json_object("e.resource", "$.resourceType"), F.lit("<unknown>")).alias("type"))
    return types.filter(~F.col("type").isin(*allowed)).groupBy("type").agg(F.count("*").alias("n"))


def trimmed(bundles: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """bundle with the entries of some resource types only, as they were."""
    parsed = F.from_json("bundle", "entry array<string>")["entry"]
    kept = F.filter(parsed, lambda e: F.coalesce(F.get_json_object(e, "$.resource.resourceType").isin(*allowed), F.lit(False)))
    return bundles.withColumn("bundle", F.concat(F.lit('{"resourceType":"Bundle","entry":['), F.array_join(kept, ","), F.lit("]}")))


def summaries(bundles: DataFrame) -> DataFrame:
    """One row a patient of bundles with one patient: patient_id, birth_date, deceased, sex, condition names and codes, result codes, visits with first and last day, span_years, n_entries, n_bytes.

    A chart is summed up in its own row, so that one row a bundle is shuffled.
    """
    fields = f"code {CONCEPT}, component array<struct<code:{CONCEPT}>>, period struct<start:string,end:string>, birthDate string, gender string, deceasedDateTime string"
    read = F.transform("entries", lambda e: F.struct(e["type"].alias("type"), F.octet_length(e["resource"]).cast("long").alias("n"), F.from_json(e["resource"], fields).alias("r")))
    rows = _charts(bundles).select("patient_id", "n_patients", read.alias("read"))
    coded = lambda c: F.coalesce(c["coding"], F.array().cast(CODING))
    of = lambda kind, values: F.transform(F.filter("read", lambda x: x["type"] == kind), lambda x: values(x["r"]))
    names = lambda r: F.concat(F.transform(coded(r["code"]), lambda x: _text(x["display"])), F.array(_text(r["code"]["text"])))
    own = lambda r: F.transform(coded(r["code"]), lambda x: _text(x["code"]))
    parts = lambda r: F.flatten(F.transform(F.coalesce(r["component"], F.array().cast(f"array<struct<code:{CONCEPT}>>")), lambda c: coded(c["code"])))
    loinc = lambda r: F.transform(F.filter(F.concat(coded(r["code"]), parts(r)), lambda x: x["system"] == "http://loinc.org"), lambda x: _text(x["code"]))
    distinct = lambda lists: F.array_distinct(F.array_compact(F.flatten(lists)))
    day = lambda r: F.substring(F.coalesce(r["period"]["end"], r["period"]["start"]), 1, 10)
    own_value = lambda field: F.array_max(of("Patient", lambda r: r[field]))
    days = of("Encounter", day)
    chart = F.struct(
        "patient_id", own_value("birthDate").alias("birth_date"), own_value("deceasedDateTime").alias("deceased"), own_value("gender").alias("sex"),
        distinct(of("Condition", names)).alias("condition_names"), distinct(of("Condition", own)).alias("condition_codes"), distinct(of("Observation", loinc)).alias("result_codes"),
        F.size(days).alias("visits"), F.array_min(days).alias("first_visit"), F.array_max(days).alias("last_visit"),
        F.size("read").alias("n_entries"), F.aggregate("read", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n_bytes"),
    )
    # as a list of one or none, since a filter would parse every bundle once more
    charts = rows.select(F.inline(F.when(F.col("n_patients") == 1, F.array(chart))))
    sets = lambda c: F.array_sort(distinct(F.collect_list(c))).alias(c)
    total = lambda c: F.sum(c).alias(c)
    out = charts.groupBy("patient_id").agg(
        F.max("birth_date").alias("birth_date"), F.substring(F.max("deceased"), 1, 10).alias("deceased"), F.max("sex").alias("sex"),
        sets("condition_names"), sets("condition_codes"), sets("result_codes"),
        total("visits"), F.min("first_visit").alias("first_visit"), F.max("last_visit").alias("last_visit"), total("n_entries"), total("n_bytes"),
    )
    return out.withColumn("span_years", F.coalesce(F.substring("last_visit", 1, 4).cast("int") - F.substring("first_visit", 1, 4).cast("int"), F.lit(0)))
