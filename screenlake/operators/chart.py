"""Chart summaries: conditions by status, medications, results and their trends, visits, notes.

Evidence has a row for each record and code; ``facts`` makes one row of each
record, and everything else is a window or an aggregation by patient over the
same partitioning, so evidence is shuffled once. Records after the screening
date are left out and counted.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.functions.dates import age_years
from screenlake.functions.text import folded, short_number
from screenlake.functions.units import normal_unit

# The statuses that a condition's name may end with.
CLINICAL = ("active", "recurrence", "relapse", "inactive", "remission", "resolved")
VERIFICATION = ("unconfirmed", "provisional", "differential", "confirmed", "refuted", "entered-in-error")
CLOSED = ("inactive", "remission", "resolved")
TYPES = {"observation": "Observation", "condition": "Condition", "medication": "MedicationRequest", "procedure": "Procedure", "encounter": "Encounter", "note": "Note"}


def facts(evidence: DataFrame) -> DataFrame:
    """patient_id, seq, kind, display, value, unit, date, loinc, rxnorm, code: one row for each record, whatever number of codes it has."""
    code = lambda system: F.min(F.when(F.col("system") == system, F.col("code")))
    first = [F.min(c).alias(c) for c in ("display", "value", "unit", "date")]
    return evidence.repartition("patient_id").groupBy("patient_id", "kind", "seq").agg(*first, code("LOINC").alias("loinc"), code("RxNorm").alias("rxnorm"), F.min("code").alias("code"))


def known(rows: DataFrame, as_of: date | None) -> DataFrame:
    """Without what is dated after the screening."""
    return rows if as_of is None else rows.filter(F.col("date").isNull() | (F.col("date") <= F.lit(as_of)))


def label() -> Column:
    """What to call a record; one without a name says so."""
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.nullif(F.trim("display"), F.lit("")), F.concat(F.lit("(unlabelled "), kinds[F.col("kind")], F.lit(")")))


def group_key(system: str, code: str) -> Column:
    """Records with one key are of one drug or analyte: by code, else by wording, else each alone."""
    wording = F.nullif(folded(F.trim("display")), F.lit(""))
    return F.coalesce(F.concat(F.lit(f"{system}:"), F.nullif(F.col(code), F.lit(""))), F.concat(F.lit("display:"), wording), F.concat(F.lit("resource:"), F.col("seq")))


def split_status(display: Column) -> Column:
    """Struct of label, clinical, verification: the statuses in brackets at the end of a condition's name, if they all are statuses."""
    inside = F.regexp_extract(display, r"\s*\(([^()]*)\)\s*$", 1)
    tokens = F.transform(F.split(inside, ","), lambda x: F.lower(F.trim(x)))
    every = F.array(*[F.lit(x) for x in CLINICAL + VERIFICATION])
    is_status = display.rlike(r"\([^()]*\)\s*$") & F.forall(tokens, lambda x: F.array_contains(every, x))
    first = lambda names: F.try_element_at(F.filter(tokens, lambda x: x.isin(*names)), F.lit(1))
    rest = F.coalesce(F.nullif(F.trim(F.regexp_replace(display, r"\s*\([^()]*\)\s*$", "")), F.lit("")), display)
    return F.struct(F.when(is_status, rest).otherwise(display).alias("label"), F.when(is_status, first(CLINICAL)).alias("clinical"), F.when(is_status, first(VERIFICATION)).alias("verification"))


def conditions(evidence: DataFrame, as_of: date | None = None) -> DataFrame:
    """patient_id, seq, date, display, status, verification, open, place: conditions still in play and closed ones, each in order of date, name and record."""
    rows = known(facts(evidence).filter("kind = 'condition'"), as_of).withColumn("s", split_status(label()))
    # a status that nobody stated is no resolution
    rows = rows.select("patient_id", "seq", "date", F.col("s.label").alias("display"), F.col("s.clinical").alias("status"), F.col("s.verification").alias("verification"), (~F.coalesce(F.col("s.clinical").isin(*CLOSED), F.lit(False))).alias("open"))
    order = Window.partitionBy("patient_id", "open").orderBy(F.coalesce(F.col("date").cast("string"), F.lit("")), folded(F.col("display")), "seq")
    return rows.withColumn("place", F.row_number().over(order))


def _recent(partition: list[str]) -> Window:
    return Window.partitionBy(*partition).orderBy(F.col("date").desc_nulls_last(), "seq")


def latest_medication(evidence: DataFrame, as_of: date | None = None) -> DataFrame:
    """patient_id, drug, orders, latest_date, display, seq: the latest order of each drug, which is no claim that it is still taken."""
    rows = known(facts(evidence).filter("kind = 'medication'"), as_of).withColumn("drug", group_key("RxNorm", "rxnorm"))
    key = ["patient_id", "drug"]
    rows = rows.withColumn("rank", F.row_number().over(_recent(key))).withColumn("orders", F.count("*").over(Window.partitionBy(*key)))
    return rows.filter("rank = 1").select("patient_id", "drug", "orders", F.col("date").alias("latest_date"), label().alias("display"), "seq")


def analyte_trend(evidence: DataFrame, as_of: date | None = None) -> DataFrame:
    """patient_id, analyte, loinc, display, n, first_date, latest, unit, latest_date, seq, previous, previous_unit, previous_date, trend of each numeric analyte.

    The trend is null without an earlier value, ``unit changed`` if units differ
    beyond their spelling, else rising, falling or unchanged.
    """
    rows = known(facts(evidence).filter("kind = 'observation' AND value IS NOT NULL"), as_of).withColumn("analyte", group_key("LOINC", "loinc"))
    key = ["patient_id", "analyte"]
    order, every = _recent(key), Window.partitionBy(*key)
    rows = rows.withColumns({f"previous{x}": F.lead(c).over(order) for x, c in (("", "value"), ("_unit", "unit"), ("_date", "date"))} | {"rank": F.row_number().over(order), "n": F.count("*").over(every), "first_date": F.min("date").over(every)})
    plain = lambda c: normal_unit(F.coalesce(F.col(c), F.lit("")))
    trend = (
        F.when(F.col("n") < 2, F.lit(None).cast("string"))
        .when(plain("previous_unit") != plain("unit"), "unit changed")
        .when(F.col("value") > F.col("previous"), "rising")
        .when(F.col("value") < F.col("previous"), "falling")
        .otherwise("unchanged")
    )
    return rows.filter("rank = 1").select("patient_id", "analyte", "loinc", label().alias("display"), "n", "first_date", F.col("value").alias("latest"), "unit", F.col("date").alias("latest_date"), "seq", "previous", "previous_unit", "previous_date", trend.alias("trend"))


def chart_counts(evidence: DataFrame, as_of: date | None = None) -> DataFrame:
    """patient_id, kind, n (records), first_date, last_date, span_years."""
    found = known(facts(evidence), as_of).groupBy("patient_id", "kind").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return found.withColumn("span_years", F.year("last_date") - F.year("first_date"))


def notes(evidence: DataFrame, as_of: date | None = None) -> DataFrame:
    """patient_id, seq, date, display, place: notes by date and record, undated ones first."""
    rows = known(facts(evidence).filter("kind = 'note'"), as_of)
    order = Window.partitionBy("patient_id").orderBy(F.col("date").asc_nulls_first(), "seq")
    return rows.select("patient_id", "seq", "date", label().alias("display"), F.row_number().over(order).alias("place"))


def summary(patients: DataFrame, evidence: DataFrame, as_of: date) -> DataFrame:
    """One row per patient: age_years, sex, counts of open and closed conditions, drugs, analytes, results without a value, visits with their first and last day, notes, and records left out."""
    rows = facts(evidence).withColumn("in_time", F.col("date").isNull() | (F.col("date") <= F.lit(as_of))).withColumn("s", split_status(label()))
    here = F.col("in_time")
    kind = lambda x: here & (F.col("kind") == x)
    closed = F.coalesce(F.col("s.clinical").isin(*CLOSED), F.lit(False))
    # a set a patient: two distinct counts would triple the rows
    distinct = lambda x: F.size(F.collect_set(x)).cast("long")
    counted = rows.groupBy("patient_id").agg(
        F.count_if(kind("condition") & ~closed).alias("open_conditions"),
        F.count_if(kind("condition") & closed).alias("closed_conditions"),
        distinct(F.when(kind("medication"), group_key("RxNorm", "rxnorm"))).alias("drugs"),
        distinct(F.when(kind("observation") & F.col("value").isNotNull(), group_key("LOINC", "loinc"))).alias("analytes"),
        F.count_if(kind("observation") & F.col("value").isNull()).alias("without_value"),
        F.count_if(kind("encounter")).alias("visits"),
        F.min(F.when(kind("encounter"), F.col("date"))).alias("first_visit"),
        F.max(F.when(kind("encounter"), F.col("date"))).alias("last_visit"),
        F.count_if(kind("note")).alias("notes"),
        F.count_if(~here).alias("left_out"),
    )
    none = {c: F.coalesce(c, F.lit(0)) for c in ("open_conditions", "closed_conditions", "drugs", "analytes", "without_value", "visits", "notes", "left_out")}
    people = patients.select("patient_id", age_years(F.col("birth_date"), F.lit(as_of)).alias("age_years"), "sex")
    return people.join(counted, "patient_id", "left").withColumns(none)


def text(patients: DataFrame, evidence: DataFrame, as_of: date) -> DataFrame:
    """patient_id, summary: the chart in Markdown for a reader who sees nothing else."""
    day = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("undated"))
    num = lambda n, one, many: F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))

    def listed(rows: DataFrame, line: Column, name: str, *order) -> DataFrame:
        lines = F.transform(F.array_sort(F.collect_list(F.struct(*[x.alias(f"o{i}") for i, x in enumerate(order)], line.alias("line")))), lambda x: x["line"])
        return rows.groupBy("patient_id").agg(lines.alias(name))

    c = conditions(evidence, as_of)
    marked = F.concat("display", F.when(F.coalesce("verification", F.lit("confirmed")) != "confirmed", F.concat(F.lit(" ["), F.col("verification"), F.lit("]"))).otherwise(""))
    opened = listed(c.filter("open"), F.concat(F.lit("- "), day("date"), F.lit("  "), marked), "opened", F.col("place"))
    closed = listed(c.filter("NOT open"), F.concat("display", F.lit(" ("), day("date"), F.lit(")")), "closed", F.col("place"))
    drugs = latest_medication(evidence, as_of)
    drugs = listed(drugs, F.concat(F.lit("- "), day("latest_date"), F.lit("  "), F.col("display")), "drugs_lines", folded(F.col("display")), F.coalesce(F.col("latest_date").cast("string"), F.lit("")), F.col("seq"))
    a = analyte_trend(evidence, as_of)
    with_unit = lambda value, unit: F.concat(short_number(F.col(value)), F.coalesce(F.concat(F.lit(" "), F.nullif(F.col(unit), F.lit(""))), F.lit("")))
    head = F.concat(F.lit("- "), day("latest_date"), F.lit("  "), F.col("display"), F.coalesce(F.concat(F.lit(" [LOINC "), F.col("loinc"), F.lit("]")), F.lit("")), F.lit(": "), with_unit("latest", "unit"))
    before = F.concat(F.lit(" ("), num(F.col("n"), "result", "results"), F.lit(" since "), F.coalesce(F.col("first_date").cast("string"), F.lit("None")), F.lit("; previous "), with_unit("previous", "previous_unit"), F.lit(" on "), F.coalesce(F.col("previous_date").cast("string"), F.lit("None")), F.lit(", "), F.col("trend"), F.lit(")"))
    results = listed(a, F.concat(head, F.when(F.col("n") == 1, " (only result on file)").otherwise(before)), "results", folded(F.col("display")), F.coalesce("loinc", F.lit("")), F.col("seq"))
    n = notes(evidence, as_of)
    told = listed(n, F.concat(F.lit("- "), day("date"), F.lit("  "), F.col("display")), "told", F.col("place"))
    out = summary(patients, evidence, as_of).join(patients.select("patient_id", "birth_date", "deceased", "deceased_undated"), "patient_id")
    for part in (opened, closed, drugs, results, told):
        out = out.join(part, "patient_id", "left")
    none = F.array().cast("array<string>")
    lines = lambda name, empty: F.when(F.size(F.coalesce(name, none)) > 0, F.array_join(name, "\n")).otherwise(empty)
    size = lambda name: F.size(F.coalesce(name, none)).cast("string")
    section = lambda title, body: F.concat(F.lit("## "), title, F.lit("\n\n"), body, F.lit("\n"))
    cut = F.when(F.col("left_out") > 0, F.concat(F.lit("; "), num(F.col("left_out"), "record", "records"), F.lit(" dated after the screening date "), F.when(F.col("left_out") == 1, "is").otherwise("are"), F.lit(" excluded"))).otherwise("")
    born = F.when(F.col("birth_date").isNotNull(), F.concat(F.lit("- Date of birth: "), F.col("birth_date").cast("string"), F.lit(" (age "), F.col("age_years").cast("string"), F.lit(f" at {as_of})"))).otherwise("- Date of birth: not recorded, so age is unknown")
    died = F.when(F.col("deceased") <= F.lit(as_of), F.concat(F.lit("\n- **Died "), F.col("deceased").cast("string"), F.lit("**, before the screening date"))).when(F.col("deceased").isNull() & F.coalesce("deceased_undated", F.lit(False)), "\n- **Recorded as deceased**, with no date given").otherwise("")
    no_value = F.when(F.col("without_value") > 0, F.concat(F.lit("\n\n"), num(F.col("without_value"), "further observation", "further observations"), F.when(F.col("without_value") == 1, " carries no numeric value and is not listed.").otherwise(" carry no numeric value and are not listed."))).otherwise("")
    visits = F.when((F.col("visits") > 0) & F.col("first_visit").isNotNull(), F.concat(num(F.col("visits"), "encounter", "encounters"), F.lit(", "), F.col("first_visit").cast("string"), F.lit(" to "), F.col("last_visit").cast("string"), F.lit("."))).otherwise("None recorded.")
    whole = F.concat_ws(
        "\n",
        F.concat(F.lit("# Chart summary: "), F.col("patient_id").cast("string"), F.lit("\n")),
        F.concat(F.lit(f"Screening date: {as_of}. Only facts recorded on or before it are shown"), cut, F.lit(".\n")),
        section(F.lit("Demographics"), F.concat(born, F.lit("\n- Sex: "), F.coalesce("sex", F.lit("not recorded")), died)),
        section(F.concat(F.lit("Active conditions ("), size("opened"), F.lit(")")), lines("opened", "None recorded.")),
        section(F.concat(F.lit("Resolved or inactive conditions ("), size("closed"), F.lit(")")), F.when(F.size(F.coalesce("closed", none)) > 0, F.array_join("closed", "; ")).otherwise("None recorded.")),
        section(F.concat(F.lit("Medications ("), size("drugs_lines"), F.lit(", most recent order per drug)")), lines("drugs_lines", "None recorded.")),
        section(F.concat(F.lit("Results ("), num(F.col("analytes"), "analyte", "analytes"), F.lit(")")), F.concat(lines("results", "No numeric results on file."), no_value)),
        section(F.lit("Encounters"), visits),
        section(F.concat(F.lit("Notes ("), size("told"), F.lit(")")), lines("told", "No notes on file.")),
    )
    return out.select("patient_id", whole.alias("summary"))
