"""Packets: one nested document for each screening, as a person reads and files it.

A packet is an expression on the row that verdicts and reasons come from, so a
packet for every patient and trial costs one lookup of the evidence. What comes
first depends on the outcome: deciding rows only if ineligible, open items only
while the outcome is open, questions for the visit unless ineligible.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.functions.dates import age_years
from screenlake.operators import reasons, screening
from screenlake.plans.criteria import Protocol

# The words of a packet.
DECISIONS = {"eligible": "Eligible", "ineligible": "Not eligible", "needs_review": "Needs review before a decision"}
VERDICTS = {"met": "Met", "not_met": "Not met", "unknown": "Unresolved"}
SLUGS = {"met": "met", "not_met": "not-met", "unknown": "unresolved"}
POLICY_NOTES = {
    "coverage_gated": "coverage-gated, meaning a finding absent from the chart counts as absent only where an encounter documents the window",
    "open_world": "open-world, meaning a finding absent from the chart never resolves a criterion",
    "closed_world": "closed-world, meaning a finding absent from the chart is read as absent from the patient",
}
STOPPED = "Screening stopped before any criterion was evaluated, because {0}."
NOT_RUN = "no criterion was evaluated; the screening stopped before the protocol was run"
ALL_CHECKED = "every sentence was checked against the record it describes"
ENGINE_WROTE = "{0} of {1} were written by the screening engine, because the drafted sentence could not be verified against the record"
RESTS_ON = "This screening rests on {0} {1}. The criteria affected are marked in the table below."
ANSWERED = "{0} {1} on this screening was answered by a person rather than from data."
NO_DEMOGRAPHICS = "no demographics on file"

COLUMNS = (
    "nct_id", "patient_id", "trial", "patient_summary", "screened_on", "decision", "verdict", "blocked_by", "stopped_note", "caveats", "caveat_note", "deciding", "open_items", "at_visit",
    "settlements", "settlement_note", "rows", "absence_policy", "absence_policy_note", "criteria_fingerprint", "criteria_resolved", "criteria_total", "coverage_note", "engine_written", "rationale_note",
)


def _filled(words: str, *values) -> Column:
    """The words with {0}, {1} as columns."""
    out, rest = [], words
    for i, v in enumerate(values):
        before, rest = rest.split(f"{{{i}}}")
        out += [F.lit(before), v]
    return F.concat(*out, F.lit(rest))


def _named(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def _word(verdict: Column) -> Column:
    return F.when(verdict, "met").when(~verdict, "not_met").otherwise("unknown")


def _of(values: dict[str, str] | None, key: Column) -> Column:
    """What a trial is given by name: a row a protocol, kept on the driver."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key) if values else F.lit(None).cast("string")


def patient_summary(as_of: date) -> Column:
    """Age, recorded sex and death in a line; of a patient dead by as_of the age isn't one at screening."""
    dead = screening.dead(as_of)
    age = age_years(F.col("birth_date"), F.lit(as_of))
    died = F.concat(F.lit("died "), F.col("deceased").cast("string"))
    parts = F.array_compact(F.array(
        F.concat(age.cast("string"), F.lit(" years old"), F.when(dead, "").otherwise(" at screening")),
        F.when(F.col("sex") != "", F.concat(F.lit("recorded sex "), F.col("sex"))),
        F.when(F.col("deceased").isNotNull(), F.when(dead, died).otherwise(F.concat(died, F.lit(", after this screening")))).when(F.coalesce("deceased_undated", F.lit(False)), "recorded as deceased, no date given"),
    ))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(NO_DEMOGRAPHICS)


def caveat_index(rows: Column) -> Column:
    """text, criterion_ids for each distinct caveat, in the order in which they are met."""
    texts = F.array_distinct(F.flatten(F.transform(rows, lambda r: r["caveats"])))
    return F.transform(texts, lambda t: F.struct(t.alias("text"), F.transform(F.filter(rows, lambda r: F.array_contains(r["caveats"], t)), lambda r: r["criterion_id"]).alias("criterion_ids")))


def assemble(screenings: DataFrame, protocols: list[Protocol], as_of: date, policy: str, titles: dict[str, str] | None = None, fingerprints: dict[str, str] | None = None, sentences: DataFrame | None = None) -> DataFrame:
    """Packets (COLUMNS) of rolled up screenings with results as reasons.detail makes them.

    A screening of a trial or a criterion that protocols doesn't have raises an
    error, as a packet without its words is wrong. sentences: nct_id, patient_id,
    criterion_id, sentence, source; those with the source fallback, and
    criteria without one, count as written by the engine.
    """
    known = F.create_map(*[x for p in protocols for x in (F.lit(p.nct_id), F.array(*[F.lit(c.id) for c in p.criteria]).cast("array<string>"))])
    compiled = F.try_element_at(known, F.col("nct_id"))
    stray = F.filter("results", lambda r: ~F.array_contains(compiled, r["criterion_id"]))
    wrong = F.when(compiled.isNull(), F.concat(F.lit("no protocol for "), F.coalesce("nct_id", F.lit("null")))).when(F.size(stray) > 0, F.concat(F.lit("no compiled criterion for "), stray[0]["criterion_id"]))
    out = screenings.withColumn("results", F.when(wrong.isNotNull(), F.raise_error(wrong).cast(screenings.schema["results"].dataType)).otherwise(F.col("results")))

    if sentences is None:
        out = out.withColumn("written", F.lit(None).cast("map<string,struct<sentence:string,source:string>>"))
    else:
        key = ["nct_id", "patient_id"]
        one = sentences.groupBy(*key, "criterion_id").agg(F.min(F.struct("sentence", "source")).alias("s"))
        own = one.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("criterion_id", "s"))).alias("written"))
        out = out.join(own.hint("merge"), key, "left")  # sentences may outgrow any broadcast

    def row(r: Column) -> Column:
        s = F.try_element_at("written", r["criterion_id"])
        return F.struct(
            r["criterion_id"].alias("criterion_id"), F.initcap(r["kind"]).alias("kind"), r["quote"].alias("quote"),
            _named(VERDICTS, _word(r["verdict"])).alias("verdict"), _named(SLUGS, _word(r["verdict"])).alias("verdict_slug"),
            F.coalesce(s["sentence"], r["rationale"]).alias("rationale"), (s.isNull() | (s["source"] == "fallback")).alias("engine_written"),
            F.array_contains("deciding_ids", r["criterion_id"]).alias("decisive"), r["caveats"].alias("caveats"), r["settled_by"].alias("settled_by"), r["evidence"].alias("evidence"),
        )

    out = out.withColumn("rows", F.transform("results", row))
    places = F.map_from_entries(F.transform("rows", lambda r: F.struct(r["criterion_id"], r)))
    open_item = lambda r: F.struct(r["criterion_id"].alias("criterion_id"), r["quote"].alias("quote"), r["missing"].alias("missing"), r["where"].alias("where_to_look"), r["query"].alias("fhir_query"))
    check = lambda r: F.struct(r["criterion_id"].alias("criterion_id"), r["kind"].alias("kind"), r["quote"].alias("quote"), r["rationale"].alias("reason"), (r["kind"] == "exclusion").alias("can_still_exclude"))
    settled = F.transform(F.filter("rows", lambda r: r["settled_by"].isNotNull()), lambda r: F.struct(r["criterion_id"].alias("criterion_id"), r["quote"].alias("quote"), r["settled_by"].alias("settled_by")))
    none_of = lambda x, keep: F.filter(x, lambda _: keep)
    unknown = lambda blocks: F.filter("results", lambda r: r["verdict"].isNull() & (r["blocking"] == F.lit(blocks)))
    counts = F.filter("results", lambda r: r["blocking"])
    title = _of(titles, F.col("nct_id"))
    out = out.withColumns({
        "trial": F.concat_ws(" - ", F.col("nct_id"), F.nullif(title, F.lit(""))),
        "patient_summary": patient_summary(as_of),
        "screened_on": F.lit(as_of),
        "verdict": _named(DECISIONS, F.col("decision")),
        "stopped": F.when(F.col("blocked_by").isNotNull(), reasons.vital_sentence(F.col("deceased"))),
        "caveats": caveat_index(F.col("rows")),
        "deciding": none_of(F.transform("deciding_ids", lambda i: places[i]), F.col("decision") == "ineligible"),
        "open_items": none_of(F.transform(unknown(True), open_item), F.col("decision") == "needs_review"),
        "at_visit": none_of(F.transform(unknown(False), check), F.col("decision") != "ineligible"),
        "settlements": settled,
        "absence_policy": F.lit(policy),
        "absence_policy_note": F.lit(POLICY_NOTES[policy]),
        "criteria_fingerprint": _of(fingerprints, F.col("nct_id")),
        "criteria_total": F.size(counts),
        "criteria_resolved": F.size(F.filter(counts, lambda r: r["verdict"].isNotNull())),
        "engine_written": F.size(F.filter("rows", lambda r: r["engine_written"])),
    })
    n = lambda c: F.size(c).cast("string")
    many = lambda c, one, more: F.when(F.size(c) == 1, one).otherwise(more)
    out = out.withColumn("blocked_by", F.col("stopped")).withColumns({
        "stopped_note": _filled(STOPPED, F.col("blocked_by")),
        "caveat_note": F.when(F.size("caveats") > 0, _filled(RESTS_ON, n("caveats"), many("caveats", "approximation", "approximations"))),
        "settlement_note": F.when(F.size("settlements") > 0, _filled(ANSWERED, n("settlements"), many("settlements", "criterion", "criteria"))),
        "coverage_note": F.when(F.col("blocked_by").isNotNull(), NOT_RUN).otherwise(_filled("{0} of {1} decided from the patient record", F.col("criteria_resolved").cast("string"), F.col("criteria_total").cast("string"))),
        "rationale_note": F.when(F.size("rows") > 0, F.when(F.col("engine_written") == 0, ALL_CHECKED).otherwise(_filled(ENGINE_WROTE, F.col("engine_written").cast("string"), n("rows")))),
    })
    return out.select(*COLUMNS)


def packets(patients: DataFrame, evidence: DataFrame, protocols: list[Protocol], as_of: date, policy: str = "coverage_gated", settlements: DataFrame | None = None, titles: dict[str, str] | None = None, fingerprints: dict[str, str] | None = None, sentences: DataFrame | None = None) -> DataFrame:
    """One packet for each patient and protocol; see assemble for sentences and reasons.reasoned for settlements."""
    rolled = screening.roll_up(reasons.reasoned(patients, evidence, protocols, as_of, policy, settlements))
    trials = F.explode(F.array(*[F.lit(p.nct_id) for p in protocols]))
    gone = patients.filter(screening.dead(as_of)).select(trials.alias("nct_id"), *patients.columns)
    return assemble(screening.with_the_dead(rolled, gone), protocols, as_of, policy, titles, fingerprints, sentences)


def rows(documents: DataFrame) -> DataFrame:
    """nct_id, patient_id, place and the fields of each criterion row of the packets."""
    return documents.select("nct_id", "patient_id", F.posexplode("rows").alias("place", "r")).select("nct_id", "patient_id", "place", "r.*")


def caveats(documents: DataFrame) -> DataFrame:
    """nct_id, patient_id, place, text, criterion_ids of each caveat of the packets."""
    return documents.select("nct_id", "patient_id", F.posexplode("caveats").alias("place", "c")).select("nct_id", "patient_id", "place", "c.*")


def items(documents: DataFrame) -> DataFrame:
    """nct_id, patient_id, section (deciding, open_items or at_visit), place, criterion_id, text: what a reader sees first."""
    parts = [("deciding", "rationale"), ("open_items", "missing"), ("at_visit", "reason")]
    one = lambda section, field: F.transform(section, lambda x, i: F.struct(F.lit(section).alias("section"), i.alias("place"), x["criterion_id"].alias("criterion_id"), x[field].alias("text")))
    return documents.select("nct_id", "patient_id", F.explode(F.concat(*[one(*p) for p in parts])).alias("x")).select("nct_id", "patient_id", "x.*")
