"""Screening: criteria against evidence under three-valued logic.

One pass over the evidence serves all criteria of all protocols. Their lookups
(a kind, a concept, a window) are a small broadcast table; evidence meets it by
one join on kind and code, and one aggregation by patient keeps, for each
lookup, the latest row. Verdicts are then nullable booleans of columns (true:
met, false: not met, null: unknown), and the rollup works on an array in the
patient's own row, so nothing moves again. Several protocols or policies are
rows made from the same patient row.

evidence: patient_id, kind, system, code, display, value, unit, date, seq and
optionally source; seq orders rows of the same date. Rows with several codes
come once for each code.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from screenlake.functions.dates import age_years, in_window, window_start
from screenlake.functions.text import folded
from screenlake.functions.units import convert
from screenlake.plans.criteria import Composite, Criterion, Demographic, Observation, Presence, Protocol, Window, leaves

POLICIES = ("coverage_gated", "closed_world", "open_world")
#: Lookups that one aggregation keeps; more are taken in several, joined by patient.
WIDTH = 250
#: Where a fact stands in its source; kept with the latest row, if evidence has it.
RECORD = ("resource_type", "resource_id", "fhir_path")


@dataclass(frozen=True)
class Lookup:
    kind: str
    text: str
    codes: tuple[tuple[str, str], ...]
    window: Window | None


def lookups(protocols: list[Protocol]) -> list[Lookup]:
    """Distinct lookups of all predicates, and for each presence test the visits of its window."""
    found: dict[Lookup, None] = {}
    for protocol in protocols:
        for criterion in protocol.criteria:
            for p in leaves(criterion.predicate):
                if isinstance(p, Observation | Presence):
                    found[Lookup(p.type, p.concept.text, p.concept.codes, p.window)] = None
                if isinstance(p, Presence):
                    found[visits(p.window)] = None
    return list(found)


def visits(window: Window | None) -> Lookup:
    return Lookup("encounter", "", (), window)


def _start(window: Window | None, as_of: date) -> date | None:
    return window_start(as_of, window.amount, window.unit) if window and window.amount else None


def latest(evidence: DataFrame, wanted: list[Lookup], as_of: date) -> DataFrame:
    """patient_id and a struct l0, l1, ... for each lookup: its latest row (seq, date, value, unit, display), null if none.

    Dated rows come first, the latest before the others, ties in order of seq.
    """
    out = None
    for first in range(0, max(len(wanted), 1), WIDTH):
        part = _latest(evidence, wanted, range(first, min(first + WIDTH, len(wanted))), as_of)
        out = part if out is None else out.join(part, "patient_id", "full_outer")
    return out


def with_lookups(rows: DataFrame, wanted: list[Lookup], places: range | None = None, keep: Column | None = None) -> DataFrame:
    """Rows of evidence, one for each lookup (its place) that they meet by kind and code, or by wording if it has no code; of the others those to keep, with none."""
    spark = rows.sparkSession
    mine = [(i, wanted[i]) for i in (range(len(wanted)) if places is None else places)]
    by_code: dict[tuple[str, str, str], list[int]] = {}
    for i, x in mine:
        for s, c in x.codes:
            by_code.setdefault((x.kind, s, c), []).append(i)
    if "source" not in rows.columns:
        rows = rows.withColumn("source", F.lit("structured"))
    of_kind = F.col("kind").isin(sorted({x.kind for _, x in mine}))
    rows = rows.filter(of_kind if keep is None else of_kind | keep)
    # at most a row for each code of the protocols
    coded = F.broadcast(spark.createDataFrame([(*k, v) for k, v in by_code.items()], "kind string, system string, code string, coded array<int>"))
    rows = rows.join(coded, ["kind", "system", "code"], "left")
    none = F.array().cast("array<int>")
    named = (F.col("source") != "narrative") & (F.trim("display") != "")
    others = []
    for i, x in mine:
        if x.kind == "encounter":
            others.append(F.when(F.col("kind") == "encounter", F.lit(i)))
        elif not x.codes:
            others.append(F.when((F.col("kind") == x.kind) & named & folded(F.col("display")).contains(F.lit(x.text.casefold())), F.lit(i)))
    hits = F.concat(F.coalesce("coded", none), F.array_compact(F.array(*others)) if others else none)
    if keep is None:
        return rows.withColumn("lookup", F.explode(hits))
    return rows.withColumn("lookup", F.explode_outer(hits)).filter(F.col("lookup").isNotNull() | keep)


def _in_own_window(mine: list[tuple[int, Lookup]], as_of: date) -> Column:
    """Whether the date of a row is in the window of its lookup."""
    by_window: dict[Window | None, list[int]] = {}
    for i, x in mine:
        by_window.setdefault(x.window, []).append(i)
    out = F.lit(False)
    for w, places in by_window.items():
        out = out | (F.col("lookup").isin(places) & in_window(F.col("date"), w.relation if w else None, _start(w, as_of), as_of))
    return out


def _latest(evidence: DataFrame, wanted: list[Lookup], places: range, as_of: date) -> DataFrame:
    mine = [(i, wanted[i]) for i in places]
    record = [c for c in RECORD if c in evidence.columns]
    rows = with_lookups(evidence.filter(F.col("date").isNull() | (F.col("date") <= F.lit(as_of))), wanted, places)
    # what is outside its window never reaches the shuffle
    rows = rows.filter(_in_own_window(mine, as_of)).select("patient_id", "date", "seq", "value", "unit", "display", *record, "lookup")
    first = F.struct(F.coalesce(F.datediff(F.lit(as_of), "date"), F.lit(2**31 - 1)).alias("age"), "seq", "date", "value", "unit", "display", *record)
    counts = {i: in_window(F.col("date"), x.window.relation if x.window else None, _start(x.window, as_of), as_of) for i, x in mine}
    return rows.groupBy("patient_id").agg(*[F.min(F.when((F.col("lookup") == i) & counts[i], first)).alias(f"l{i}") for i, _ in mine])


def matches(evidence: DataFrame, wanted: list[Lookup], as_of: date, most: int) -> DataFrame:
    """patient_id and an array m0, m1, ... for each lookup: its latest rows in the order of ``latest``, ``most`` of them at most.

    The limit by patient and lookup is taken before the shuffle and after it, so
    no task sees more than that of a partition.
    """
    rows = with_lookups(evidence.filter(F.col("date").isNull() | (F.col("date") <= F.lit(as_of))), wanted)
    record = [c for c in RECORD if c in evidence.columns]
    counts = F.lit(False)
    for i, x in enumerate(wanted):
        counts = F.when(F.col("lookup") == i, in_window(F.col("date"), x.window.relation if x.window else None, _start(x.window, as_of), as_of)).otherwise(counts)
    row = F.struct(F.coalesce(F.datediff(F.lit(as_of), "date"), F.lit(2**31 - 1)).alias("age"), "seq", "date", "value", "unit", "display", *record)
    # a record with two codes of one lookup is one row of it
    place = F.dense_rank().over(Over.partitionBy("patient_id", "lookup").orderBy("row"))
    kept = rows.filter(counts).select("patient_id", "lookup", row.alias("row")).withColumn("place", place).filter(F.col("place") <= most)
    of = lambda i: F.array_sort(F.collect_set(F.when(F.col("lookup") == i, F.col("row"))))
    return kept.groupBy("patient_id").agg(*[of(i).alias(f"m{i}") for i in range(len(wanted))])


def _compare(x: Column, op: str, value, high=None) -> Column:
    if op == "between":
        return (x >= value) & (x <= high)
    return {"<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value, "==": x == value, "!=": x != value}[op]


def verdict(p, place: dict, as_of: date, policy: str) -> Column:
    """A predicate as a nullable boolean: a decisive member settles a composite whatever its siblings are.

    Made once for each predicate and policy and kept beside the places of the lookups.
    """
    made = place.setdefault("made", {})
    if (p, policy, as_of) not in made:
        made[p, policy, as_of] = _verdict(p, place, as_of, policy)
    return made[p, policy, as_of]


def _verdict(p, place: dict, as_of: date, policy: str) -> Column:
    if isinstance(p, Composite):
        members = [verdict(x, place, as_of, policy) for x in p.operands]
        if p.type == "not":
            return ~members[0]
        out = members[0]
        for m in members[1:]:
            out = out & m if p.type == "all_of" else out | m
        return out
    if isinstance(p, Observation):
        row = F.col(f"l{place[Lookup(p.type, p.concept.text, p.concept.codes, p.window)]}")
        value = convert(row["value"], row["unit"], p.unit, [c for s, c in p.concept.codes if s == "LOINC"])
        return _compare(value, p.op, F.lit(float(p.value)), None if p.value_high is None else F.lit(float(p.value_high)))
    if isinstance(p, Presence):
        found = F.col(f"l{place[Lookup(p.type, p.concept.text, p.concept.codes, p.window)]}").isNotNull()
        covered = {"open_world": F.lit(False), "closed_world": F.lit(True), "coverage_gated": F.col(f"l{place[visits(p.window)]}").isNotNull()}[policy]
        present = F.when(found, True).when(covered, False)
        return present if p.presence == "present" else ~present
    if isinstance(p, Demographic):
        if p.field == "age":
            return _compare(age_years(F.col("birth_date"), F.lit(as_of)), p.op, F.lit(float(p.value)))
        equal = folded(F.col("sex")) == str(p.value).casefold()
        return equal if p.op == "==" else ~equal
    return F.lit(None).cast("boolean")


def blocking(p, place: dict[Lookup, int], as_of: date, policy: str) -> Column:
    """Whether an unknown verdict holds the screening up. ``not`` and decided composites always do."""
    if isinstance(p, Composite) and p.type != "not":
        open_members = F.lit(False)
        for x in p.operands:
            open_members = open_members | (verdict(x, place, as_of, policy).isNull() & blocking(x, place, as_of, policy))
        return F.when(verdict(p, place, as_of, policy).isNull(), open_members).otherwise(True)
    return F.lit(getattr(p, "settlement", None) != "at_visit" or p.type != "unsupported")


# Fixed value: how a packet words a window that is counted from another event.
CAVEAT = "the protocol anchors this window to {0}, which was evaluated against the screening date"


def caveats(p, place: dict, as_of: date, policy: str) -> Column:
    """Windows that the protocol counts from another event than screening: of the members that settle a composite, else of all."""
    none = F.array().cast("array<string>")
    anchored = [x for x in leaves(p) if getattr(x, "window", None) is not None and x.window.anchor != "screening"]
    if not anchored:
        return none
    if not isinstance(p, Composite):
        return F.array(F.lit(CAVEAT.format(p.window.anchor)))
    members = [caveats(x, place, as_of, policy) for x in p.operands]
    if p.type == "not":
        return members[0]
    return F.flatten(F.array(*[F.when(s, m).otherwise(none) for s, m in zip(settling(p, place, as_of, policy), members, strict=True)]))


def settling(p: Composite, place: dict, as_of: date, policy: str) -> list[Column]:
    """For each member, whether the composite rests on it: the decisive members alone, where there are any."""
    decisive = F.lit(p.type == "any_of")
    settled = verdict(p, place, as_of, policy).eqNullSafe(decisive)
    return [~settled | verdict(x, place, as_of, policy).eqNullSafe(decisive) for x in p.operands]


def dead(as_of: date) -> Column:
    return F.coalesce(F.col("deceased") <= F.lit(as_of), F.lit(False)) | F.coalesce("deceased_undated", F.lit(False))


RESULTS = "array<struct<criterion_id:string,kind:string,ord:int,verdict:boolean,blocking:boolean,caveats:array<string>>>"


def _results(protocol: Protocol, place: dict[Lookup, int], as_of: date, policy: str) -> Column:
    """The results of one protocol as an array column."""
    def one(i: int, c: Criterion) -> Column:
        return F.struct(
            F.lit(c.id).alias("criterion_id"),
            F.lit(c.kind).alias("kind"),
            F.lit(i).alias("ord"),
            verdict(c.predicate, place, as_of, policy).alias("verdict"),
            blocking(c.predicate, place, as_of, policy).alias("blocking"),
            caveats(c.predicate, place, as_of, policy).alias("caveats"),
        )

    return F.array(*[one(i, c) for i, c in enumerate(protocol.criteria)]).cast(RESULTS)


def looked_up(patients: DataFrame, evidence: DataFrame, protocols: list[Protocol], as_of: date) -> tuple[DataFrame, dict[Lookup, int]]:
    """Patients alive at as_of with the latest row of every lookup, and the place of each lookup."""
    wanted = lookups(protocols)
    alive = patients.filter(~dead(as_of))
    return (alive.join(latest(evidence, wanted, as_of), "patient_id", "left") if wanted else alive), {x: i for i, x in enumerate(wanted)}


def criterion_results(patients: DataFrame, evidence: DataFrame, protocol: Protocol, as_of: date, policy: str = POLICIES[0]) -> DataFrame:
    """patients with results: an array of criterion_id, kind, ord, verdict, blocking and caveats, for those not dead by as_of."""
    rows, place = looked_up(patients, evidence, [protocol], as_of)
    return rows.select(*patients.columns, _results(protocol, place, as_of, policy).alias("results"))


def settle(results: DataFrame, settlements: DataFrame, nct_id: str) -> DataFrame:
    """Answers of people (nct_id, patient_id, criterion_id, verdict MET or NOT_MET) where the record is silent.

    A settled criterion keeps its blocking flag; an answer to a decided one changes nothing (see refused).
    """
    own = settlements.filter(F.col("nct_id") == nct_id).groupBy("patient_id").agg(F.map_from_entries(F.collect_list(F.struct("criterion_id", F.expr("verdict = 'MET'")))).alias("answers"))

    def with_answer(x: Column) -> Column:
        return x.withField("verdict", F.coalesce(x["verdict"], F.try_element_at("answers", x["criterion_id"])))

    # answers outgrow what the sizes of their files promise, so never by a broadcast
    return results.join(own.hint("merge"), "patient_id", "left").withColumn("results", F.when(F.col("answers").isNull(), F.col("results")).otherwise(F.transform("results", with_answer))).drop("answers")


def refused(results: DataFrame, settlements: DataFrame, nct_id: str) -> DataFrame:
    """patient_id, criterion_id of answers to what the record had decided."""
    own = settlements.filter(F.col("nct_id") == nct_id).select("patient_id", "criterion_id").distinct()
    decided = results.select("patient_id", F.explode("results").alias("r")).filter("r.verdict IS NOT NULL").select("patient_id", "r.criterion_id")
    return own.join(decided, ["patient_id", "criterion_id"])


def _ids(rows: Column) -> Column:
    return F.transform(rows, lambda r: r["criterion_id"])


def roll_up(results: DataFrame) -> DataFrame:
    """Adds decision, deciding_ids, unresolved_ids, deferred_ids, coverage and forced_decision.

    A failed inclusion or a triggered exclusion ends it; then anything unknown
    that blocks, no criteria, or none that blocks, needs a review.
    """
    fails = lambda r, kind: (r["kind"] == kind) & F.coalesce(r["verdict"] == F.lit(kind == "exclusion"), F.lit(False))
    failing = lambda kind: _ids(F.filter("results", lambda r: fails(r, kind)))
    deciding = F.concat(failing("inclusion"), failing("exclusion"))
    unknown = lambda blocks: _ids(F.filter("results", lambda r: r["verdict"].isNull() & (r["blocking"] == F.lit(blocks))))
    blocks = F.size(F.filter("results", lambda r: r["blocking"]))
    settled = F.size(F.filter("results", lambda r: r["blocking"] & r["verdict"].isNotNull()))
    none = F.array().cast("array<string>")
    out = results.withColumn("deciding_ids", deciding)
    out = out.withColumn("unresolved_ids", F.when(F.size("deciding_ids") > 0, none).otherwise(unknown(True)))
    out = out.withColumn("deferred_ids", F.when(F.size("deciding_ids") > 0, none).otherwise(unknown(False)))
    review = (F.size("unresolved_ids") > 0) | (blocks == 0)
    return out.withColumns({
        "decision": F.when(F.size("deciding_ids") > 0, "ineligible").when(review, "needs_review").otherwise("eligible"),
        "coverage": F.when(blocks == 0, F.lit(0.0)).otherwise(settled / blocks),
        "forced_decision": F.when(F.size("deciding_ids") > 0, "ineligible").otherwise("eligible"),
    })


def screen(patients: DataFrame, evidence: DataFrame, protocol: Protocol, as_of: date, policy: str = POLICIES[0], settlements: DataFrame | None = None) -> DataFrame:
    """One row per patient: decision with its ids, coverage, forced_decision, blocked_by, results.

    A death by as_of, or without a date, ends the screening before any criterion:
    ineligible, coverage 1, and the forced decision, which looks at criteria alone, eligible.
    """
    results = criterion_results(patients, evidence, protocol, as_of, policy)
    if settlements is not None:
        results = settle(results, settlements, protocol.nct_id)
    return with_the_dead(roll_up(results), patients.filter(dead(as_of)))


def with_the_dead(rolled: DataFrame, gone: DataFrame) -> DataFrame:
    decided = rolled.withColumn("blocked_by", F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    gone = gone.withColumns({
        "results": F.array().cast(decided.schema["results"].dataType), "deciding_ids": none, "unresolved_ids": none, "deferred_ids": none,
        "decision": F.lit("ineligible"), "coverage": F.lit(1.0), "forced_decision": F.lit("eligible"), "blocked_by": F.lit("deceased"),
    })
    return decided.unionByName(gone)


def screen_all(patients: DataFrame, evidence: DataFrame, protocols: list[Protocol], as_of: date, policies: tuple[str, ...] = POLICIES[:1]) -> DataFrame:
    """screen() for several protocols and policies at once: nct_id and policy lead the columns.

    Evidence is read and aggregated once; each pair is a row made from the patient's own.
    """
    rows, place = looked_up(patients, evidence, protocols, as_of)
    pairs = [(p, policy) for p in protocols for policy in policies]
    each = F.explode(F.array(*[F.struct(F.lit(p.nct_id).alias("nct_id"), F.lit(policy).alias("policy"), _results(p, place, as_of, policy).alias("results")) for p, policy in pairs]))
    results = rows.select(*patients.columns, each.alias("x")).select("x.nct_id", "x.policy", *patients.columns, "x.results")
    names = F.explode(F.array(*[F.struct(F.lit(p.nct_id).alias("nct_id"), F.lit(policy).alias("policy")) for p, policy in pairs]))
    gone = patients.filter(dead(as_of)).select("*", names.alias("x")).select("x.nct_id", "x.policy", *patients.columns)
    return with_the_dead(roll_up(results), gone)


def measures(screenings: DataFrame) -> DataFrame:
    """Adds criteria_total, criteria_resolved (of those that the record should settle), at_visit_ids, settled coverage and all distinct caveats in order."""
    blocks = F.filter("results", lambda r: r["blocking"])
    return screenings.withColumns({
        "criteria_total": F.size(blocks),
        "criteria_resolved": F.size(F.filter(blocks, lambda r: r["verdict"].isNotNull())),
        "at_visit_ids": _ids(F.filter("results", lambda r: r["verdict"].isNull() & ~r["blocking"])),
        "all_caveats": F.array_distinct(F.flatten(F.transform("results", lambda r: r["caveats"]))),
    })


def worklist(screenings: DataFrame) -> DataFrame:
    """patient_id, criterion_id, ord (and nct_id, if there) of what the record should settle and does not, in every screening that read criteria."""
    lead = [c for c in ("nct_id", "policy") if c in screenings.columns]
    return screenings.select(*lead, "patient_id", F.explode("results").alias("r")).filter("r.verdict IS NULL AND r.blocking").select(*lead, "patient_id", "r.criterion_id", "r.ord")


def blockers(screenings: DataFrame, reasons: DataFrame | None = None, quotes: DataFrame | None = None, top: int = 10) -> DataFrame:
    """nct_id, criterion_id, n, screenings (of its own trial, all of them), reason, missing, quote, others: the criteria that leave most screenings open.

    Ties keep the order in which the criteria were met, by patient and place;
    reason and missing are those of the first patient. others counts the
    criteria beyond the top. reasons: nct_id, criterion_id, patient_id,
    rationale, missing; quotes: nct_id, criterion_id, quote.
    """
    key = ["nct_id", "criterion_id"]
    counted = worklist(screenings).groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("patient_id", "ord")).alias("met"))
    total = screenings.groupBy("nct_id").agg(F.count("*").alias("screenings"))
    out = counted.join(F.broadcast(total), "nct_id")  # a row a trial
    if reasons is not None:
        first = reasons.select(*key, "patient_id", F.col("rationale").alias("reason"), "missing")
        out = out.join(first, (out.nct_id == first.nct_id) & (out.criterion_id == first.criterion_id) & (out.met["patient_id"] == first.patient_id), "left").drop(first.nct_id, first.criterion_id, first.patient_id)
    if quotes is not None:
        out = out.join(quotes.select(*key, "quote"), key, "left")
    # a row a criterion of a protocol
    order = Over.orderBy(F.desc("n"), "met")
    out = out.withColumn("place", F.row_number().over(order)).withColumn("others", F.greatest(F.count("*").over(Over.partitionBy()) - F.lit(top), F.lit(0)))
    return out.filter(F.col("place") <= top).drop("met")


def verdict_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """patient_id, criterion_id, before, after of criteria whose verdict differs between two runs."""
    rows = lambda df, name: df.select("patient_id", F.explode("results").alias("r")).select("patient_id", "r.criterion_id", F.col("r.verdict").alias(name), F.lit(True).alias(f"in_{name}"))
    both = rows(before, "before").join(rows(after, "after"), ["patient_id", "criterion_id"], "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")) | F.col("in_before").isNull() | F.col("in_after").isNull()).select("patient_id", "criterion_id", "before", "after")
