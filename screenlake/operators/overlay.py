"""Many edited charts in one screening: evidence with a delta for each edit, merged inside one aggregation.

Every edit says of a row whether it touches it, and what the row is then: gone,
or with another value, unit or date. For each lookup that an edit can reach,
the aggregation by patient keeps a second latest row beside that of the chart as
it is; rows that an edit adds join it afterwards on the patient's own row. So
any number of edits costs one scan and one shuffle of the evidence, and before
and after stand on the same row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from screenlake.operators import relations, screening
from screenlake.operators.edits import analyte
from screenlake.operators.screening import Lookup, in_window
from screenlake.plans.criteria import Protocol


@dataclass(frozen=True)
class Edit:
    """One edit of a corpus. touches, value, unit and day make Columns on rows of evidence; removed rows and an added one are further cases.

    kinds: the kinds of rows that it can reach. died: patient and day of a death that it records.
    """

    name: str
    kinds: tuple[str, ...] = ()
    touches: Callable[[], Column] | None = None
    removes: bool = False
    value: Callable[[], Column] | None = None
    unit: Callable[[], Column] | None = None
    day: Callable[[], Column] | None = None
    added: dict = field(default_factory=dict)
    latest_of: str | None = None
    died: tuple | None = None


def redact_analyte(name: str, loinc: str) -> Edit:
    """Without all results of a code."""
    return Edit(name, ("observation",), lambda: analyte(loinc), removes=True)


def shift_value(name: str, loinc: str, to: float) -> Edit:
    """The latest result of a code gets another value, for each patient."""
    return Edit(name, ("observation",), lambda: analyte(loinc), value=lambda: F.lit(float(to)), latest_of=loinc)


def convert_units(name: str, loinc: str, to_unit: str, factor: float) -> Edit:
    """All numeric results of a code in another unit."""
    return Edit(name, ("observation",), lambda: analyte(loinc) & F.col("value").isNotNull(), value=lambda: F.col("value") * factor, unit=lambda: F.lit(to_unit))


def shift_date(name: str, seq: str, to: date, kinds: tuple[str, ...] = ("observation", "condition", "medication", "procedure", "encounter")) -> Edit:
    """All rows of one record on another day."""
    return Edit(name, kinds, lambda: F.col("seq") == seq, day=lambda: F.lit(to))


def remove_encounters(name: str, after: date) -> Edit:
    """Without visits after a day; undated ones stay."""
    return Edit(name, ("encounter",), lambda: (F.col("kind") == "encounter") & (F.col("date") > F.lit(after)), removes=True)


def add_condition(name: str, patient_id, system: str, code: str, display: str, onset: date) -> Edit:
    """With one more condition."""
    return Edit(name, ("condition",), added={"patient_id": patient_id, "kind": "condition", "system": system, "code": code, "display": display, "date": onset, "seq": f"added-{code}"})


def add_observation(name: str, patient_id, loinc: str, display: str, value: float, unit: str, when: date) -> Edit:
    """With one more result."""
    return Edit(name, ("observation",), added={"patient_id": patient_id, "kind": "observation", "system": "LOINC", "code": loinc, "display": display, "value": float(value), "unit": unit, "date": when, "seq": f"added-{loinc}-{when}"})


def record_death(name: str, patient_id, on: date) -> Edit:
    return Edit(name, died=(patient_id, on))


def added_row(evidence: DataFrame, edit: Edit) -> DataFrame:
    """The row that an edit adds, with the columns of evidence."""
    return evidence.sparkSession.range(1).select(*[F.lit(edit.added.get(f.name)).cast(f.dataType).alias(f.name) for f in evidence.schema])


def _reached(edit: Edit, lookup: Lookup) -> bool:
    """Whether the edit can change what the lookup finds."""
    if lookup.kind not in edit.kinds:
        return False
    if edit.added and lookup.kind != "encounter":
        if lookup.codes:
            return (edit.added["system"], edit.added["code"]) in lookup.codes
        return lookup.text.casefold() in edit.added["display"].casefold()
    return True


def _added(edit: Edit, lookup: Lookup, as_of: date, kind) -> Column | None:
    """The added row as one of the lookup, null if it is after as_of or outside the window."""
    row = edit.added
    if not row or row["date"] > as_of:
        return None
    own = {"age": (as_of - row["date"]).days} | {c: row.get(c) for c in ("seq", "date", "value", "unit", "display")}
    made = F.struct(*[F.lit(own.get(f.name)).cast(f.dataType).alias(f.name) for f in kind.fields])
    counts = in_window(F.lit(row["date"]), lookup.window.relation if lookup.window else None, screening._start(lookup.window, as_of), as_of)
    return F.when((F.col("patient_id") == F.lit(row["patient_id"])) & F.coalesce(counts, F.lit(False)), made)


def versions(evidence: DataFrame, wanted: list[Lookup], as_of: date, edits: list[Edit]) -> tuple[DataFrame, list[dict[Lookup, int]]]:
    """patient_id, l0, l1, ... and touched (names of the edits that meet the chart); the place of each lookup for every edit.

    The first len(wanted) structs are those of the chart as it is.
    """
    places, extra = [], []
    for e in edits:
        place = {x: i for i, x in enumerate(wanted)}
        for x in wanted:
            if _reached(e, x):
                place[x] = len(wanted) + len(extra)
                extra.append((e, x))
        places.append(place)
    known = lambda day: F.col(day).isNull() | (F.col(day) <= F.lit(as_of))
    # rows that no edit can touch and that are outside the windows of their lookups never reach the shuffle
    may = reduce(lambda a, b: a | b, [F.coalesce(e.touches(), F.lit(False)) for e in edits if e.touches is not None], F.lit(False))
    rows = screening.with_lookups(evidence.filter(known("date") | may), wanted, keep=may).filter(may | screening._in_own_window(list(enumerate(wanted)), as_of))
    shifted = sorted({e.latest_of for e in edits if e.latest_of})
    if shifted:
        # the newest record of a code by patient; the aggregation after it needs no other shuffle
        whole = Over.partitionBy("patient_id")
        newest = F.struct(F.coalesce(-F.unix_date("date"), F.lit(2**31 - 1)), "seq")
        rows = rows.withColumns({f"newest_{i}": F.min(F.when(analyte(x), newest)).over(whole)["seq"] for i, x in enumerate(shifted)})
    touched = {}
    for k, e in enumerate(edits):
        if e.touches is not None:
            hit = F.coalesce(e.touches(), F.lit(False))
            touched[k] = hit & (F.col("seq") == F.col(f"newest_{shifted.index(e.latest_of)}")) if e.latest_of else hit
    rows = rows.withColumns({f"touched_{k}": F.coalesce(c, F.lit(False)) for k, c in touched.items()} | {f"day_{k}": F.when(touched[k], edits[k].day()).otherwise(F.col("date")) for k in touched if edits[k].day is not None})
    moved = [F.col(f"touched_{k}") for k in touched]
    used = reduce(lambda a, b: a | b, [*moved, F.lit(False)])

    struct = lambda day, value, unit: F.struct(F.coalesce(F.datediff(F.lit(as_of), day), F.lit(2**31 - 1)).alias("age"), "seq", F.col(day).alias("date"), value.alias("value"), unit.alias("unit"), "display")
    counts = lambda x, day: known(day) & in_window(F.col(day), x.window.relation if x.window else None, screening._start(x.window, as_of), as_of)
    base = [F.min(F.when((F.col("lookup") == i) & counts(x, "date"), struct("date", F.col("value"), F.col("unit")))).alias(f"l{i}") for i, x in enumerate(wanted)]
    for j, (e, x) in enumerate(extra, len(wanted)):
        k = edits.index(e)
        hit = F.col(f"touched_{k}") if k in touched else F.lit(False)
        day = f"day_{k}" if e.day is not None else "date"
        pick = lambda new, old, hit=hit: old if new is None else F.when(hit, new()).otherwise(old)
        stays = ~hit if e.removes else F.lit(True)
        base.append(F.min(F.when((F.col("lookup") == wanted.index(x)) & stays & counts(x, day), struct(day, pick(e.value, F.col("value")), pick(e.unit, F.col("unit"))))).alias(f"l{j}"))
    met = F.collect_set(F.when(used, F.array(*[F.when(F.col(f"touched_{k}"), F.lit(edits[k].name)) for k in touched]))) if touched else F.array().cast("array<array<string>>")
    out = rows.groupBy("patient_id").agg(*base, met.alias("touched"))
    return out.withColumn("touched", F.array_compact(F.array_distinct(F.flatten("touched")))), places


def edited(patients: DataFrame, evidence: DataFrame, protocol: Protocol, as_of: date, edits: list[Edit], policy: str = screening.POLICIES[0]) -> DataFrame:
    """patient_id, edit and what relations.paired gives of the screening before and after it, for every chart that the edit touches."""
    wanted = screening.lookups([protocol])
    found, places = versions(evidence, wanted, as_of, edits)
    rows = patients.join(found, "patient_id", "left")
    for j, (e, x) in enumerate([(e, x) for e in edits for x in wanted if _reached(e, x)], len(wanted)):
        if wanted and (added := _added(e, x, as_of, found.schema[f"l{j}"].dataType)) is not None:
            rows = rows.withColumn(f"l{j}", F.least(F.col(f"l{j}"), added))
    dead = screening.dead(as_of)
    before = screening._results(protocol, {x: i for i, x in enumerate(wanted)}, as_of, policy)

    def after(e: Edit, place: dict) -> Column:
        meets = F.array_contains(F.coalesce("touched", F.array().cast("array<string>")), e.name)
        gone = dead
        if e.added:
            meets = F.col("patient_id") == F.lit(e.added["patient_id"])
        if e.died:
            meets = F.col("patient_id") == F.lit(e.died[0])
            gone = dead | (meets & F.lit(e.died[1] <= as_of))
        return F.struct(F.lit(e.name).alias("edit"), meets.alias("meets"), gone.alias("dead"), screening._results(protocol, place, as_of, policy).alias("results"))

    # verdicts before are made once on the patient's row, those after once an edit
    each = rows.select("patient_id", dead.alias("dead_b"), before.alias("before"), F.explode(F.array(*[after(e, p) for e, p in zip(edits, places, strict=True)])).alias("x")).filter("x.meets")
    both = each.select("patient_id", "x.edit", "dead_b", F.col("x.dead").alias("dead_a"), F.col("before").alias("results_b"), F.col("x.results").alias("results_a"))
    for tail in ("b", "a"):
        none = F.array().cast(both.schema[f"results_{tail}"].dataType)
        rolled = screening.roll_up(both.withColumn("results", F.col(f"results_{tail}")))
        gone = F.col(f"dead_{tail}")
        both = rolled.select(
            *both.columns,
            F.when(gone, "ineligible").otherwise(F.col("decision")).alias(f"decision_{tail}"), F.when(gone, F.lit(1.0)).otherwise(F.col("coverage")).alias(f"coverage_{tail}"), gone.alias(f"blocked_{tail}"),
        ).withColumn(f"results_{tail}", F.when(gone, none).otherwise(F.col(f"results_{tail}")))
    return relations.moved(both.drop("dead_b", "dead_a"))


def suite(pairs: DataFrame, relations_of: dict[str, dict[str, Column]]) -> DataFrame:
    """patient_id, edit, relation, problem (null where it holds): each edit with the relations that are to hold under it."""
    each = [F.struct(F.lit(e).alias("edit"), F.lit(name).alias("relation"), c.cast("string").alias("problem")) for e, named in relations_of.items() for name, c in named.items()]
    found = pairs.select("patient_id", F.col("edit").alias("own"), F.explode(F.array(*each)).alias("x")).filter("own = x.edit")
    return found.select("patient_id", "x.edit", "x.relation", "x.problem")
