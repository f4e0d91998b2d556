"""Metamorphic relations: what must hold between screenings before and after an edit.

before and after are results of screening.screen. Every relation gives
patient_id, relation and problem, null where it holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row a patient: decision, coverage, blocked and results of both runs, and the criteria that moved."""
    side = lambda df, tail: df.select("patient_id", *[F.col(c).alias(f"{c}_{tail}") for c in ("decision", "coverage", "results")], F.col("blocked_by").isNotNull().alias(f"blocked_{tail}"))
    return moved(side(before, "b").join(side(after, "a"), "patient_id"))


def moved(both: DataFrame) -> DataFrame:
    """Adds the verdicts of both runs by criterion (b, a) and the criteria whose verdict moved, to rows with results_b and results_a."""
    verdicts = lambda c: F.map_from_entries(F.transform(c, lambda r: F.struct(r["criterion_id"], r["verdict"])))
    both = both.withColumn("b", verdicts("results_b")).withColumn("a", verdicts("results_a"))
    ids = F.array_sort(F.array_union(F.map_keys("b"), F.map_keys("a")))
    differs = lambda i: ~F.try_element_at("b", i).eqNullSafe(F.try_element_at("a", i)) | (F.map_contains_key("b", i) != F.map_contains_key("a", i))
    return both.withColumn("moved", F.filter(ids, differs))


def _both(criterion_id: str) -> tuple[Column, Column, Column]:
    i = F.lit(criterion_id)
    return F.try_element_at("b", i), F.try_element_at("a", i), F.map_contains_key("b", i) & F.map_contains_key("a", i)


def becomes_unknown(criterion_id: str) -> Column:
    was, now, there = _both(criterion_id)
    return F.when(~there, f"{criterion_id} is not among the criteria screened").when(was.isNull(), f"{criterion_id} was already unknown").when(now.isNotNull(), f"{criterion_id} is still decided")


def flips(criterion_id: str) -> Column:
    was, now, there = _both(criterion_id)
    return F.when(~there, f"{criterion_id} is not among the criteria screened").when(was.isNull() | now.isNull(), f"{criterion_id} is not decided on both sides").when(was == now, f"{criterion_id} stayed as it was")


def nothing_moves() -> Column:
    return F.when(F.size("moved") > 0, F.concat(F.lit("verdicts moved: "), F.array_join("moved", ", ")))


def only_moves(criterion_id: str) -> Column:
    others = F.array_remove("moved", F.lit(criterion_id))
    return F.when(F.size(others) > 0, F.concat(F.lit("other verdicts moved: "), F.array_join(others, ", "))).when(F.size("moved") == 0, f"{criterion_id} stayed as it was")


def coverage_holds() -> Column:
    return F.when(F.col("coverage_a") < F.col("coverage_b"), "coverage fell")


def outcome_holds() -> Column:
    return F.when(F.col("decision_a") != F.col("decision_b"), F.concat(F.lit("the decision moved from "), F.col("decision_b"), F.lit(" to "), F.col("decision_a")))


def blocked(before: bool, after: bool) -> Column:
    def side(tail: str, name: str, expected: bool) -> Column:
        is_blocked, n = F.col(f"blocked_{tail}"), F.size(f"results_{tail}")
        wrong = F.when(is_blocked != F.lit(expected), f"the {name} run was {'evaluated' if expected else 'blocked'}")
        if expected:
            return wrong.when(n > 0, f"the {name} run was blocked but has criteria").when(F.col(f"decision_{tail}") != "ineligible", f"the {name} run was blocked but not ineligible")
        return wrong.when(n == 0, f"the {name} run has no criteria")

    return all_hold(side("b", "first", before), side("a", "second", after))


def all_hold(*relations: Column) -> Column:
    """Every failure is told, not just the first."""
    found = F.array_compact(F.array(*relations))
    return F.when(F.size(found) > 0, F.array_join(found, "; "))


def check(pairs: DataFrame, relations: dict[str, Column]) -> DataFrame:
    """patient_id, relation, problem for each of the relations, from one row a patient."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("relation"), r.cast("string").alias("problem")) for name, r in relations.items()]))
    return pairs.select("patient_id", each.alias("x")).select("patient_id", "x.relation", "x.problem")


def chain(evidence: DataFrame, *edits) -> DataFrame:
    """Several edits of a chart, one after the other."""
    return reduce(lambda df, edit: edit(df), edits, evidence)
