"""Choice under quotas and a budget against a plain greedy pass over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from screenlake.operators.selection import Stage, select

KIND = "patient_id string, n_bytes long, score int, ill boolean, old boolean"


def plain(rows, budget, stages):
    """Rows and stages as tuples: one list, walked stage by stage."""
    chosen, unmet = {}, []
    dense = sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (-r[2] / r[1], r[0]))
    sparse = sorted(dense, key=lambda r: (r[2], r[1], r[0]))
    field = {"ill": 3, "old": 4}

    def spend(r, name):
        nonlocal budget
        if r[0] in chosen or r[1] > budget:
            return False
        chosen[r[0]] = name
        budget -= r[1]
        return True

    by_id = {r[0]: r for r in rows}
    for s in stages:
        fits = lambda r, s=s: s.name not in field or bool(r[field[s.name]])
        if s.first is not None:
            for r in sparse[: s.first]:
                spend(r, s.name)
            continue
        have = len(chosen) if s.total else sum(fits(by_id[i]) for i in chosen)
        for r in dense:
            if have >= s.needed:
                break
            if fits(r) and (s.most is None or r[1] <= s.most) and spend(r, s.name):
                have += 1
        if not s.total and have < s.needed:
            unmet.append((s.name, have, s.needed))
    return chosen, unmet


def invented(seed, n):
    r = random.Random(seed)
    return [(f"p{i:06d}", r.choice([r.randint(1, 50), r.randint(1, 5000), 90_000]), r.randint(0, 9), r.random() < 0.01, r.random() < 0.2) for i in range(n)]


def stages(ill=40, most=4000):
    return [Stage("sparse", first=5), Stage("ill", ill, lambda: F.col("ill"), most=most), Stage("old", 900, lambda: F.col("old")), Stage("fill", 2500, total=True)]


@pytest.mark.parametrize(("n", "budget"), [(10_000, 40_000), (10_000, 10**7), (3000, 900)])
def test_equals_a_plain_greedy_pass(spark, tmp_path, n, budget):
    rows = invented(n + budget, n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, unmet = select(spark.createDataFrame(rows, KIND).repartition(5), budget, stages(), str(tmp_path))
        assert ({r.patient_id: r.reason for r in got.collect()}, unmet) == plain(rows, budget, stages())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_small_row_at_the_very_end_is_found(spark, tmp_path):
    rows = [(f"p{i:03d}", 9, 9, False, False) for i in range(200)] + [("q", 1, 0, False, False), ("none", None, 3, False, False)]
    got, unmet = select(spark.createDataFrame(rows, KIND), 10, [Stage("fill", 2, total=True)], str(tmp_path))
    assert sorted(r.patient_id for r in got.collect()) == ["p000", "q"] and unmet == []


def test_quotas_that_cannot_be_met_and_an_empty_table(spark, tmp_path):
    rows = [("a", 5, 1, True, False), ("b", 50, 1, True, False)]
    got, unmet = select(spark.createDataFrame(rows, KIND), 20, [Stage("ill", 2, lambda: F.col("ill"))], str(tmp_path / "1"))
    assert [r.patient_id for r in got.collect()] == ["a"] and unmet == [("ill", 1, 2)]
    got, unmet = select(spark.createDataFrame([], KIND), 20, stages(), str(tmp_path / "2"))
    assert got.count() == 0 and unmet == [("ill", 0, 40), ("old", 0, 900)]
