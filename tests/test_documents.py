"""Exact intervals, the document of an evaluation, frozen keys."""

import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from screenlake.functions.stats import clopper_pearson
from screenlake.operators import key_files, keys, report
from screenlake.plans import documents

SCORES = "arm string, case_id string, expected string, trap string, provenance string, decision string, forced_decision string, criteria_coverage double"


def at_most(k, n, p):
    if not 0 < p < 1:
        return float(p <= 0)
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def test_intervals_are_exact_for_few_and_many_cases(spark):
    pairs = [(0, 0), (0, 5), (5, 5), (1, 2), (3, 20), (20, 21), (7, 51), (905, 1500), (1, 40_000), (20_000, 40_000), (39_999, 40_000)]
    rows = spark.createDataFrame(pairs, "k long, n long").withColumn("i", clopper_pearson(F.col("k"), F.col("n"))).collect()
    for r in rows:
        k, n, (low, high) = r.k, r.n, r.i
        assert low == 0 if k == 0 else at_most(k - 1, n, low) == pytest.approx(0.975, abs=1e-8)
        assert high == 1 if k == n else at_most(k, n, high) == pytest.approx(0.025, abs=1e-8)
    big = spark.range(1).select(clopper_pearson(F.lit(3_000_000), F.lit(10_000_000)).alias("i")).first().i
    assert big.high - big.low == pytest.approx(2 * 1.959964 * math.sqrt(0.3 * 0.7 / 1e7), rel=1e-3)


def scores_of(spark):
    rows = [("mine", "a", "eligible", "unit", "recorded", "eligible", "eligible", 1.0), ("mine", "b", "ineligible", "none", "recorded", "needs_review", "eligible", 0.5), ("always_eligible", "a", "eligible", "unit", "recorded", "eligible", "eligible", 1.0), ("always_eligible", "b", "ineligible", "none", "recorded", "eligible", "eligible", 1.0)]
    return spark.createDataFrame(rows, SCORES)


def test_a_written_document(spark, tmp_path):
    scores = scores_of(spark)
    failed = spark.createDataFrame([], "arm string, case_id string, stage string")
    blockers = spark.createDataFrame([("T", "INC-01", 1, 2, "a | b\n c", None, 1, 3)], "nct_id string, criterion_id string, n long, screenings long, quote string, missing string, place int, others long")
    costs = spark.createDataFrame([("mine", 1.5)], "arm string, usd double")
    there = scores.withColumn("expected", F.when(F.col("case_id") == "a", "ineligible").otherwise(F.col("expected")))
    report.write(report.document(scores, failed, "mine", "f" * 64, 2, blockers, there, costs=costs), str(tmp_path / "doc"))
    text = "\n".join(x for p in sorted((tmp_path / "doc").glob("part-*")) for x in p.read_text().splitlines())
    assert text.startswith("# Results\n\nAnswer key: **2 cases**, digest `ffffffffffffffff…`.\n\n## Headline\n\n`mine` decided **50%** of 2 cases without a reader, with 0 unsafe errors.\n\nHalf of")
    assert "\n## Every arm\n\n| Arm | Cases | Accuracy | Balanced | 95% CI | Coverage | Unsafe errors | False abstention | Coverage at 0 unsafe | Cost |\n|---|---:|---:|---:|---|---:|---:|---:|---:|---:|\n" in text
    assert "| `mine` | 2 | 50% | 50% | 1%–99% | 50% | 0 | 50% | 50% | $1.50 |\n| `always_eligible` | 2 | 50% | 50% | 1%–99% | 100% | 1 | 0% | 0% | — |\n" in text
    assert "| T | `INC-01` | 1 of 2 | a \\| b c | — |\n\n3 more criteria blocked fewer screenings.\n" in text
    assert "| `eligible` | 1 | 1/1 | 1/1 |\n| `ineligible` | 1 | 0/1 | 0/1 |\n" in text
    assert "| `mine` | 50% | 0% | 0 | 1 |\n" in text and "\nUnsafe under one key only: `mine`.\n" in text
    assert "| 0.00 | 100% | 50% | 1 | 2 |\n| 0.50 | 100% | 50% | 1 | 2 |\n| 1.00 | 50% | 0% | 0 | 1 |\n" in text
    assert text.endswith("## Cases that failed to run\n\nNo case failed to run in any arm.\n") or text.endswith("No case failed to run in any arm.")


def test_sections_without_rows_are_left_out(spark):
    empty = spark.createDataFrame([], SCORES)
    failed = spark.createDataFrame([("mine", "b", "screen"), ("mine", "a", "screen")], "arm string, case_id string, stage string")
    lines = [r.line for r in report.document(empty, failed, "mine", "0" * 64, 0).orderBy(*report.LINES).collect()]
    assert [x for x in lines if x.startswith("#")] == ["# Results", "## Headline", "## Cases that failed to run"]
    assert lines[-2:] == ["- `mine`: `a` at screen", "- `mine`: `b` at screen"]


def test_digests_are_those_of_fingerprint(spark):
    rows = [(1, "b", "eligible", None, 1, "ünd"), (1, "a", "ineligible", 'a "b"\n', 1, "ünd"), (2, "c", "eligible", "x", 2, None)]
    cases = spark.createDataFrame(rows, "key_id long, id string, expected string, rationale string, version int, notes string").repartition(3)
    got = {r.key_id: (r.cases, r.digest) for r in key_files.digests(cases, ("version", "notes")).collect()}
    for k in (1, 2):
        own = [r for r in rows if r[0] == k]
        key = {"version": own[0][4], "notes": own[0][5], "frozen_at": "later", "cases": [dict(zip(("id", "expected", "rationale"), r[1:4], strict=True)) for r in own]}
        assert got[k] == (len(own), keys.fingerprint(key))


def test_frozen_files(spark, tmp_path):
    sound = spark.createDataFrame([], "case_id string, problem string")
    key = {"version": 1, "cases": [{"id": "b"}, {"id": "a"}]}
    at = lambda name: str(tmp_path / "keys" / name)
    first = key_files.freeze(spark, key, at("one.json"), "2026-01-01T00:00:00+00:00", sound)
    again = key_files.freeze(spark, {**key, "cases": key["cases"][::-1]}, at("two.json"), "2026-02-01T00:00:00+00:00", sound)
    assert first == again == keys.fingerprint(key)
    for name, text in (("three.json", None), ("four.json", "[1]"), ("five.json", "no json")):
        key_files.freeze(spark, key, at(name), "2026-01-01T00:00:00+00:00", sound)
        Path(at(name)).write_text(text or Path(at(name)).read_text().replace('"a"', '"x"'))
    Path(at("six.json")).write_text(json.dumps(key))
    for crc in (tmp_path / "keys").glob(".*.crc"):
        crc.unlink()
    got = {r.path.rsplit("/", 1)[-1]: (r.sound, r.digest is not None, r.recorded is not None) for r in key_files.verify(spark, str(tmp_path / "keys")).collect()}
    assert got == {"one.json": (True, True, True), "two.json": (True, True, True), "three.json": (False, True, True), "four.json": (False, False, True), "five.json": (False, False, True), "six.json": (False, True, False)}
    with pytest.raises(ValueError, match="case a: rationale is blank"):
        key_files.freeze(spark, key, at("seven.json"), "2026-01-01T00:00:00+00:00", spark.createDataFrame([("a", "rationale is blank")], "case_id string, problem string"))
    assert not Path(at("seven.json")).exists()


def test_drift_has_every_state(spark):
    assert {r.state for r in documents.drift(spark, "/root/testdata/sf0.01").collect()} == set(key_files.STATES)
