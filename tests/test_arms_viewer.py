"""The evaluation over all arms that goes on after a stop, the seeded arm, and the viewer's bundle."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from screenlake.operators import arms, evaluation_run, packets, screening
from screenlake.operators.evaluation_run import Arm
from screenlake.plans import catalog
from screenlake.plans.catalog import AS_OF, PROTOCOL, SECOND
from screenlake.plans.criteria import Protocol
from screenlake.plans.packets import THIRD
from screenlake.sources import viewer

SF = "/root/testdata/sf0.001"
BARE = Protocol("NCT-A", PROTOCOL.criteria[:2])
CHOSEN = [Arm("main", (PROTOCOL, SECOND)), Arm("open world", (PROTOCOL, SECOND), "open_world"), Arm("bare", (BARE, SECOND)), Arm("always_eligible", outcome="eligible"), Arm("random", seed=20260601)]


def cases_of(spark):
    people = catalog.patients(spark, SF).select("patient_id").union(spark.createDataFrame([(10**9,)], "patient_id long"))
    each = people.withColumn("nct_id", F.explode(F.array(F.lit("NCT-A"), F.lit("NCT-B"))))
    return each.select(F.concat_ws("-", "nct_id", F.lpad(F.col("patient_id").cast("string"), 12, "0")).alias("case_id"), "nct_id", "patient_id", F.expr("if(patient_id % 5 = 0, 'eligible', 'ineligible')").alias("expected"), F.lit("none").alias("trap"), F.lit("recorded").alias("provenance"))


def test_a_run_that_stops_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    people, evidence = catalog.tables(spark, SF)
    cases = cases_of(spark)
    whole = sorted(map(tuple, arms.report(evaluation_run.run(cases, people, evidence, CHOSEN, AS_OF, str(tmp_path / "whole"))).collect()))

    commit, done = evaluation_run.commit, []

    def stopping(df, path):
        if "/scores/" in path and len(done) == 3:
            raise KeyboardInterrupt
        done.extend([path] if "/scores/" in path else [])
        return commit(df, path)

    monkeypatch.setattr(evaluation_run, "commit", stopping)
    with pytest.raises(KeyboardInterrupt):
        evaluation_run.run(cases, people, evidence, CHOSEN, AS_OF, str(tmp_path / "cut"))
    assert len(list((tmp_path / "cut" / "scores").iterdir())) == 3
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cut").rglob("*.parquet")}

    monkeypatch.setattr(evaluation_run, "commit", commit)
    again = sorted(map(tuple, arms.report(evaluation_run.run(cases, people, evidence, CHOSEN, AS_OF, str(tmp_path / "cut"))).collect()))
    assert again == whole
    assert all(p.stat().st_mtime_ns == t for p, t in before.items()) and len(list((tmp_path / "cut").glob("screenings-*"))) == 1
    lost = evaluation_run.failures(spark, str(tmp_path / "cut"), [a.name for a in CHOSEN]).collect()
    assert {(r.arm, r.case_id.endswith("1000000000"), r.stage) for r in lost} == {(a, True, "screen") for a in ("main", "open world", "bare")}


def test_arms_of_one_screening_equal_screenings_of_their_own(spark):
    people, evidence = catalog.tables(spark, SF)
    got = evaluation_run.screen_arms(people, evidence, [a for a in CHOSEN if a.protocols], AS_OF)
    for a in CHOSEN[:3]:
        for p in a.protocols:
            alone = screening.screen(people, evidence, p, AS_OF, a.policy).select("patient_id", "decision", "forced_decision", "coverage")
            mine = got.filter((F.col("arm") == a.name) & (F.col("nct_id") == p.nct_id)).select(*alone.columns)
            assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, alone.collect()))


def test_a_seeded_arm_draws_as_one_sequential_run(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = evaluation_run.seeded(spark.createDataFrame([(f"{i:05d}",) for i in range(500)], "case_id string").repartition(7), 20260601, ["case_id"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    one = random.Random(20260601)
    assert [r.decision for r in sorted(rows)] == [one.choice(evaluation_run.OUTCOMES) for _ in range(500)]


def test_the_bundle_is_named_files_and_an_index(spark, tmp_path):
    people, evidence = catalog.tables(spark, SF)
    docs = packets.packets(people, evidence, [THIRD, SECOND], AS_OF, titles={"NCT-C": "Third"}, fingerprints={"NCT-C": "ab"})
    schemas = {"screening": "s/1", "trial": "t/1", "index": "i/1"}
    path = Path(tmp_path / "data")
    path.mkdir()
    (path / "stale.json").write_text("old")
    n = viewer.write_bundle(docs, [THIRD, SECOND], f"file://{path}", schemas, {"NCT-C": "Third"}, {"NCT-C": "ab"})
    assert n == docs.count() and [p.name for p in tmp_path.iterdir()] == ["data"]  # nothing passing is left
    index = json.loads((path / viewer.INDEX).read_text())
    files = {p.name for p in path.iterdir() if not p.name.endswith(".crc")}
    assert files == {e["file"] for e in index["screenings"]} | {e["file"] for e in index["trials"]} | {viewer.INDEX} and len(index["screenings"]) == n
    assert [(e["nct_id"], e["patient_id"]) for e in index["screenings"]] == sorted((e["nct_id"], e["patient_id"]) for e in index["screenings"])
    by = {(r.nct_id, r.patient_id): r for r in docs.collect()}
    for e in index["screenings"]:
        d, r = json.loads((path / e["file"]).read_text()), by[e["nct_id"], e["patient_id"]]
        assert d["schema"] == "s/1" and d["decision"] == r.decision == e["decision"] and [c["criterion_id"] for c in d["criteria"]] == [x.criterion_id for x in r.rows]
        assert e["open_items"] == e["open_retrievable"] + e["open_needing_a_person"] == len(d["open_items"]) and e["at_visit"] == len(d["at_visit"]) and d["blocked_by"] == r.blocked_by
    t = json.loads((path / "NCT-C.trial.json").read_text())
    assert t["counts"] == {"criteria": 5, "inclusion": 3, "exclusion": 2, "unsupported": 1, "unsupported_blocking": 0, "unsupported_at_visit": 1} and index["trials"][0]["unsupported"] == 1
    # the same rows give the same bytes
    first = {p.name: p.read_bytes() for p in path.iterdir()}
    viewer.write_bundle(docs, [THIRD, SECOND], f"file://{path}", schemas, {"NCT-C": "Third"}, {"NCT-C": "ab"})
    assert {p.name: p.read_bytes() for p in path.iterdir()} == first


def test_names_that_a_path_cannot_hold(spark):
    rows = spark.createDataFrame([("N", "a/../b"), ("N", "a_.._b"), ("N", "plain")], "n string, p string")
    names = [r[0] for r in rows.select(viewer.screening_file(F.col("n"), F.col("p"))).collect()]
    assert names[1:] == ["N--a_.._b.json", "N--plain.json"] and "/" not in names[0] and names[0].startswith("N--a_.._b-")
