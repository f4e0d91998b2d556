"""All arms of an evaluation from one shared screening, committed an arm at a time.

Arms that screen are configurations (the criteria as compiled for the arm, and a
policy) over the same patient row: their lookups are looked up together, once.
That table is written first, then each arm's scores and failures, each under a
passing name that is renamed when it is whole. A run that stops goes on with the
arms that aren't committed, and finds the shared table if it got that far.
"""

from __future__ import annotations

import hashlib
import random
import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlake.operators import arms, screening
from screenlake.plans.criteria import Protocol

OUTCOMES = ("eligible", "ineligible", "needs_review")
SCORES = "arm string, case_id string, expected string, trap string, provenance string, decision string, forced_decision string, criteria_coverage double"
FAILURES = "arm string, case_id string, stage string"


@dataclass(frozen=True)
class Arm:
    """One arm: protocols and a policy, or one fixed outcome, or a seed of random outcomes."""

    name: str
    protocols: tuple[Protocol, ...] = ()
    policy: str = screening.POLICIES[0]
    outcome: str | None = None
    seed: int | None = None


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def commit(df: DataFrame, path: str) -> DataFrame:
    """Write df at path as a whole or not at all, unless it is there, and read it."""
    spark = df.sparkSession
    if not committed(spark, path):
        passing = f"{path}.{uuid.uuid4().hex}.tmp"
        df.write.parquet(passing)
        files, at = _files(spark, path)
        files.rename(_files(spark, passing)[1], at)
    return spark.read.schema(df.schema).parquet(path)


def screen_arms(patients: DataFrame, evidence: DataFrame, chosen: list[Arm], as_of: date) -> DataFrame:
    """arm, nct_id, patient_id, decision, forced_decision, coverage of every arm that screens: one lookup of the evidence for all."""
    pairs = [(a, p) for a in chosen for p in a.protocols]
    rows, place = screening.looked_up(patients, evidence, list(dict.fromkeys(p for _, p in pairs)), as_of)
    # an array of each distinct configuration; arms that share one share its columns
    one = lambda a, p: F.struct(F.lit(a.name).alias("arm"), F.lit(p.nct_id).alias("nct_id"), screening._results(p, place, as_of, a.policy).alias("results"))
    results = rows.select("patient_id", F.explode(F.array(*[one(a, p) for a, p in pairs])).alias("x")).select("x.arm", "x.nct_id", "patient_id", "x.results")
    names = F.explode(F.array(*[F.struct(F.lit(a.name).alias("arm"), F.lit(p.nct_id).alias("nct_id")) for a, p in pairs]))
    gone = patients.filter(screening.dead(as_of)).select("patient_id", names.alias("x")).select("x.arm", "x.nct_id", "patient_id")
    return screening.with_the_dead(screening.roll_up(results), gone).select("arm", "nct_id", "patient_id", "decision", "forced_decision", "coverage")


def seeded(cases: DataFrame, seed: int, order: list[str]) -> DataFrame:
    """cases with a random outcome, as one generator that goes through them in this order draws it.

    Cases are numbered over the parts of a range sort. The driver walks the
    generator to the first case of each part and hands over its state there.
    """
    spark = cases.sparkSession
    placed = cases.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    sizes = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}  # a row a part
    draw, states = random.Random(seed), {}
    for part in sorted(sizes):
        states[part] = draw.getstate()
        for _ in range(sizes[part]):
            draw.choice(OUTCOMES)
    shared = spark.sparkContext.broadcast(states)

    def drawn(batches):
        import pyarrow as pa

        own = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if own is None:
                own = random.Random()
                own.setstate(shared.value[batch.column(batch.schema.get_field_index("part"))[0].as_py()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.choice(OUTCOMES) for _ in range(batch.num_rows)])], names=[*batch.schema.names, "decision"])

    schema = T.StructType([*placed.schema.fields, T.StructField("decision", T.StringType())])
    return placed.mapInArrow(drawn, schema).drop("part")


def run(cases: DataFrame, patients: DataFrame, evidence: DataFrame, chosen: list[Arm], as_of: date, path: str) -> DataFrame:
    """Scores (SCORES) of all arms over all cases; failures are read by failures(). Arms that are committed below path are not run again.

    cases: case_id, nct_id, patient_id, expected, trap, provenance. A changed
    list of arms or criteria gets a shared table of its own; an arm that is
    committed stays, so give another path for other configurations or cases.
    """
    spark = cases.sparkSession
    names = [a.name for a in chosen]
    if len(set(names)) != len(names):
        raise ValueError("arms must have names of their own")
    open_arms = [a for a in chosen if not (committed(spark, f"{path}/scores/{a.name}") and committed(spark, f"{path}/failures/{a.name}"))]
    reading = [a for a in chosen if a.protocols]
    if any(a.protocols for a in open_arms):
        tag = hashlib.sha256(repr((as_of, reading)).encode()).hexdigest()[:16]
        shared = commit(screen_arms(patients, evidence, reading, as_of), f"{path}/screenings-{tag}")
    for a in open_arms:
        if a.protocols:
            scores, failed = arms.screened(cases, shared.filter(F.col("arm") == a.name).drop("arm"), a.name)
        elif a.seed is not None:
            scores = arms.recorded(cases, seeded(cases, a.seed, ["case_id"]).select("case_id", "decision"), a.name)
            failed = spark.createDataFrame([], FAILURES)
        else:
            scores, failed = arms.answered(cases, F.lit(a.outcome), a.name), spark.createDataFrame([], FAILURES)
        # failures first: an arm counts as done when its scores are there too
        commit(failed, f"{path}/failures/{a.name}")
        commit(scores.select(*[c.split()[0] for c in SCORES.split(", ")]), f"{path}/scores/{a.name}")
    return _read(spark, path, "scores", names, SCORES)


def _read(spark: SparkSession, path: str, kind: str, names: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{kind}/{n}" for n in names])


def failures(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """arm, case_id, stage of cases that an arm could not answer."""
    return _read(spark, path, "failures", names, FAILURES)
