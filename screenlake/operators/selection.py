"""Choice of a corpus under quotas and a budget of bytes, as a greedy pass over all candidates would make it.

Each stage sorts its candidates over the parts of a range sort. A part that fits
whole is taken whole and one whose smallest row is beyond the budget is passed
over, by its count, sum and smallest size alone; only a part in which the choice
turns is walked row by row, by the task that reads it. So no candidate is left
out, and no task or driver holds them all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PICKED = "patient_id, n_bytes, score, reason"


@dataclass(frozen=True)
class Stage:
    """A reservation: rows with ``wanted`` (all, if none) until ``needed`` are chosen, by evidence a byte.

    first: only so many rows with the least evidence are tried, whatever fits.
    total: needed counts every row chosen so far. most: larger rows are passed over.
    """

    name: str
    needed: int = 0
    wanted: Callable[[], Column] | None = None
    first: int | None = None
    total: bool = False
    most: int | None = None


def _walk(budget: int, needed: int):
    """The greedy pass over sorted rows of one part."""

    def run(batches):
        import pyarrow as pa

        left, more = budget, needed
        for batch in batches:
            keep = []
            for size in batch.column(batch.schema.get_field_index("n_bytes")).to_pylist():
                fits = more > 0 and size <= left
                if fits:
                    left, more = left - size, more - 1
                keep.append(fits)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _greedy(rows: DataFrame, order: list[Column], budget: int, needed: int, path: str) -> tuple[DataFrame, int, int]:
    """The rows that a greedy pass in this order takes, with their number and bytes."""
    spark = rows.sparkSession
    rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(f"{path}/sorted")
    placed = spark.read.schema(rows.schema.simpleString()[7:-1].replace(":", " ") + ", part int").parquet(f"{path}/sorted")
    whole, walked, n, spent = [], [], 0, 0
    for s in sorted(placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("total"), F.min("n_bytes").alias("least")).collect()):  # a row a part
        if n >= needed or s.least > budget - spent:
            continue
        if s.total <= budget - spent and s.n <= needed - n:
            whole.append(s.part)
            n, spent = n + s.n, spent + s.total
            continue
        own = placed.filter(F.col("part") == s.part).coalesce(1).sortWithinPartitions(*order).mapInArrow(_walk(budget - spent, needed - n), placed.schema)
        own.write.mode("overwrite").parquet(f"{path}/walked_{s.part}")
        walked.append(f"{path}/walked_{s.part}")
        took = spark.read.schema(placed.schema).parquet(walked[-1]).agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
        n, spent = n + took[0], spent + took[1]
    out = placed.filter(F.col("part").isin(whole)) if whole else placed.limit(0)
    if walked:
        out = out.unionByName(spark.read.schema(placed.schema).parquet(*walked))
    return out.drop("part"), n, spent


def select(summaries: DataFrame, budget: int, stages: list[Stage], path: str) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """The chosen rows (columns of summaries and reason) and the quotas that can't be met (name, had, needed).

    summaries: patient_id, n_bytes, score and whatever wanted reads, one row a
    patient; rows without a size or score are no candidates. path: a folder that
    all executors share, for what each stage writes. Ties go by patient_id.
    """
    spark = summaries.sparkSession
    rows = summaries.filter("n_bytes IS NOT NULL AND score IS NOT NULL").withColumns({"n_bytes": F.col("n_bytes").cast("long"), "score": F.col("score").cast("double")})
    dense, sparse = [F.desc(F.col("score") / F.col("n_bytes")), F.col("patient_id")], [F.col("score"), F.col("n_bytes"), F.col("patient_id")]
    chosen, count, unmet = rows.limit(0).withColumn("reason", F.lit("")), 0, []
    for i, s in enumerate(stages):
        wanted = s.wanted() if s.wanted else F.lit(True)
        taken = chosen.select("patient_id")
        if s.first is not None:
            pool = rows.orderBy(*sparse).limit(s.first)
            left, order, needed, had = pool.join(taken, "patient_id", "left_anti"), sparse, s.first, 0
        else:
            had = count if s.total else chosen.filter(wanted).count()
            pool = rows.filter(wanted) if s.most is None else rows.filter(wanted & (F.col("n_bytes") <= s.most))
            left, order, needed = pool.join(taken, "patient_id", "left_anti"), dense, s.needed - had
        picked, n, spent = _greedy(left, order, budget, max(needed, 0), f"{path}/stage_{i}")
        chosen.unionByName(picked.withColumn("reason", F.lit(s.name))).write.mode("overwrite").parquet(f"{path}/chosen_{i}")
        chosen = spark.read.schema(chosen.schema).parquet(f"{path}/chosen_{i}")
        budget, count = budget - spent, count + n
        if s.first is None and not s.total and had + n < s.needed:
            unmet.append((s.name, had + n, s.needed))
    return chosen, unmet
