"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm.common import SharedTables


def components(edges: DataFrame, store: SharedTables, name: str) -> DataFrame:
    """id, component (smallest id reachable) for every id in edges (a, b).

    Each round takes the smallest label among the neighbours and then that
    label's own label, so long chains halve. Labels and links stay in shared
    tables; a hub with many links only meets its partial minima.
    """
    both = store.write(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{name}_links")
    labels = store.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), f"{name}_0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        met = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("best"))
        jump = labels.select(F.col("id").alias("best"), F.col("component").alias("far"))
        new = store.write(met.join(jump, "best").select("id", F.col("component").alias("old"), F.least("best", "far").alias("component")), f"{name}_{step}")
        done = new.filter("old <> component").limit(1).count() == 0
        store.drop(f"{name}_{step - 1}")
        labels = new.select("id", "component")
        if done:
            return labels
