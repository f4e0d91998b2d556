"""Charts from a stream of evidence: the latest rows and open screenings kept up to date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from screenlake.operators.screening import latest, lookups, screen
from screenlake.plans.criteria import Protocol


def latest_stream(evidence: DataFrame, protocol: Protocol, as_of: date) -> DataFrame:
    """The latest row of each lookup of a protocol, by patient, over streamed evidence.

    The state is one row for each patient and does not grow with the evidence;
    write it in update mode.
    """
    return latest(evidence, lookups([protocol]), as_of)


def screen_batches(arrivals: DataFrame, patients: DataFrame, charts: DataFrame, protocol: Protocol, as_of: date, sink: str) -> DataStreamWriter:
    """Screens the patients of each micro-batch again, over all of their chart, into a Parquet table by batch.

    arrivals streams evidence that charts has too. A batch that runs again
    overwrites its own folder, so every batch counts once.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("patient_id").distinct()
        own = charts.join(touched, "patient_id", "left_semi")
        screen(patients.join(touched, "patient_id", "left_semi"), own, protocol, as_of).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return arrivals.writeStream.foreachBatch(one)
