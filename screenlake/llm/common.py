"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SharedTables:
    """Intermediate tables in the folder that spark.checkpoint.dir names.

    Writing a table cuts the lineage, so a lost executor repeats one step and
    not the whole job. A session on one machine without that setting (tests)
    gets a temporary folder; on a cluster the setting is needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='screenlake-')}"
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that the text operators read, under fixed names."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def bound_batches(spark: SparkSession, most_bytes: int = 16 << 20) -> None:
    """Arrow batches that go to Python take so many bytes at most, unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece take a few megabytes; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, most_bytes: int = 4_000_000, column: str = "text") -> DataFrame:
    """Apply fn to pieces of bounded size; fn gives arrays by column name."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    bound_batches(df.sparkSession)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(fields)
        for batch in pieces(batches, most_bytes, column):
            made = fn(batch)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := made[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) for f in out], schema=out)
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return df.mapInArrow(run, fields)


def lookup(rows: DataFrame, unique: DataFrame, on: list[str], counts: DataFrame, total: int, how: str = "inner", share: int = 256, least: int = 10_000) -> DataFrame:
    """Join rows with a table that has one row a key, when many rows may share a key.

    counts has the number n of rows of each key. Keys with over ``least`` rows and
    over total/share of all rows, so fewer than share of them, are looked up by
    broadcast, and only the rest is shuffled by key.
    """
    hot = counts.filter(F.col("n") > max(total // share, least)).select(*on)
    if not hot.count():
        return rows.join(unique, on, how)
    best = F.broadcast(unique.join(F.broadcast(hot), on))
    cold = rows.join(best, on, "left_anti").join(unique, on, how)
    return rows.join(best, on).unionByName(cold)
