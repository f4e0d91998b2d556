"""Frozen keys: digests of many keys at once, what has changed since, and files against their sidecars.

A key is one document that people sign, so one row holds it; there may be any
number of keys. Its digest is that of keys.fingerprint(): canonical JSON with the
cases in order of their id, without the day it was frozen.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.functions.canonical import canonical, quoted
from screenlake.operators import keys
from screenlake.sources import corpus

STATES = ("sound", "edited", "not frozen", "gone")


def digests(cases: DataFrame, heads: tuple[str, ...] = ()) -> DataFrame:
    """key_id, cases, digest. cases: key_id, id and further fields, which all count; heads: fields of the key itself, the same in all its cases.

    Fields that are null are null in the JSON too. Cases of one id are in order of their JSON; problems() refuses them.
    """
    fields = sorted(c for c in cases.columns if c not in {"key_id", *heads})
    case = F.struct(*fields)
    kind = cases.select(case.alias("x")).schema["x"].dataType
    rows = cases.select("key_id", *heads, F.struct(F.coalesce(F.col("id").cast("string"), F.lit("None")).alias("id"), canonical(case, kind, nulls=True).alias("json")).alias("x"))
    held = rows.groupBy("key_id").agg(*[F.min(h).alias(h) for h in heads], F.array_sort(F.collect_list("x")).alias("x"))
    parts: dict[str, Column] = {h: canonical(F.col(h), cases.schema[h].dataType, nulls=True) for h in heads}
    parts["cases"] = F.concat(F.lit("["), F.array_join("x.json", ","), F.lit("]"))
    body = F.concat_ws(",", *[F.concat(quoted(F.lit(name)), F.lit(":"), parts[name]) for name in sorted(parts)])
    return held.select("key_id", F.size("x").cast("long").alias("cases"), F.sha2(F.concat(F.lit("{"), body, F.lit("}")).cast("binary"), 256).alias("digest"))


def drift(now: DataFrame, frozen: DataFrame) -> DataFrame:
    """key_id, state of every key in either: STATES. now: digests(...); frozen: the same as it was written."""
    there = frozen.select("key_id", F.col("digest").alias("was"))
    both = now.select("key_id", "digest").join(there, "key_id", "full")
    state = F.when(F.col("was").isNull(), "not frozen").when(F.col("digest").isNull(), "gone").when(F.col("digest") == F.col("was"), "sound").otherwise("edited")
    return both.select("key_id", state.alias("state"))


def freeze(spark: SparkSession, key: dict, path: str, at: str, found: DataFrame) -> str:
    """Write a key that has no problems, stamped with the time ``at``, and its digest beside it; returns the digest.

    found: keys.problems(...) of its cases; one of them and nothing is written.
    The stamp isn't in the digest, so a key that is frozen again keeps it.
    """
    first = found.orderBy("case_id", "problem").limit(1).collect()
    if first:
        raise ValueError(f"case {first[0].case_id}: {first[0].problem}")
    stamped = {**key, "frozen_at": at}
    digest = keys.fingerprint(stamped)
    corpus.write_key(spark, stamped, path, digest)
    return digest


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """path, digest, recorded, sound of every key (*.json) below a folder: whether it is still what its sidecar says.

    A file that is no JSON object has no digest; without a digest or a sidecar a
    key isn't sound. Nothing of the corpus is needed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for content in batch.column(1).to_pylist():
                try:
                    key = json.loads(content)
                except ValueError:  # not JSON, or not UTF-8
                    key = None
                out.append(keys.fingerprint(key) if isinstance(key, dict) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "digest"])

    own = files.filter(F.col("path").endswith(".json")).mapInArrow(hashed, "path string, digest string")
    told = F.try_element_at(F.split(F.trim(F.decode("content", "UTF-8")), r"\s+"), F.lit(1))
    marks = files.filter(F.col("path").endswith(".json.sha256")).select(F.regexp_replace("path", r"\.sha256$", "").alias("path"), F.nullif(told, F.lit("")).alias("recorded"))
    return own.join(marks, "path", "left").withColumn("sound", F.coalesce(F.col("digest") == F.col("recorded"), F.lit(False)))
