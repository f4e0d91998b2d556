"""Joins against what was recorded: exchanges with a model, resolved concepts, annotators' passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenlake.functions.canonical import canonical, quoted
from screenlake.functions.text import concept_key
from screenlake.plans.criteria import Protocol, concepts, with_codes

MESSAGE = "array<struct<role:string,content:string>>"


def request_key(requests: DataFrame) -> Column:
    """SHA-256 of what a request asks: model, the whole message list and the name of the schema demanded back, as canonical JSON.

    requests: model, messages (an array of structs or maps) and optionally schema.
    Who asks doesn't count.
    """
    kinds = {f.name: f.dataType for f in requests.schema}
    schema = F.coalesce(F.col("schema"), F.lit("")) if "schema" in kinds else F.lit("")
    parts = {"messages": canonical(F.col("messages"), kinds["messages"]), "model": canonical(F.col("model"), kinds["model"]), "schema": quoted(schema)}
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]), F.lit("}")), 256)


def schema_name(response_format: Column, kind: T.StructType) -> Column:
    """The name of the schema that a request demands back, else the type of its format, else nothing."""
    own = response_format["type"] if "type" in kind.names else F.lit(None).cast("string")
    if "json_schema" in kind.names:
        own = F.coalesce(response_format["json_schema"]["name"], own)
    return F.coalesce(own, F.lit(""))


def said(role: str) -> Column:
    """The first message of a role, empty if there is none."""
    return F.coalesce(F.try_element_at(F.filter("messages", lambda m: m["role"] == role), F.lit(1))["content"], F.lit(""))


def recorded(exchanges: DataFrame) -> DataFrame:
    """A tape (key, agent, model, system, user, response, usage), one row a key; of a request recorded twice the smallest response stays, with its agent.

    exchanges: agent, model, messages, response, and optionally schema and usage.
    """
    usage = F.col("usage") if "usage" in exchanges.columns else F.lit(None)
    keyed = exchanges.select(request_key(exchanges).alias("key"), F.struct("response", "agent", "model", said("system").alias("system"), said("user").alias("user"), usage.cast("struct<prompt_tokens:long,completion_tokens:long>").alias("usage")).alias("x"))
    return keyed.groupBy("key").agg(F.min("x").alias("x")).select("key", *[f"x.{c}" for c in ("agent", "model", "system", "user", "response", "usage")])


def replay(requests: DataFrame, tape: DataFrame, strict: bool = True) -> DataFrame:
    """requests with key and the recorded response; with strict, one that was not recorded fails the job and is never answered live.

    tape: as recorded makes it or corpus.read_tape reads it; the keys are those of the recording.
    """
    out = requests.withColumn("key", request_key(requests)).join(tape.select("key", "response"), "key", "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no recorded answer for this request, model "), F.coalesce("model", F.lit("null")), F.lit(", user "), F.substring(said("user"), 1, 200))).cast("string")
        out = out.withColumn("response", F.coalesce("response", missing))
    return out


def to_record(requests: DataFrame, tape: DataFrame, refresh: bool = False) -> DataFrame:
    """One row a key of the requests that a recording still has to ask: those not on the tape, or with refresh all."""
    keyed = requests.withColumn("key", request_key(requests)).dropDuplicates(["key"])
    return keyed if refresh else keyed.join(tape.select("key"), "key", "left_anti")


def prune(tape: DataFrame, used: DataFrame) -> DataFrame:
    """Exchanges whose key is used; a used key that is missing fails the job."""
    missing = used.select("key").distinct().join(tape, "key", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"used but not recorded: {[r.key for r in missing]}")
    return tape.join(used.select("key").distinct(), "key", "left_semi")


def coded(protocols: list[Protocol], store: DataFrame) -> list[Protocol]:
    """Protocols with the codes that the store (text, codes) has resolved for their concepts, spelling, case and closing punctuation aside.

    Only the concepts of the protocols reach the driver. Concepts that the store
    doesn't have, or has without codes, stay as they are; of texts with one key
    the codes are put together. Equal concepts of several protocols become one
    lookup of a screening.
    """
    texts = {c.text for p in protocols for c in concepts(p)}
    if not texts:
        return protocols
    asked = store.sparkSession.createDataFrame([(t,) for t in sorted(texts)], "asked string").withColumn("key", concept_key(F.col("asked")))
    have = store.select(concept_key(F.col("text")).alias("key"), F.explode("codes").alias("c"))
    found = have.join(F.broadcast(asked), "key").groupBy("asked").agg(F.array_sort(F.collect_set(F.struct("c.system", "c.code"))).alias("codes")).collect()  # a row a concept
    known = {r.asked: tuple((c.system, c.code) for c in r.codes) for r in found}
    return [with_codes(p, known) for p in protocols]


def store_misses(requests: DataFrame, store: DataFrame) -> DataFrame:
    """key of texts that the concept store does not have, spelling, case and closing punctuation aside."""
    have = store.select(concept_key(F.col("text")).alias("key")).distinct()
    return requests.select(concept_key(F.col("text")).alias("key")).distinct().join(have, "key", "left_anti")


def store_insert(store: DataFrame, new: DataFrame) -> DataFrame:
    """store with new rows for keys it does not have yet; what is there is never overwritten."""
    keyed = lambda df: df.withColumn("key", concept_key(F.col("text")))
    fresh = keyed(new).dropDuplicates(["key"]).join(keyed(store).select("key").distinct(), "key", "left_anti")
    return store.unionByName(fresh.drop("key"))


def adjudicate(first: DataFrame, second: DataFrame, decisions: DataFrame) -> DataFrame:
    """pair_id, first, second, label, open: the common label, else the decision; open where a pass or a decision is missing."""
    both = first.select("pair_id", F.col("label").alias("first")).join(second.select("pair_id", F.col("label").alias("second")), "pair_id", "full_outer")
    out = both.join(decisions.select("pair_id", F.col("label").alias("decided")), "pair_id", "left")
    complete = F.col("first").isNotNull() & F.col("second").isNotNull()
    label = F.when(complete, F.when(F.col("first") == F.col("second"), F.col("first")).otherwise(F.col("decided")))
    return out.withColumn("label", label).withColumn("open", F.col("label").isNull())


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """The values of a key that occur more than once, with their count."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def merge_notes(evidence: DataFrame, notes: DataFrame) -> DataFrame:
    """evidence with the notes it does not have yet by seq; merging twice changes nothing."""
    # the notes are the small side: only which of them are there comes from the evidence
    there = evidence.select("seq").join(notes.select("seq").distinct(), "seq", "left_semi").distinct()
    return evidence.unionByName(notes.join(there, "seq", "left_anti"), allowMissingColumns=True)
