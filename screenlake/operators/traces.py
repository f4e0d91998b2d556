"""Traces of model calls: steps of several shapes as JSON lines, totals, and Markdown for a reader.

steps: trace, step (from 1), timestamp, agent, provider, model, system_prompt,
user_prompt, attempts (array), skipped_tiers (array of tier and reason) and
parsed (a VARIANT, as every agent answers in a shape of its own). What a step
cost, which tier answered and how often it was asked again follow from its
attempts. Markdown comes as pieces in order, so no task holds a whole trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_USAGE = "struct<prompt_tokens:long,completion_tokens:long>"
ATTEMPT = f"struct<tier:string,messages:array<struct<role:string,content:string>>,raw_response:string,usage:{_USAGE},usd:double,validation_error:string,error:string>"
STEP = f"trace string, step int, timestamp string, agent string, provider string, model string, system_prompt string, user_prompt string, attempts array<{ATTEMPT}>, skipped_tiers array<array<string>>, parsed variant"
FIELDS = ("trace", "step", "timestamp", "agent", "provider", "model", "system_prompt", "user_prompt", "attempts", "skipped_tiers", "parsed")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Steps from JSON lines; blank lines are left out and a line that isn't a step fails the job."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    found = F.from_json("value", STEP, {"mode": "FAILFAST"})
    return lines.select(found.alias("s")).select("s.*")


def write(steps: DataFrame, path: str) -> None:
    """One JSON object a line, traces and steps in order over all files, with what follows from the attempts beside them."""
    derived = summed(steps).withColumns({"raw_response": F.element_at("attempts", -1)["raw_response"], "validation_errors": F.array_compact(F.transform("attempts", lambda a: a["validation_error"]))})
    rows = derived.select("trace", "step", F.to_json(F.struct(*derived.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.repartitionByRange("trace", "step").sortWithinPartitions("trace", "step").select("value").write.mode("overwrite").text(path)


def _fine(a: Column) -> Column:
    return a["validation_error"].isNull() & a["error"].isNull()


def summed(steps: DataFrame) -> DataFrame:
    """steps with tier (the one that answered, else the last tried), retries, usage, usd (null if no attempt has a price) and validated."""
    attempts = F.coalesce("attempts", F.array().cast(f"array<{ATTEMPT}>"))
    rows = steps.withColumn("attempts", attempts)
    total = lambda get: F.aggregate("attempts", F.lit(0).cast("long"), lambda t, a: t + F.coalesce(get(a), F.lit(0)))
    priced = F.array_compact(F.transform("attempts", lambda a: a["usd"]))
    answered = F.try_element_at(F.filter("attempts", _fine), F.lit(1))["tier"]
    return rows.withColumns({
        "tier": F.coalesce(answered, F.try_element_at("attempts", F.lit(-1))["tier"]),
        "retries": F.greatest(F.size("attempts") - 1, F.lit(0)),
        "usage": F.struct(total(lambda a: a["usage"]["prompt_tokens"]).alias("prompt_tokens"), total(lambda a: a["usage"]["completion_tokens"]).alias("completion_tokens")),
        "usd": F.when(F.size(priced) > 0, F.aggregate(priced, F.lit(0.0), lambda t, x: t + x)),
        "validated": F.exists("attempts", _fine),
    })


def ledger(steps: DataFrame, by: str, *more: str) -> DataFrame:
    """by (agent or model) and more, calls, priced, prompt_tokens, completion_tokens, usd (null if no call has a price)."""
    return summed(steps).groupBy(*more, by).agg(F.count("*").alias("calls"), F.count("usd").alias("priced"), F.sum("usage.prompt_tokens").alias("prompt_tokens"), F.sum("usage.completion_tokens").alias("completion_tokens"), F.sum("usd").alias("usd"))


def money(usd: Column) -> Column:
    return F.when(usd.isNull(), "unpriced").otherwise(F.format_string("$%.4f", usd))


def fenced(text: Column, language: str = "") -> Column:
    """Text in a fence that is longer than any run of backticks within."""
    runs = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda x: F.length(x)))
    fence = F.repeat(F.lit("`"), F.greatest(F.coalesce(runs + 1, F.lit(3)), F.lit(3)))
    return F.concat(fence, F.lit(f"{language}\n"), text, F.lit("\n"), fence)


def overview(steps: DataFrame) -> DataFrame:
    """trace, step, text: a row of the table that leads a trace."""
    s = lambda c: F.col(c).cast("string")
    tokens = (F.col("usage.prompt_tokens") + F.col("usage.completion_tokens")).cast("string")
    cells = [s("step"), s("agent"), F.concat_ws("/", "provider", "model"), F.concat(F.lit("`"), F.coalesce("tier", F.lit("None")), F.lit("`")), s("retries"), tokens, money(F.col("usd")), F.when(F.col("validated"), "validated").otherwise("failed")]
    return summed(steps).select("trace", "step", F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |")).alias("text"))


def _attempts() -> Column:
    """The attempts of a step: what was sent in addition, what came back, and whether it held."""
    def one(a: Column, i: Column) -> Column:
        before = F.col("attempts")[i - 1]
        size = F.size(before["messages"])
        goes_on = F.slice(a["messages"], 1, size) == before["messages"]
        added = F.when(goes_on, F.slice(a["messages"], size + 1, F.greatest(F.size(a["messages"]) - size, F.lit(0)))).otherwise(a["messages"])
        shown = F.array_join(F.transform(added, lambda m: F.concat(F.lit("["), F.coalesce(m["role"], F.lit("?")), F.lit("]\n"), F.coalesce(m["content"], F.lit("")))), "\n\n")
        label = F.when(a["tier"] == before["tier"], "Sent back to the model:\n\n").otherwise("Restarted with:\n\n")
        verdict = F.when(a["validation_error"].isNotNull(), F.concat(F.lit("The response did not validate:\n\n"), fenced(a["validation_error"]))).when(a["error"].isNull(), F.lit("Validated against the schema."))
        parts = [
            F.concat(F.lit("### Attempt "), (i + 1).cast("string"), F.lit(", tier `"), a["tier"], F.lit("`")),
            F.when((i > 0) & (F.size(added) > 0), F.concat(label, fenced(shown))),
            F.concat(F.lit("The provider rejected the request:\n\n"), fenced(a["error"])),
            F.concat(F.lit("Response:\n\n"), fenced(a["raw_response"])),
            verdict,
        ]
        return F.array_join(F.array_compact(F.array(*parts)), "\n\n")

    return F.when(F.size("attempts") > 0, F.array_join(F.transform("attempts", one), "\n\n"))


def markdown(steps: DataFrame) -> DataFrame:
    """trace, section, step, text: the pieces of each trace for a reader, in the order of section and step."""
    rows = summed(steps)
    s = lambda c: F.col(c).cast("string")
    heads = rows.groupBy("trace").agg(F.count("*").alias("calls"), F.sum("usage.prompt_tokens").alias("p"), F.sum("usage.completion_tokens").alias("c"), F.sum("usd").alias("usd"))
    headline = F.concat(F.lit("# Trajectory\n\n**Calls:** "), s("calls"), F.lit(" | **Prompt tokens:** "), s("p"), F.lit(" | **Completion tokens:** "), s("c"), F.lit(" | **Estimated cost:** "), money(F.col("usd")))
    table = F.lit("\n\n| # | Agent | Model | Tier | Retries | Tokens | Cost | Outcome |\n|---|---|---|---|---:|---:|---:|---|")
    title = F.concat(F.lit("## "), s("step"), F.lit(". "), F.col("agent"), F.lit(" on "), F.concat_ws("/", "provider", "model"))
    facts = F.array_join(F.array(
        F.concat(F.lit("- **Started:** "), F.col("timestamp")), F.concat(F.lit("- **Tier used:** `"), F.coalesce("tier", F.lit("None")), F.lit("`")), F.concat(F.lit("- **Retries:** "), s("retries")),
        F.concat(F.lit("- **Tokens:** "), s("usage.prompt_tokens"), F.lit(" in / "), s("usage.completion_tokens"), F.lit(" out")), F.concat(F.lit("- **Estimated cost:** "), money(F.col("usd"))),
        F.concat(F.lit("- **Outcome:** "), F.when(F.col("validated"), "validated").otherwise("no valid response")),
    ), "\n")
    skipped = F.when(F.size("skipped_tiers") > 0, F.array_join(F.transform("skipped_tiers", lambda t: F.concat(F.lit("### Tier `"), t[0], F.lit("` not attempted\n\n"), t[1])), "\n\n"))
    result = F.concat(F.lit("### Result\n\n"), fenced(F.nullif(F.to_json("parsed"), F.lit("null")), "json"))
    body = F.array_join(F.array_compact(F.array(title, facts, F.concat(F.lit("### Instructions\n\n"), fenced(F.col("system_prompt"))), F.concat(F.lit("### Request\n\n"), fenced(F.col("user_prompt"))), skipped, _attempts(), result)), "\n\n")
    costs = None
    for i, by in enumerate(("agent", "model")):
        lines = ledger(steps, by, "trace").select("trace", F.struct(by, F.concat(F.lit("| "), F.array_join(F.array(s(by), s("calls"), s("prompt_tokens"), s("completion_tokens"), money(F.col("usd"))), " | "), F.lit(" |")).alias("line")).alias("x"))
        one = lines.groupBy("trace").agg(F.array_sort(F.collect_list("x")).alias("x")).select("trace", F.lit(i).alias("step"), F.concat(F.lit(f"| {by.capitalize()} | Calls | Prompt | Completion | Cost |\n|---|---:|---:|---:|---:|\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("text"))
        costs = one if costs is None else costs.unionByName(one)
    piece = lambda df, section, step, text: df.select("trace", F.lit(section).alias("section"), step.cast("int").alias("step"), text.alias("text"))
    parts = [
        piece(heads, 0, F.lit(0), F.concat(headline, table)), piece(overview(steps), 1, F.col("step"), F.col("text")), piece(rows, 2, F.col("step"), F.concat(F.lit("\n"), body)),
        piece(costs, 3, F.col("step"), F.concat(F.when(F.col("step") == 0, "\n## Cost\n\n").otherwise("\n"), F.col("text"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_markdown(steps: DataFrame, path: str) -> None:
    """The pieces as text, a folder a trace, in order over its files."""
    rows = markdown(steps).repartitionByRange("trace", "section", "step").sortWithinPartitions("trace", "section", "step")
    rows.select("trace", "text").write.mode("overwrite").partitionBy("trace").text(path)
