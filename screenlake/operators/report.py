"""The document of an evaluation, as rows of (section, place, line) that any number of tasks can write.

Each table is an aggregation of scores with a row an arm, outcome, trap or
threshold; its cells are columns. A section without rows to show is left out, so
no heading stands over nothing. Failures have a row each and are in order of
their text, so they need no numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screenlake.operators import arms, metrics
from screenlake.operators.gates import cell

# The titles of the sections and the heads of their tables.
TITLES = ("Results", "Headline", "Every arm", "What abstention cost", "What the accuracy column is worth", "The same run, scored against another key", "Risk and coverage", "By trap", "Cases that failed to run")
ARM_HEADS = ("Arm", "Cases", "Accuracy", "Balanced", "95% CI", "Coverage", "Unsafe errors", "False abstention", "Coverage at 0 unsafe")
BLOCKER_HEADS = ("Trial", "Criterion", "Screenings blocked", "Protocol text", "What was missing")
CURVE_HEADS = ("Abstention threshold", "Coverage", "Selective risk", "Unsafe errors", "Cases answered")
NONE = "—"

SCHEMA = "section int, place int, line string"
LINES = ("section", "place", "line")


def percent(share: Column) -> Column:
    """A share as whole percents, halves to even."""
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def _code(name: Column) -> Column:
    return F.concat(F.lit("`"), name, F.lit("`"))


def _row(cells) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit(NONE)) for c in cells]), F.lit(" |"))


def _told(spark: SparkSession, section: int, lines: list[str], place: int = 0) -> DataFrame:
    return spark.createDataFrame([(section, place + i, x) for i, x in enumerate(lines)], SCHEMA)


def _title(section: int) -> str:
    return ("# " if section == 0 else "## ") + TITLES[section]


def _table(rows: DataFrame, section: int, cells: dict[str, Column], words: set[str], order: list) -> DataFrame:
    """Title, heads and rows. words: heads of columns that hold words and start at the left; order: of the rows, each of which is one of a few."""
    rule = "|" + "".join("---|" if c in words else "---:|" for c in cells)
    top = [_title(section), f"| {' | '.join(cells)} |", rule]
    body = rows.select(F.lit(section).alias("section"), (F.row_number().over(Window.orderBy(*order)) + len(top) - 1).alias("place"), _row(cells.values()).alias("line"))
    any_rows = body.select("section").limit(1)
    return _told(rows.sparkSession, section, top).join(any_rows, "section", "left_semi").select(*LINES).union(body)


def arm_names(scores: DataFrame) -> list[str]:
    """Arms that read charts first, then those that don't, by name. A run has a handful of arms."""
    return [r.arm for r in scores.select("arm").distinct().withColumn("last", arms.degenerate()).orderBy("last", "arm").collect()]


def key_lines(spark: SparkSession, cases: int, digest: str) -> DataFrame:
    return _told(spark, 0, [_title(0), f"Answer key: **{cases} cases**, digest `{digest[:16]}…`."])


def headline(summaries: DataFrame, arm: str) -> DataFrame:
    """What one arm decided without a reader and what that cost, both from its own row."""
    errors = F.when(F.col("unsafe") == 1, "1 unsafe error").otherwise(F.concat(F.col("unsafe").cast("string"), F.lit(" unsafe errors")))
    said = F.concat(_code(F.col("arm")), F.lit(" decided **"), percent(F.col("coverage")), F.lit("** of "), F.col("cases").cast("string"), F.lit(" cases without a reader, with "), errors, F.lit("."))
    width = arms.interval_width(summaries).select(F.concat(F.lit("Half of the intervals of the accuracy are at most "), F.bround(F.col("width") * 100, 0).cast("long").cast("string"), F.lit(" percentage points wide.")).alias("line")).filter("line IS NOT NULL")
    own = summaries.filter(F.col("arm") == arm).select(F.lit(1).alias("section"), F.lit(1).alias("place"), said.alias("line"))
    return _told(summaries.sparkSession, 1, [_title(1)]).union(own).union(width.select(F.lit(1), F.lit(2), "line"))


def arm_table(reported: DataFrame, claimed: DataFrame | None = None, costs: DataFrame | None = None) -> DataFrame:
    """reported: arms.report(...); claimed: arm, claimed, spans; costs: arm, usd. Columns that nothing was given for are left out."""
    interval = F.concat(percent(F.col("accuracy_interval.low")), F.lit("–"), percent(F.col("accuracy_interval.high")))
    values = (_code(F.col("arm")), F.col("cases"), percent(F.col("accuracy")), percent(F.col("balanced_accuracy")), interval, percent(F.col("coverage")), F.col("unsafe"), percent(F.col("false_abstention")), percent(F.col("coverage_at_zero_unsafe")))
    rows, cells = reported, dict(zip(ARM_HEADS, values, strict=True))
    if claimed is not None:
        rows = rows.join(claimed.select("arm", F.try_divide("claimed", "spans").alias("claimed_share")), "arm", "left")
        cells["Protocol claimed"] = percent(F.col("claimed_share"))
    if costs is not None:
        rows = rows.join(costs.select("arm", "usd"), "arm", "left")
        cells["Cost"] = F.when(F.col("usd").isNotNull(), F.concat(F.lit("$"), F.format_string("%.2f", F.col("usd"))))
    return _table(rows, 2, cells, {"Arm", "95% CI"}, ["degenerate", "arm"])


def blocker_table(blockers: DataFrame) -> DataFrame:
    """blockers: nct_id, criterion_id, n, screenings, quote, missing, place; others if more were found than are listed."""
    count = F.concat(F.col("n").cast("string"), F.coalesce(F.concat(F.lit(" of "), F.col("screenings").cast("string")), F.lit("")))
    text = lambda c: F.nullif(cell(F.coalesce(c, F.lit(""))), F.lit(""))
    cells = dict(zip(BLOCKER_HEADS, (F.col("nct_id"), _code(F.col("criterion_id")), count, text("quote"), text("missing")), strict=True))
    out = _table(blockers, 3, cells, {"Trial", "Criterion", "Protocol text", "What was missing"}, ["place"])
    if "others" in blockers.columns:
        more = blockers.agg(F.max("others").alias("n"), F.count("*").alias("listed")).filter("n > 0")
        out = out.union(more.select(F.lit(3), (F.col("listed") + 3).cast("int"), F.concat(F.col("n").cast("string"), F.lit(" more criteria blocked fewer screenings."))))
    return out


def expected_table(scores: DataFrame, names: list[str]) -> DataFrame:
    """Right answers by what the key expects: an arm that always says the commonest shows itself here."""
    cells = {"Key expects": _code(F.col("expected")), "Cases": F.col("cases")} | {f"`{a}`": F.col(f"`{a}`") for a in names}
    return _table(arms.by_expected(scores), 4, cells, {"Key expects"}, ["expected"])


def comparison_table(here: DataFrame, there: DataFrame) -> DataFrame:
    """The same decisions under two keys, and which arms are unsafe under one of them only."""
    both = arms.compare(here, there)
    share = lambda c: percent(F.col(c))
    cells = {"Arm": _code(F.col("arm")), "Accuracy": share("accuracy"), "Accuracy there": share("accuracy_there"), "Unsafe": F.col("unsafe"), "Unsafe there": F.col("unsafe_there")}
    moved = arms.moved(both).agg(F.array_join(F.array_sort(F.collect_list(_code(F.col("arm")))), ", ").alias("names"))
    said = F.when(F.col("names") == "", "The same arms are unsafe under both keys.").otherwise(F.concat(F.lit("Unsafe under one key only: "), F.col("names"), F.lit(".")))
    return _table(both, 5, cells, {"Arm"}, ["degenerate", "arm"]).union(moved.select(F.lit(5), F.lit(2**31 - 1), said))


def curve_table(scores: DataFrame, arm: str) -> DataFrame:
    """What answering would have cost at each threshold of coverage. Thresholds are shares of criteria: a few hundred at most."""
    curve = metrics.risk_coverage_curve(scores.filter(F.col("arm") == arm))
    cells = dict(zip(CURVE_HEADS, (F.format_string("%.2f", F.bround("threshold", 2)), percent(F.col("coverage")), percent(F.col("risk")), F.col("unsafe"), F.col("answered")), strict=True))
    return _table(curve, 6, cells, set(), ["threshold"])


def trap_table(scores: DataFrame, names: list[str]) -> DataFrame:
    cells = {"Trap": _code(F.col("trap"))} | {f"`{a}`": F.col(f"`{a}`") for a in names}
    return _table(arms.by_trap(scores), 7, cells, set(cells), ["trap"])


def failure_lines(failures: DataFrame) -> DataFrame:
    """A line for each case that an arm could not answer, or that there is none."""
    spark = failures.sparkSession
    rows = failures.select(F.lit(8).alias("section"), F.lit(1).alias("place"), F.concat(F.lit("- "), _code(F.col("arm")), F.lit(": "), _code(F.col("case_id")), F.lit(" at "), F.col("stage")).alias("line"))
    none = failures.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(8), F.lit(1), F.lit("No case failed to run in any arm."))
    return _told(spark, 8, [_title(8)]).union(rows).union(none)


def document(scores: DataFrame, failures: DataFrame, arm: str, digest: str, cases: int, blockers: DataFrame | None = None, there: DataFrame | None = None, claimed: DataFrame | None = None, costs: DataFrame | None = None) -> DataFrame:
    """section, place, line of the whole document. arm: the one that the headline and the curve are about; there: the same scores under another key.

    scores is read once for each table: give a written table, as
    evaluation_run.run returns. Lines that share a place are in order of their text.
    """
    spark, names, reported = scores.sparkSession, arm_names(scores), arms.report(scores)
    parts = [key_lines(spark, cases, digest), headline(reported, arm), arm_table(reported, claimed, costs)]
    if blockers is not None:
        parts.append(blocker_table(blockers))
    parts.append(expected_table(scores, names))
    if there is not None:
        parts.append(comparison_table(scores, there))
    parts += [curve_table(scores, arm), trap_table(scores, names), failure_lines(failures)]
    return reduce(DataFrame.union, [p.select(*[F.col(c).cast(t).alias(n) for c, (n, t) in zip(p.columns, (x.split() for x in SCHEMA.split(", ")), strict=True)]) for p in parts])


def write(lines: DataFrame, path: str) -> None:
    """Markdown as a folder of text files in order, with empty lines around titles and before tables."""
    sentence = ~F.col("line").rlike("^[|]|^- ")
    before = F.when(((F.col("place") == 0) & (F.col("section") > 0)) | (sentence & (F.col("place") > 1)), "\n").otherwise("")
    after = F.when(F.col("place") == 0, "\n").otherwise("")
    lines.orderBy(*LINES).select(F.concat(before, F.col("line"), after)).write.mode("overwrite").text(path)
