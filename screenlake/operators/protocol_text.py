"""Protocol text: segmentation into criteria, claims of spans, quotes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.functions.text import quote_key

# The line shapes of registry text; bullets and numbers have one body.
HEADER = r"(?i)^\s*(?:key\s+)?(inclusion|exclusion)\s+criteri(?:on|a)\b\s*:?\s*$"
ITEM = r"^(\s*)(?:[*\-•]|\(?\d+[.)]|[a-z][.)])\s+(\S.*)$"
BOILERPLATE = "the above information is not intended to contain all considerations relevant to a participant's potential participation in a clinical trial"
#: Bytes of a batch of criteria, about.
BATCH = 4 << 20


def spans_of(text: str) -> Iterator[tuple[int, str, str, int, int | None, int]]:
    """Index, section, text, start, parent and root of the criteria in one text, in one pass with a stack of the open, less indented lines above."""
    open_, section, offset, n = [], "unspecified", 0, 0
    for raw in text.split("\n"):
        start, trimmed = offset, raw.strip()
        offset += len(raw) + 1
        if not trimmed or BOILERPLATE in trimmed.lower():
            continue
        if header := re.match(HEADER, trimmed):
            section = header[1].lower()
            continue
        item = re.match(ITEM, raw)
        indent, body = (len(item[1]), item[2].rstrip()) if item else (0, trimmed)
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        parent = open_[-1] if open_ else None
        own = parent[2] if parent else section
        open_.append((indent, n, own))
        yield n, own, body, start + raw.index(body), parent[1] if parent else None, open_[0][1]
        n += 1


def segment(protocols: DataFrame) -> DataFrame:
    """nct_id, index, section, text, char_start, char_end, parent_index, root_index of the criteria in protocols(nct_id, text).

    One criterion a line, with its place in the text. Headers set the section of
    what follows, deeper indented lines belong to the last shallower one above,
    and children have the section of their parent. A task holds one text at a
    time and gives its criteria in batches; nothing is shuffled. A null text has
    no criteria.
    """
    shape = f"nct_id {dict(protocols.dtypes)['nct_id']}, index int, section string, text string, char_start long, char_end long, parent_index int, root_index int"
    names = [x.split()[0] for x in shape.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            of, rows, size = [], [], 0

            def packed(batch=batch):
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns], names=names)
                of.clear()
                rows.clear()
                return out

            for i, text in enumerate(batch.column(1)):
                for index, section, body, start, parent, root in spans_of(text.as_py() or ""):
                    of.append(i)
                    rows.append((index, section, body, start, start + len(body), parent, root))
                    size += len(body) + 100
                    if size > BATCH:
                        size = 0
                        yield packed()
            if rows:
                yield packed()

    return protocols.select("nct_id", "text").mapInArrow(run, shape)


def rendered_units(units: DataFrame) -> DataFrame:
    """units with prompt: the section and the lines of a unit, the first as it is and those below it as a list."""
    lines = F.transform("lines", lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("  - "), x)))
    return units.withColumn("prompt", F.concat(F.lit("Section: "), F.col("section"), F.lit("\n"), F.array_join(lines, "\n")))


def ordinal_ids(criteria: DataFrame) -> DataFrame:
    """criteria(nct_id, kind, ord) with criterion_id: INC-01, EXC-01 and so on in order within a trial and kind."""
    place = F.row_number().over(Window.partitionBy("nct_id", "kind").orderBy("ord")).cast("string")
    shown = F.when(F.length(place) < 2, F.lpad(place, 2, "0")).otherwise(place)
    return criteria.withColumn("criterion_id", F.concat(F.when(F.col("kind") == "inclusion", "INC-").otherwise("EXC-"), shown))


def fingerprints(protocols: DataFrame) -> DataFrame:
    """nct_id, sha256 of the text that criteria were compiled from."""
    return protocols.select("nct_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


def downgraded(criteria: DataFrame, protocols: DataFrame) -> DataFrame:
    """criteria with type and reason: those whose quote the protocol has not become unsupported."""
    wrong = unfaithful_quotes(criteria, protocols).select("nct_id", "criterion_id", F.lit(True).alias("wrong")).distinct()
    rows = criteria.join(wrong, ["nct_id", "criterion_id"], "left")
    return rows.withColumn("type", F.when(F.col("wrong"), "unsupported").otherwise(F.col("type"))).withColumn("reason", F.when(F.col("wrong"), "the quote is not in the protocol")).drop("wrong")


def _below(spans: DataFrame, given: str, made: str, step) -> DataFrame:
    """nct_id, index and a column made from given and what the span above has, for spans with nct_id, index, parent_index and given.

    Spans of a text go by in order, with a stack of those that are still open.
    """

    def run(batches):
        trial, above = None, []
        for batch in batches:
            out = []
            for t, index, parent, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if t != trial:
                    trial, above = t, []
                while above and above[-1][0] != parent:
                    above.pop()
                found, kept = step(own, above[-1][1] if above else None)
                above.append((index, kept))
                out.append(found)
            yield pa.RecordBatch.from_pydict({"nct_id": batch.column(0), "index": batch.column(1), made.split()[0]: out}, schema=shape)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = f"nct_id {dict(spans.dtypes)['nct_id']}, index int, {made}"
    shape = to_arrow_schema(spans.sparkSession.createDataFrame([], kind).schema)
    rows = spans.select("nct_id", F.col("index").cast("int"), F.col("parent_index").cast("int"), given)
    return rows.repartition("nct_id").sortWithinPartitions("nct_id", "index").mapInArrow(run, kind)


def plan_units(spans: DataFrame) -> DataFrame:
    """nct_id, unit, section, lines: a top span with all spans below it, in order, which are compiled together."""
    if "root_index" not in spans.columns:
        roots = _below(spans.withColumn("own", F.col("index")), "own", "root_index int", lambda own, root: (own if root is None else root,) * 2)
        spans = spans.join(roots, ["nct_id", "index"])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"])
    return spans.groupBy("nct_id", F.col("root_index").alias("unit")).agg(F.min_by("section", "index").alias("section"), lines.alias("lines"))


def claims(spans: DataFrame, criteria: DataFrame, key: Callable[[Column], Column] = quote_key) -> DataFrame:
    """nct_id, index, claim: direct if a criterion quotes the span or the span has its quote, inherited from a claimed ancestor, else unclaimed.

    criteria: nct_id, quote. Quotes of one protocol meet its spans only. key: what
    of two texts must agree.
    """
    quotes = criteria.groupBy("nct_id").agg(F.collect_set(key(F.col("quote"))).alias("quotes"))
    own = spans.select("nct_id", "index", "parent_index", key(F.col("text")).alias("key")).join(quotes, "nct_id", "left")
    direct = F.coalesce(F.exists("quotes", lambda q: F.col("key").contains(q) | q.contains(F.col("key"))), F.lit(False))
    inherit = lambda hit, above: ("direct" if hit else "inherited" if above else "unclaimed", hit or bool(above))
    return _below(own.withColumn("direct", direct), "direct", "claim string", inherit)


def unfaithful_quotes(criteria: DataFrame, protocols: DataFrame) -> DataFrame:
    """nct_id, criterion_id, quote of criteria whose quote the protocol text does not have, white space and case aside."""
    both = criteria.join(protocols.select("nct_id", "text"), "nct_id")
    return both.filter(~quote_key(F.col("text")).contains(quote_key(F.col("quote")))).select("nct_id", "criterion_id", "quote")
