"""Canonical JSON of nested columns: keys in order, no spaces, no escapes that aren't needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHORT = {"\b": r"\b", "\t": r"\t", "\n": r"\n", "\f": r"\f", "\r": r"\r"}
#: What a JSON string must escape, the backslash first.
ESCAPES = {"\\": r"\\", '"': r"\""} | {chr(i): _SHORT.get(chr(i), f"\\u{i:04x}") for i in range(0x20)}


def quoted(text: Column) -> Column:
    """A string as JSON; other characters, whatever their script, stay as they are."""
    out = text
    for char, escape in ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit(escape))
    # most texts have none of these
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), out).otherwise(text), F.lit('"'))


def canonical(value: Column, kind: T.DataType, nulls: bool = False) -> Column:
    """The JSON of a column of strings, whole numbers, booleans, and arrays, maps and structs of these.

    Fields of a struct that are null are left out, as keys that a message doesn't
    have, unless nulls is set; other nulls are null. Numbers with a point have no one spelling and raise.
    """
    null = F.lit("null")
    if isinstance(kind, T.StringType):
        return F.coalesce(quoted(value), null)
    if isinstance(kind, T.BooleanType | T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return F.coalesce(value.cast("string"), null)
    if isinstance(kind, T.NullType):
        return null
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType, nulls)), ","), F.lit("]")), null)
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        # strings are ordered by their bytes, which is the order of code points
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType, nulls).alias("json"))))
        return F.coalesce(F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["json"])), ","), F.lit("}")), null)
    if isinstance(kind, T.StructType):
        field = lambda f: F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical(value[f.name], f.dataType, nulls))
        fields = [field(f) if nulls else F.when(value[f.name].isNotNull(), field(f)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNull(), null).otherwise(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ","), F.lit("}")))
    raise TypeError(f"no canonical JSON for {kind.simpleString()}")
