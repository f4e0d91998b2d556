"""Text rules: case folding, quotes, concept keys, numbers as words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Letters whose full folding has several letters, and those that fold to another one than their lower case, of the scripts that charts use.
LONG = ("ß", "ﬀ", "ﬁ", "ﬂ")
SHORT = "".join(c for c in map(chr, range(0x80, 0x2000)) if len(c.casefold()) == len(c.lower()) == 1 and c.lower().casefold() != c.lower())


def folded(text: Column) -> Column:
    """Full case folding: lower case, ß as ss, ligatures as letters, and letters with several small forms as one."""
    out = F.translate(F.lower(text), SHORT.lower(), SHORT.lower().casefold())
    for c in LONG:
        out = F.replace(out, F.lit(c), F.lit(c.casefold()))
    # most texts have none of these
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(out)


def quote_key(text: Column) -> Column:
    """White space collapsed and case folded: two quotes with the same key say the same."""
    return folded(F.trim(F.regexp_replace(text, r"\s+", " ")))


def lower_key(text: Column) -> Column:
    """White space collapsed and in lower case, without folding."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def concept_key(text: Column) -> Column:
    """A quote key without closing punctuation."""
    return F.regexp_replace(quote_key(text), r"[ \t.,;:]+$", "")


def without_escapes(text: Column) -> Column:
    r"""Registry text without the backslashes before Markdown marks."""
    return F.regexp_replace(text, r"\\([<>\[\]^*_~`#+\-.!()])", "$1")


def numbers(text: Column) -> Column:
    """The numbers of a sentence, in order."""
    return F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def short_number(value: Column) -> Column:
    """Numbers with six significant digits and no trailing zeros, large and small ones with an exponent."""
    shown = F.format_string("%.6g", value.cast("double"))
    return F.when(value.isNotNull(), F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", ""))


@F.pandas_udf(StringType())
def located(text: pd.Series, quote: pd.Series) -> pd.Series:
    """The part of the text that the quote repeats but for white space, as the text has it; null if there is none.

    A quote that stands in the text as it is, but for white space around it, is its own part.
    """
    import re

    def find(t, q):
        if not isinstance(t, str) or not isinstance(q, str) or not q.split():
            return None
        if (said := q.strip()) in t:
            return said
        m = re.search(r"\s+".join(map(re.escape, q.split())), t)
        return m[0] if m else None

    return pd.Series([find(t, q) for t, q in zip(text, quote, strict=True)], dtype=object)
