"""Calendar rules: windows that look back from a screening date, ages, and dates as written."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATIONS = ("within", "before", "after", "ever", "current")
UNITS = ("days", "weeks", "months", "years")


def window_start(as_of: date, amount: int, unit: str) -> date:
    """as_of less a span; months and years keep the day, or the last day of a shorter month."""
    if unit in ("days", "weeks"):
        return as_of - timedelta(days=amount * (7 if unit == "weeks" else 1))
    months = as_of.year * 12 + as_of.month - 1 - amount * (12 if unit == "years" else 1)
    year, month = divmod(months, 12)
    return date(year, month + 1, min(as_of.day, calendar.monthrange(year, month + 1)[1]))


def in_window(when: Column, relation: str | None, start: date | None, as_of: date) -> Column:
    """Whether a dated row counts: nothing after as_of does, undated rows only without a relative window."""
    known = when.isNull() | (when <= F.lit(as_of))
    if relation in (None, "ever", "current"):
        return known
    bound = {"within": when >= F.lit(start), "before": when < F.lit(start), "after": when > F.lit(start)}[relation]
    return F.coalesce(bound & (when <= F.lit(as_of)), F.lit(False))


def age_years(birth: Column, as_of: Column) -> Column:
    """Completed years; 29 February counts as reached on the last day of February."""
    years = F.year(as_of) - F.year(birth)
    return years - (F.add_months(birth, years * 12) > as_of).cast("int")


def written_date(text: Column) -> Column:
    """The calendar day of an ISO date or date-time as written: the offset is dropped, partial dates are null."""
    x = F.trim(text)
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|z|[+-]\d{2}(:?\d{2})?)?)?$"
    return F.when(x.rlike(shape), F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd"))
