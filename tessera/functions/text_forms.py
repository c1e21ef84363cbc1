"""Stored text forms of times and dates, checked when text is imported into typed columns.

Valid texts sort like the times they mean: UTC without a zone, years 0 to 9999,
no blanks, and a fraction of up to nine digits that doesn't end in 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_TIME = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{0,8}[1-9])?"


def valid_date_text(text: Column) -> Column:
    """Whether a text is a stored date; days that the month lacks are none."""
    return F.coalesce(text.rlike(rf"\A{_DATE}\z") & _on_calendar(text), F.lit(False))


def valid_timestamp_text(text: Column) -> Column:
    """Whether a text is a stored time."""
    return F.coalesce(text.rlike(rf"\A{_DATE} {_TIME}\z") & _on_calendar(text), F.lit(False))


def _on_calendar(text: Column) -> Column:
    year, month, day = (F.substring(text, a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    length = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return day <= length


def parsed(text: Column, kind: str) -> Column:
    """The typed value of a stored text; an invalid one is an error, a null stays."""
    valid = valid_timestamp_text(text) if kind == "timestamp" else valid_date_text(text)
    return F.when(text.isNull() | valid, text.cast(kind)).otherwise(F.raise_error(F.concat(F.lit(f"no stored {kind}: "), text)).cast(kind))
