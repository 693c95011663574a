"""Date and hour expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text layouts accepted by the tolerant date parse (first that fits wins).
DATE_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "MM/dd/yyyy hh:mm:ss a",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][XXX]",
    "yyyy-MM-dd HH:mm:ss.SSSSSSSSS",
    "yyyy/MM/dd[ HH:mm:ss]",
    "M/d/yyyy[ H:mm[:ss]]",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy h:mm a",
    "yyyy-MM-dd['T'][ ]HH:mm[XXX]",
    "yyyyMMdd['T'HHmmss]",
    "yyyy-M-d[ H:mm[:ss]]",
    "yyyy/M/d[ H:mm[:ss]]",
    "MMM d, yyyy[ h:mm[:ss] a][ H:mm[:ss]]",
    "MMMM d, yyyy[ h:mm[:ss] a][ H:mm[:ss]]",
    "d MMM yyyy[ H:mm[:ss]]",
    "d MMMM yyyy[ H:mm[:ss]]",
    "d-MMM-yyyy[ H:mm[:ss]]",
    "M-d-yyyy[ H:mm[:ss]]",
]


def parse_date(col: Column | str) -> Column:
    """Coercing parse: text that fits none of :data:`DATE_FORMATS` becomes null.

    ``try_to_timestamp`` never raises under ANSI mode, unlike ``cast``.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def weekday_monday0(date_col: Column) -> Column:
    """Day of week with Monday = 0 (``dayofweek`` would give Sunday = 1)."""
    return F.weekday(date_col)


def calendar_columns(date_col: Column) -> dict[str, Column]:
    """year, 'yyyy-MM' month text, month number, weekday (Mon=0)."""
    return {
        "year": F.year(date_col),
        "month": F.date_format(date_col, "yyyy-MM"),
        "month_num": F.month(date_col),
        "day_of_week": weekday_monday0(date_col),
    }


def hour_clipped(time_col: Column) -> Column:
    """floor(hhmm / 100) clipped to 0..23 (2400 -> 23, -50 -> 0)."""
    return F.least(F.greatest(F.floor(time_col / 100), F.lit(0)), F.lit(23)).cast("int")


def hour_modular(time_col: Column) -> Column:
    """floor(hhmm / 100) mod 24 (2400 -> 0, -50 -> 23)."""
    return F.pmod(F.floor(time_col / 100), F.lit(24)).cast("int")
