"""Coordinate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urbanlens.functions import vocab


def coerce_double(col: Column) -> Column:
    """Text or number -> double; junk, NaN and +-Infinity become null."""
    v = col.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(v)


def rescale_coordinate(v: Column, limit: float) -> Column:
    """Divide by 10 until |v| <= limit, one division at a time.

    Repeated division is not the same double as one division by 10^k, so the
    loop is kept as a fold. The fold length is an upper bound of the number of
    divisions (log10 estimate + 1); the guard inside stops dividing once the
    value is in range. Values already in range skip the fold entirely.
    """
    limit_c = F.lit(float(limit))
    steps = F.greatest(F.lit(1), (F.ceil(F.log10(F.abs(v) / limit_c)) + 1).cast("int"))
    folded = F.aggregate(
        F.sequence(F.lit(1), steps),
        v,
        lambda acc, _: F.when(F.abs(acc) > limit_c, acc / F.lit(10.0)).otherwise(acc),
    )
    return F.when(F.abs(v) > limit_c, folded).otherwise(v)


def in_city_box(lat: Column, lon: Column) -> Column:
    """Inclusive city bounding box."""
    return lat.between(vocab.CITY_LAT_MIN, vocab.CITY_LAT_MAX) & lon.between(vocab.CITY_LON_MIN, vocab.CITY_LON_MAX)
