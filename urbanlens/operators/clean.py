"""Cleaning (P1-P9, P17) and the row-count audit.

All steps are narrow projections and filters: one stage, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanlens.functions import calendar, coords

# FIXED VALUES: columns of the published CSV that the analysis never uses.
UNUSED_COLUMNS = [
    "Date Rptd", "AREA", "Part 1-2", "Crm Cd", "Mocodes",
    "Crm Cd 1", "Crm Cd 2", "Crm Cd 3", "Crm Cd 4",
    "Cross Street", "Status", "Status Desc",
]

CLEAN_COLUMNS = [
    "dr_no", "date_occ", "time_occ", "area_name", "crm_cd_desc", "vict_age", "vict_sex",
    "premis_cd", "weapon_used_cd", "weapon_desc", "lat", "lon",
    "year", "month", "month_num", "day_of_week",
]

CODE_COLUMNS = ["premis_cd", "weapon_used_cd"]


def drop_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drop the unused columns that are present (missing names are ignored)."""
    from urbanlens.sources.incidents import canonical_name

    names = names if names is not None else UNUSED_COLUMNS
    wanted = {canonical_name(n) for n in names} | set(names)
    return df.drop(*[c for c in df.columns if c in wanted])


def parse_dates(df: DataFrame, drop_invalid: bool = True) -> DataFrame:
    """Coercing date parse; rows whose date does not parse are removed when ``drop_invalid``."""
    out = df.withColumn("date_occ", calendar.parse_date("date_occ"))
    return out.filter(F.col("date_occ").isNotNull()) if drop_invalid else out


def calendar_fields(df: DataFrame) -> DataFrame:
    """Year, 'yyyy-MM', month number, weekday (Monday = 0) from the parsed date."""
    return df.withColumns(calendar.calendar_columns(F.col("date_occ")))


def fill_codes(df: DataFrame) -> DataFrame:
    """P5: premise and weapon codes null -> 0."""
    return df.fillna(0, subset=[c for c in CODE_COLUMNS if c in df.columns])


def coerce_coordinates(df: DataFrame) -> DataFrame:
    """Text coordinates -> double (junk, NaN, +-Infinity -> null)."""
    return df.withColumns({"lat": coords.coerce_double(F.col("lat")), "lon": coords.coerce_double(F.col("lon"))})


def rescale_coordinates(df: DataFrame) -> DataFrame:
    """Divide by 10 until |lat| <= 90 and |lon| <= 180."""
    return df.withColumns(
        {"lat": coords.rescale_coordinate(F.col("lat"), 90), "lon": coords.rescale_coordinate(F.col("lon"), 180)}
    )


def valid_coordinates(df: DataFrame) -> DataFrame:
    """Keep rows whose coordinates are both present and both non-zero."""
    return df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("lat") != 0) & (F.col("lon") != 0))


def nonnull_coordinates(df: DataFrame) -> DataFrame:
    """Keep rows whose coordinates are both present (zeros stay)."""
    return df.dropna(subset=["lat", "lon"])


def clean_incidents(raw: DataFrame) -> DataFrame:
    """Full cleaning: P1, P2 (dropping bad dates), P3, P5, P6, P7, P8.

    The coordinate filter (P8) is applied to the coerced values before the
    rescale: dividing by 10 never turns a non-zero value into zero or null, so
    the result is the same, and the predicates pushed into the scan carry only
    the cheap coercion instead of the rescale fold.
    """
    df = drop_columns(raw)
    df = calendar_fields(parse_dates(df))
    df = fill_codes(df)
    df = rescale_coordinates(valid_coordinates(coerce_coordinates(df)))
    return df.select(*CLEAN_COLUMNS)


def light_incidents(raw: DataFrame, drop_missing_coords: bool = False) -> DataFrame:
    """Fallback preprocessing used when no curated table exists: dates parsed (unparseable dates
    become null, rows are kept), calendar fields, coordinates coerced but not rescaled; with
    ``drop_missing_coords`` rows without coordinates are dropped (map views)."""
    df = calendar_fields(parse_dates(drop_columns(raw), drop_invalid=False))
    df = coerce_coordinates(df)
    if drop_missing_coords:
        df = nonnull_coordinates(df)
    return df.select(*CLEAN_COLUMNS)


def audit_columns(raw: DataFrame) -> list[Column]:
    """A21 as aggregates: loaded rows, rows with a valid date, rows surviving the full cleaning."""
    d = calendar.parse_date(F.col("date_occ"))
    lat = coords.rescale_coordinate(coords.coerce_double(F.col("lat")), 90)
    lon = coords.rescale_coordinate(coords.coerce_double(F.col("lon")), 180)
    ok_coord = lat.isNotNull() & lon.isNotNull() & (lat != 0) & (lon != 0)
    return [
        F.count(F.lit(1)).alias("loaded_rows"),
        F.count(d).alias("dated_rows"),
        F.coalesce(F.sum(F.when(d.isNotNull() & ok_coord, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("valid_rows"),
    ]


def clean_audit(raw: DataFrame) -> DataFrame:
    """The row counts of :func:`audit_columns`, in one pass."""
    return raw.agg(*audit_columns(raw))


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows with a null in any of ``columns``."""
    return df.dropna(how="any", subset=columns)
