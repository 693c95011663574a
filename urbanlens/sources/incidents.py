"""Incident table: CSV scan (S1), alias renames (S3), loader with curated fallback (S2), curated sink."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

# Canonical raw schema: coordinates and dates stay text until the coercing parse.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("dr_no", T.LongType()),
        T.StructField("date_occ", T.StringType()),
        T.StructField("time_occ", T.IntegerType()),
        T.StructField("area_name", T.StringType()),
        T.StructField("crm_cd_desc", T.StringType()),
        T.StructField("vict_age", T.IntegerType()),
        T.StructField("vict_sex", T.StringType()),
        T.StructField("premis_cd", T.DoubleType()),
        T.StructField("weapon_used_cd", T.DoubleType()),
        T.StructField("weapon_desc", T.StringType()),
        T.StructField("lat", T.StringType()),
        T.StructField("lon", T.StringType()),
    ]
)

# FIXED VALUES: header names of the published incident CSV for each canonical column.
CSV_HEADERS = {
    "dr_no": "DR_NO",
    "date_occ": "DATE OCC",
    "time_occ": "TIME OCC",
    "area_name": "AREA NAME",
    "crm_cd_desc": "Crm Cd Desc",
    "vict_age": "Vict Age",
    "vict_sex": "Vict Sex",
    "premis_cd": "Premis Cd",
    "weapon_used_cd": "Weapon Used Cd",
    "weapon_desc": "Weapon Desc",
    "lat": "LAT",
    "lon": "LON",
}


def canonical_name(header: str) -> str:
    """'AREA NAME' / 'area_name' / 'Area Name' -> 'area_name'."""
    return re.sub(r"[\s\-]+", "_", header.lstrip("\ufeff").strip()).lower()


def rename_aliases(df: DataFrame) -> DataFrame:
    """Rename header variants (CSV headers or snake_case aliases) to canonical names.

    Where several headers mean one column, the published CSV header wins, else the first.
    """
    variants: dict[str, list[str]] = {}
    for c in df.columns:
        variants.setdefault(canonical_name(c), []).append(c)
    chosen = {name: CSV_HEADERS[name] if CSV_HEADERS.get(name) in found else found[0] for name, found in variants.items()}
    doubled = [c for name, found in variants.items() for c in found if c != chosen[name]]
    mapping = {c: name for name, c in chosen.items() if c != name}
    return df.drop(*doubled).withColumnsRenamed(mapping) if mapping or doubled else df


def _number(src: Column, kind: T.DataType) -> Column:
    """``try_cast``; for whole-number columns also text such as '34.0', never a value with a fraction."""
    if kind not in (T.IntegerType(), T.LongType()):
        return src.try_cast(kind)
    exact = src.cast("string").try_cast("decimal(38,10)")
    return F.coalesce(src.try_cast(kind), F.when(exact == F.floor(exact), exact.try_cast(kind)))


def conform_raw(df: DataFrame) -> DataFrame:
    """Fixed raw schema: known columns cast with ``try_cast``, missing ones added as typed nulls."""
    df = rename_aliases(df)
    cols = []
    for f in RAW_SCHEMA.fields:
        if f.name in df.columns:
            src = F.col(f.name)
            if f.dataType != T.StringType():
                src = _number(src, f.dataType)
            else:
                src = src.cast("string")
            cols.append(src.alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def empty_raw(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RAW_SCHEMA)


def is_missing_path(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_incident_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV scan without schema inference; a missing path -> empty typed table, other errors are raised.

    Quotes inside quoted fields are doubled. ``multi_line`` also reads quoted line breaks, at the price that
    a file can't be split among tasks.

    Every column is read as text and converted by :func:`conform_raw`, so
    extra columns in the file are pruned from the scan by Catalyst.
    """
    try:
        df = spark.read.options(header=True, inferSchema=False, mode="PERMISSIVE", escape='"', multiLine=multi_line).csv(path)
    except AnalysisException as e:
        if not is_missing_path(e):
            raise
        return empty_raw(spark)
    if not df.columns:
        return empty_raw(spark)
    return conform_raw(df)


def write_incident_csv(df: DataFrame, path: str) -> None:
    """Write raw rows with the published CSV header names."""
    df.select(*[F.col(c).alias(CSV_HEADERS[c]) for c in RAW_SCHEMA.fieldNames()]).write.mode("overwrite").option(
        "header", True
    ).option("escape", '"').csv(path)


def write_curated(clean: DataFrame, path: str) -> None:
    """Persist the cleaned table partitioned by year (partition pruning for year filters).

    Rows are rebalanced by year: small years are put together into tasks, and a year that holds a large share of the rows
    is split over many, by the sizes that Spark measures in that one shuffle. So files follow the data's size
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), and the input is scanned once.
    """
    clean.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)


def curate(raw: DataFrame, path: str) -> dict[str, int]:
    """Clean ``raw`` into the curated table at ``path``; the row counts of A21 (loaded, dated, valid) come from the same
    pass over the input."""
    from urbanlens.operators.clean import audit_columns, clean_incidents

    seen = Observation()
    write_curated(clean_incidents(raw.observe(seen, *audit_columns(raw))), path)
    return {k: int(v or 0) for k, v in seen.get.items()}


def read_curated(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if not is_missing_path(e):
            raise
        return None


def load_incidents(spark: SparkSession, curated_path: str | None = None, raw_path: str | None = None,
                   raw: DataFrame | None = None, level: str = "clean") -> DataFrame:
    """Prefer the curated table; otherwise scan the raw rows and clean them (``level='clean'``)
    or apply only the light fallback preprocessing (``level='light'``)."""
    from urbanlens.operators.clean import clean_incidents, light_incidents

    if curated_path:
        cur = read_curated(spark, curated_path)
        if cur is not None:
            from urbanlens.operators.clean import CLEAN_COLUMNS

            return cur.select(*CLEAN_COLUMNS)
    if raw is None:
        raw = read_incident_csv(spark, raw_path) if raw_path else empty_raw(spark)
    return light_incidents(raw) if level == "light" else clean_incidents(raw)
