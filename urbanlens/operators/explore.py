"""Exploratory aggregates A1-A12 and the top-N semi-join J1.

Every aggregate is a partial/final hash aggregation (map-side combine), and
top-N is ``orderBy(...).limit(n)`` which plans as TakeOrderedAndProject (no
global sort). Ties are broken by key ascending everywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanlens.functions import calendar

AGE_BINS = 40
KDE_GRID = 200


def value_counts(df: DataFrame, key: str, alias: str = "n_incidents") -> DataFrame:
    """Counts per non-null key."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(alias))


def top_values(df: DataFrame, key: str, n: int, alias: str = "n_incidents") -> DataFrame:
    """The ``n`` most frequent non-null keys; ties by key ascending."""
    return value_counts(df, key, alias).orderBy(F.col(alias).desc(), F.col(key).asc()).limit(n)


def topn_semi_join(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose key is among the ``n`` most frequent keys.

    The top-N side has at most ``n`` rows, so broadcasting it is safe.
    """
    top = top_values(df, key, n).select(key)
    return df.join(F.broadcast(top), on=key, how="left_semi")


def top_crimes(clean: DataFrame, n: int = 15) -> DataFrame:
    """A1: most frequent incident types."""
    return top_values(clean, "crm_cd_desc", n)


def monthly_counts(clean: DataFrame) -> DataFrame:
    """A2: incidents per 'yyyy-MM'."""
    return value_counts(clean, "month").orderBy("month")


def year_month_counts(clean: DataFrame) -> DataFrame:
    """Long form of A3: count of non-null record keys per (year, month)."""
    return clean.groupBy("year", "month").agg(F.count("dr_no").alias("n_incidents"))


#: Columns that the month matrix may have: a century of months.
MOST_MONTHS = 1200


def observed_months(clean: DataFrame, most: int = MOST_MONTHS) -> list[str]:
    """The months that occur, in order. The range of the dates is checked first, so that no more than ``most`` months can
    come back: a wider range (junk years, say) is an error that names it."""
    month = F.year("date_occ") * 12 + F.month("date_occ") - 1
    r = clean.agg(F.min(month).alias("a"), F.max(month).alias("b"), F.min("date_occ").alias("first"), F.max("date_occ").alias("last")).first()
    if r["a"] is None:
        return []
    if r["b"] - r["a"] >= most:
        raise ValueError(f"dates from {r['first']} to {r['last']} span more than {most} months; filter them first")
    return [x[0] for x in clean.select("month").filter(F.col("month").isNotNull()).distinct().orderBy("month").collect()]


def year_month_pivot(clean: DataFrame, months: list[str] | None = None) -> DataFrame:
    """A3: year x 'yyyy-MM' matrix of record counts, missing cells 0.

    The month list is passed explicitly (:func:`observed_months` when not
    given), which fixes the schema and avoids Spark's own value-discovery job.
    """
    if months is None:
        months = observed_months(clean)
    wide = clean.filter(F.col("year").isNotNull()).groupBy("year").pivot("month", months).agg(F.count("dr_no"))
    return wide.fillna(0, subset=months) if months else wide


def top_areas(clean: DataFrame, n: int = 20) -> DataFrame:
    """A4: areas with most incidents."""
    return top_values(clean, "area_name", n)


def hour_counts(clean: DataFrame) -> DataFrame:
    """A5: incidents per clipped hour (0..23)."""
    return (
        clean.select(calendar.hour_clipped(F.col("time_occ")).alias("hour"))
        .filter(F.col("hour").isNotNull())
        .groupBy("hour")
        .agg(F.count(F.lit(1)).alias("n_incidents"))
    )


def _age_scalars(clean: DataFrame):
    """Count, range, mean and sample std of positive ages - five numbers, one aggregation."""
    r = clean.filter(F.col("vict_age") > 0).agg(
        F.count(F.lit(1)).alias("n"), F.min("vict_age").alias("amin"), F.max("vict_age").alias("amax"),
        F.avg("vict_age").alias("mean"), F.stddev_samp("vict_age").alias("std"),
    ).first()
    if not r["n"]:
        return None
    amin, amax = float(r["amin"]), float(r["amax"])
    flat = amin == amax
    lo, hi = (amin - 0.5, amax + 0.5) if flat else (amin, amax)
    return {"n": int(r["n"]), "lo": lo, "hi": hi, "flat": flat, "mean": r["mean"], "std": r["std"]}


def _bin_of(a, lo: float, hi: float, bins: int = AGE_BINS):
    """Equal-width bin index with the edge corrections of the usual histogram algorithm."""
    step = F.lit((hi - lo) / bins)
    norm = F.lit(bins / (hi - lo))

    def edge(i):
        return F.when(i >= bins, F.lit(hi)).otherwise(i * step + F.lit(lo))

    b0 = F.least(F.floor((a - F.lit(lo)) * norm), F.lit(bins - 1)).cast("int")
    return (
        F.when(a < edge(b0), b0 - 1)
        .when((a >= edge(b0 + 1)) & (b0 != bins - 1), b0 + 1)
        .otherwise(b0)
    )


_HIST_SCHEMA = "bin int, bin_start double, bin_end double, n_incidents bigint"
_KDE_SCHEMA = "grid_idx int, x double, density_count double"


def age_histogram(clean: DataFrame, bins: int = AGE_BINS) -> DataFrame:
    """40 equal-width bins over [min, max] of positive victim ages, empty bins included.

    Only the range is collected; counting per bin is a distributed aggregation.
    """
    spark = clean.sparkSession
    st = _age_scalars(clean)
    if st is None:
        return spark.createDataFrame([], _HIST_SCHEMA)
    lo, hi = st["lo"], st["hi"]
    step = (hi - lo) / bins
    counts = (
        clean.filter(F.col("vict_age") > 0)
        .select(_bin_of(F.col("vict_age").cast("double"), lo, hi, bins).alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n_incidents"))
    )
    edges = spark.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        F.round(F.col("id") * F.lit(step) + F.lit(lo), 6).alias("bin_start"),
        F.round(F.when(F.col("id") == bins - 1, F.lit(hi)).otherwise((F.col("id") + 1) * F.lit(step) + F.lit(lo)), 6).alias("bin_end"),
    )
    return edges.join(counts, "bin", "left").select(
        "bin", "bin_start", "bin_end", F.coalesce("n_incidents", F.lit(0)).cast("bigint").alias("n_incidents")
    )


def age_density(clean: DataFrame, grid: int = KDE_GRID, bins: int = AGE_BINS) -> DataFrame:
    """Gaussian kernel density of positive ages on ``grid`` points over [min, max].

    Bandwidth = Scott factor n^(-1/5) x sample standard deviation; the curve is
    scaled to counts (n x bin width) like a density line over a count histogram.
    Ages are first counted per distinct value; each (age, grid point) pair adds
    its weighted kernel, summed per grid point in a distributed aggregation.
    No curve when all ages are equal.
    """
    spark = clean.sparkSession
    st = _age_scalars(clean)
    if st is None or st["flat"] or not st["std"]:
        return spark.createDataFrame([], _KDE_SCHEMA)
    n, lo, hi = st["n"], st["lo"], st["hi"]
    h = st["std"] * n ** -0.2
    xs = F.array(*[F.lit(hi if g == grid - 1 else lo + g * ((hi - lo) / (grid - 1))) for g in range(grid)])
    by_age = clean.filter(F.col("vict_age") > 0).groupBy("vict_age").agg(F.count(F.lit(1)).alias("c"))
    pairs = by_age.select(F.col("vict_age").cast("double").alias("a"), "c", F.posexplode(xs).alias("g", "x"))
    kern = F.col("c") * F.exp(F.lit(-0.5) * F.pow((F.col("x") - F.col("a")) / F.lit(h), F.lit(2.0)))
    scale = F.lit(1.0 / (n * h * math.sqrt(2 * math.pi)) * n * ((hi - lo) / bins))
    return pairs.groupBy("g", "x").agg(F.sum(kern).alias("k")).select(
        F.col("g").cast("int").alias("grid_idx"), F.round("x", 6).alias("x"), F.round(F.col("k") * scale, 4).alias("density_count")
    )


def sex_counts(clean: DataFrame) -> DataFrame:
    """Incidents per victim sex, null counted as 'X'."""
    return clean.groupBy(F.coalesce(F.col("vict_sex"), F.lit("X")).alias("vict_sex")).agg(
        F.count(F.lit(1)).alias("n_incidents")
    )


def top_weapons(clean: DataFrame, n: int = 15) -> DataFrame:
    """Most frequent weapon descriptions (non-null)."""
    return top_values(clean, "weapon_desc", n)


def area_sex_crosstab(clean: DataFrame, n: int = 15) -> DataFrame:
    """A10: F/M counts for the ``n`` areas with most F/M incidents."""
    mf = clean.filter(F.col("vict_sex").isin("M", "F"))
    kept = topn_semi_join(mf, "area_name", n)
    return (
        kept.groupBy("area_name")
        .pivot("vict_sex", ["F", "M"])
        .agg(F.count(F.lit(1)))
        .fillna(0, subset=["F", "M"])
        .select("area_name", F.col("F").alias("f_count"), F.col("M").alias("m_count"))
    )


def class_imbalance(clean: DataFrame, n: int = 30) -> DataFrame:
    """The 30 most frequent incident types."""
    return top_values(clean, "crm_cd_desc", n)


def severity_balance(training: DataFrame) -> DataFrame:
    """Counts and percentages of both severity levels (0 % when empty), one pass."""
    agg = training.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("severity") == "PELIGROSO", 1).otherwise(0)), F.lit(0)).cast("bigint").alias("p"),
        F.coalesce(F.sum(F.when(F.col("severity") == "SEGURO", 1).otherwise(0)), F.lit(0)).cast("bigint").alias("s"),
    )
    long = agg.select(
        "total",
        F.explode(
            F.array(
                F.struct(F.lit("PELIGROSO").alias("severity"), F.col("p").alias("n")),
                F.struct(F.lit("SEGURO").alias("severity"), F.col("s").alias("n")),
            )
        ).alias("r"),
    )
    pct = F.when(F.col("total") > 0, F.col("r.n") / F.col("total") * 100).otherwise(F.lit(0.0))
    return long.select(F.col("r.severity").alias("severity"), F.col("r.n").alias("n_incidents"), F.round(pct, 6).alias("pct"))

