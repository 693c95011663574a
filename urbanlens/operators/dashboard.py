"""Dashboard: multi-select filter (P15), metrics (A13), distinct lists (A14), type options (A15),
area centroids (A16), representative point per area (A17) and seeded samples (L1-L3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanlens.functions import text, vocab
from urbanlens.operators.explore import top_values


def dashboard_filter(df: DataFrame, years: list[int] | None = None, areas: list[str] | None = None,
                     crimes: list[str] | None = None) -> DataFrame:
    """Conjunction of IN filters; an empty selection means 'all' and adds no predicate.

    On a year-partitioned curated table the year predicate prunes partitions.
    """
    if years:
        df = df.filter(F.col("year").isin(list(years)))
    if areas:
        df = df.filter(F.col("area_name").isin(list(areas)))
    if crimes:
        df = df.filter(F.col("crm_cd_desc").isin(list(crimes)))
    return df


def _distinct_with_null(c: str) -> F.Column:
    """Number of distinct values where null counts as one more value (empty input -> 0)."""
    return (F.countDistinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))).cast("bigint")


def dashboard_metrics(df: DataFrame) -> DataFrame:
    """Rows, and distinct areas / years / types of the current selection (null counted as a value)."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        _distinct_with_null("area_name").alias("n_areas"),
        _distinct_with_null("year").alias("n_years"),
        _distinct_with_null("crm_cd_desc").alias("n_types"),
    )


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    """Sorted non-null distinct values."""
    return df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c)


def crime_options(df: DataFrame, n: int = 10) -> DataFrame:
    """Spanish label -> incident type for the ``n`` most frequent types.

    When two types share a label, the later (less frequent) one wins, like
    building a dictionary in rank order. At most ``n`` rows.
    """
    ranked = top_values(df, "crm_cd_desc", n).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("n_incidents").desc(), F.col("crm_cd_desc").asc()))
    )
    return ranked.groupBy(text.translate_crime(F.col("crm_cd_desc")).alias("label")).agg(
        F.max_by("crm_cd_desc", "rank").alias("crm_cd_desc")
    )


def selected_crimes(df: DataFrame, labels: list[str], n: int = 10) -> DataFrame:
    """Types chosen through their Spanish labels (at most ``n`` rows)."""
    return crime_options(df, n).filter(F.col("label").isin(list(labels))).select("crm_cd_desc")


def filter_by_labels(df: DataFrame, years=None, areas=None, labels: list[str] | None = None) -> DataFrame:
    """P15 with the type selection given as Spanish labels (resolved through A15)."""
    out = dashboard_filter(df, years, areas, None)
    if labels:
        # the option table has at most 10 rows: a bounded broadcast
        out = out.join(F.broadcast(selected_crimes(df, labels)), "crm_cd_desc", "left_semi")
    return out


def area_centroids(df: DataFrame) -> DataFrame:
    """Mean lat/lon per non-null area."""
    return df.filter(F.col("area_name").isNotNull()).groupBy("area_name").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon")
    )


def area_point(df: DataFrame, requests: DataFrame, area_col: str = "area") -> DataFrame:
    """Coordinates of the first record (lowest record key) of each requested area;
    the default city point when the area has no records."""
    first = df.filter(F.col("area_name").isNotNull()).groupBy("area_name").agg(
        F.min_by(F.struct("lat", "lon"), "dr_no").alias("p")
    )
    j = requests.join(first, requests[area_col] == first["area_name"], "left")
    return j.select(
        requests[area_col].alias("area"),
        F.coalesce(F.col("p.lat"), F.lit(vocab.DEFAULT_POINT[0])).alias("lat"),
        F.coalesce(F.col("p.lon"), F.lit(vocab.DEFAULT_POINT[1])).alias("lon"),
    )


SAMPLE_BUCKET_BITS = 20


def sample_n(df: DataFrame, n: int, seed: str = "42", key: str = "dr_no") -> DataFrame:
    """L1: min(n, rows) rows without replacement: those of the smallest seeded key hashes, ties by key.

    A histogram of 2^20 buckets of the hash finds the bucket at which the sample is full; rows of earlier buckets are
    taken by a filter, and only that bucket's rows are ranked for what is still due. So no task holds the sample,
    however large it is. A null key hashes as such and comes first.
    """
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed)))
    bucket = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.conv(F.substring(digest, 1, SAMPLE_BUCKET_BITS // 4), 16, 10).cast("int"))
    keyed = df.withColumn("_bucket", bucket)
    # one row a bucket, whatever the number of rows
    upto = F.sum("c").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    full = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", upto).filter(F.col("upto") >= n).agg(F.min(F.struct("_bucket", "c", "upto")).alias("at")).first()["at"]
    if full is None:  # fewer rows than asked for
        return df
    due = n - (full["upto"] - full["c"])
    whole = keyed.filter(F.col("_bucket") < full["_bucket"]).drop("_bucket")
    edge = keyed.filter(F.col("_bucket") == full["_bucket"]).drop("_bucket")
    return whole.unionByName(edge if due == full["c"] else edge.orderBy(digest, F.col(key)).limit(due))


def heat_points(df: DataFrame, n: int = 2000, seed: str = "42") -> DataFrame:
    """L2: at most ``n`` (lat, lon) pairs of the selection for a heat map."""
    return sample_n(df, n, seed).select("lat", "lon")


def context_heat_points(df: DataFrame, n: int = 1000, seed: str = "context") -> DataFrame:
    """L3: at most ``n`` background (lat, lon) pairs (another seed)."""
    return sample_n(df, n, seed).select("lat", "lon")
