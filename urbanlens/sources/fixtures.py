"""Stand-in inputs derived from the driver's parquet tables.

The reference ships no data (only a pointer to an external CSV), so every
input table is produced from the TPC-H-style test tables by integer
arithmetic that DuckDB evaluates identically (see FIXTURES.md). These
adapters only produce rows in the schema the jobs expect; they do none of
the jobs' work. Every adapter reads a whole table, so its size grows with
the scale factor.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: incident type list used to label fixture rows (index 0-14).
FIXTURE_CRIMES = [
    "VEHICLE - STOLEN",
    "BATTERY - SIMPLE ASSAULT",
    "THEFT OF IDENTITY",
    "BURGLARY FROM VEHICLE",
    "VANDALISM",
    "THEFT PLAIN - PETTY",
    "BURGLARY",
    "ROBBERY",
    "INTIMATE PARTNER - SIMPLE ASSAULT",
    "TRESPASSING",
    "CRIMINAL THREATS",
    "SHOPLIFTING - PETTY THEFT",
    "AGGRAVATED ASSAULT",
    "RAPE",
    "HOMICIDE",
]


# Layouts of the dates of fixture rows, by the rest of their key.
DATE_LAYOUTS = {
    1: "yyyy-MM-dd '00:00'",
    2: "yyyy-MM-dd'T00:00'",
    3: "yyyyMMdd",
    4: "M/d/yyyy '12:00 AM'",
    5: "MMM d, yyyy",
    6: "MM/dd/yyyy '12:00:00 AM'",
}

#: Trips whose routes one task makes.
TRIPS_A_TASK = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _crime_at(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in FIXTURE_CRIMES]), (idx + 1).cast("int"))


def _coord_text(k: Column, scaled_int: Column) -> Column:
    return (
        F.when(k % 131 == 0, F.lit("n/a"))
        .when(k % 71 == 0, F.lit("0"))
        .when(k % 53 == 0, scaled_int.cast("string"))
        .otherwise((scaled_int / F.lit(10000.0)).cast("string"))
    )


def _date_text(k: Column, day: Column) -> Column:
    """Mostly ISO dates; every so often another layout that files hold, or junk."""
    text = F.when(k % 97 == 0, F.lit("not-a-date"))
    for rest, layout in DATE_LAYOUTS.items():
        text = text.when(k % 29 == rest, F.date_format(day, layout))
    return text.otherwise(day.cast("string"))


def incidents_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw incident rows (orders joined to customer and nation), all text as in a CSV."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # shuffled: the customers' file is small, their rows are as many as the input has
    j = o.join(c.hint("merge"), o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    nk = F.col("n_nationkey").cast("bigint")
    weapon_code = F.lit(400) + F.least(k % 17, F.expr("o_orderkey div 17") % 17)
    lat_i = F.lit(337500) + F.lit(200) * nk + F.lit(2) * (k % 97)
    lon_i = F.lit(-1186500) + F.lit(200) * nk + F.lit(2) * (k % 89)
    return j.select(
        k.alias("dr_no"),
        _date_text(k, F.col("o_orderdate").cast("date")).alias("date_occ"),
        F.when(k % 211 == 0, F.lit(2400)).otherwise(((k * 37) % 24) * 100 + (k * 13) % 60).cast("int").alias("time_occ"),
        F.when(k % 101 == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("area_name"),
        F.when(k % 307 == 0, F.lit(None).cast("string"))
        .when(k % 401 == 0, F.lit("*"))
        .otherwise(_crime_at(F.least(k % 15, F.expr("o_orderkey div 15") % 15)))
        .alias("crm_cd_desc"),
        ((k * 7) % 103 - 3).cast("int").alias("vict_age"),
        F.when(k % 203 == 0, F.lit("H"))
        .when(k % 11 <= 4, F.lit("M"))
        .when(k % 11 <= 8, F.lit("F"))
        .when(k % 11 == 9, F.lit("X"))
        .otherwise(F.lit(None).cast("string"))
        .alias("vict_sex"),
        F.when(k % 19 == 0, F.lit(None).cast("double")).otherwise((F.lit(101) + k % 37).cast("double")).alias("premis_cd"),
        F.when(k % 3 != 0, F.lit(None).cast("double")).otherwise(weapon_code.cast("double")).alias("weapon_used_cd"),
        F.when(k % 3 != 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("WEAPON "), weapon_code.cast("string")))
        .alias("weapon_desc"),
        _coord_text(k, lat_i).alias("lat"),
        _coord_text(k, lon_i).alias("lon"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction requests, one per customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    nk = F.col("n_nationkey").cast("bigint")
    return j.select(
        k.alias("point_id"),
        F.col("n_name").alias("area"),
        ((F.lit(337500) + 200 * nk + 3 * (k % 61)) / F.lit(10000.0)).alias("lat"),
        ((F.lit(-1186500) + 200 * nk + 3 * (k % 67)) / F.lit(10000.0)).alias("lon"),
        F.lit(2002).alias("date_year"),
        (F.lit(1) + k % 12).cast("int").alias("date_month"),
        (k % 7).cast("int").alias("day_of_week"),
        (k % 24).cast("int").alias("hour_of_day"),
        (F.lit(18) + k % 73).cast("int").alias("victim_age"),
        F.element_at(F.array(*[F.lit(s) for s in ["M", "F", "X", "Z"]]), ((k % 4) + 1).cast("int")).alias("victim_sex"),
    )


def _nation_lat(nk: Column) -> Column:
    return (F.lit(337550) + 200 * nk) / F.lit(10000.0)


def _nation_lon(nk: Column) -> Column:
    return (F.lit(-1186450) + 200 * nk) / F.lit(10000.0)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trip requests, one per supplier: origin from the supplier's nation, destination from another."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    t = F.col("s_suppkey")
    nk = F.col("s_nationkey").cast("bigint")
    nk2 = (nk * 7 + 5) % 25
    return s.select(
        t.alias("trip_id"),
        F.concat(F.lit("user_"), (t % 10).cast("string")).alias("user_name"),
        F.when(t % 70 == 0, F.lit(35.0)).otherwise(_nation_lat(nk)).alias("lat1"),
        _nation_lon(nk).alias("lon1"),
        _nation_lat(nk2).alias("lat2"),
        _nation_lon(nk2).alias("lon2"),
        F.date_add(F.lit("2002-01-01").cast("date"), (t % 365).cast("int")).alias("travel_date"),
        (t % 24).cast("int").alias("travel_hour"),
        (F.lit(10) + t % 80).cast("int").alias("age"),
        F.element_at(F.array(F.lit("M"), F.lit("F"), F.lit("X")), ((t % 3) + 1).cast("int")).alias("sex"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (t * 7).cast("int"))).alias(
            "requested_at"
        ),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate routes a road router returned per trip: direct alternatives and one per detour candidate.

    ``path`` is ARRAY<STRUCT<lon, lat>> in travel order, as in GeoJSON.
    """
    tr = trips(spark, sf_dir).select("trip_id", "lat1", "lon1", "lat2", "lon2")
    t = F.col("trip_id")
    n_direct = F.when(t % 9 == 0, F.lit(6)).otherwise(F.lit(1) + t % 3).cast("int")
    direct = tr.select(
        "*", F.posexplode(F.sequence(F.lit(0), n_direct - 1)).alias("_p", "i")
    ).select(
        "*",
        F.col("i").alias("route_seq"),
        F.lit("direct").alias("kind"),
        F.lit(None).cast("int").alias("cand_idx"),
        (F.lit(5000) + (t % 50) * 40 + 150 * F.col("i")).cast("double").alias("distance"),
        F.when((t % 17 == 0) & (F.col("i") == 1), F.lit(None).cast("double"))
        .otherwise((F.lit(600) + (t * 31 + 37 * F.col("i")) % 400).cast("double"))
        .alias("duration"),
    )
    detour = tr.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select(
        "*",
        (F.lit(100) + F.col("i")).cast("int").alias("route_seq"),
        F.lit("waypoint").alias("kind"),
        F.col("i").cast("int").alias("cand_idx"),
        (F.lit(5000) + (t % 50) * 40 + (F.col("i") * (t % 13 + 1) * 23) % 700).cast("double").alias("distance"),
        (F.lit(650) + (t * 17 + 41 * F.col("i")) % 400).cast("double").alias("duration"),
    )
    cols = ["trip_id", "route_seq", "kind", "cand_idx", "distance", "duration", "lat1", "lon1", "lat2", "lon2"]
    both = direct.select(*cols).unionByName(detour.select(*cols))
    # a small file of suppliers becomes many long paths: the rows are dealt out before these are made
    both = both.repartition(-(-tr.count() // TRIPS_A_TASK) or 1, "trip_id")
    n_points = (F.lit(90) + (t % 7) * 60).cast("int")
    shift = (F.col("route_seq") % 10) / F.lit(1000.0)
    path = F.transform(
        F.sequence(F.lit(0), n_points - 1),
        lambda i: F.struct(
            (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * i / (n_points - 1)).alias("lon"),
            (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * i / (n_points - 1) + shift).alias("lat"),
        ),
    )
    return both.select("trip_id", "route_seq", "kind", "cand_idx", "distance", "duration", path.alias("path"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text questions, one per customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("Crímenes entre las "), (k % 24).cast("string"), F.lit(" y las "), ((7 * k + 3) % 24).cast("string")))
        .when(k % 6 == 1, F.concat(F.lit("Compara Nation_"), (k % 25).cast("string"), F.lit(" versus NATION_"), ((3 * k + 1) % 25).cast("string")))
        .when(k % 6 == 2, F.lit("¿Cuál es la tendencia de robos este año?"))
        .when(k % 6 == 3, F.lit("Evolución de homicidios"))
        .when(k % 6 == 4, F.lit("Compara NATION_7"))
        .otherwise(F.lit("hola"))
    )
    return c.select(k.alias("question_id"), text.alias("text"))


def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-point class probability vectors (10 classes), as a classifier emits them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    weights = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: (F.lit(1) + (k * (c + 3)) % 7).cast("double"))
    w = o.select(k.alias("point_id"), weights.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x)
    return w.select("point_id", F.transform("w", lambda x: x / total).alias("probability"))


def class_labels() -> list[str]:
    """Label of class index i for :func:`class_probabilities`."""
    return FIXTURE_CRIMES[:10]


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known places (address key -> lat/lon), one per supplier; some lie outside the city box."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    k = F.col("s_suppkey")
    nk = F.col("s_nationkey").cast("bigint")
    return s.select(
        F.lower(F.trim(F.col("s_name"))).alias("address_key"),
        F.when(k % 9 == 0, F.lit(36.0)).otherwise(_nation_lat(nk)).alias("lat"),
        _nation_lon(nk).alias("lon"),
    )


def address_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses typed by users: supplier names with varied case/padding, plus unknown places per nation."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("s_suppkey")
    known = s.select(
        k.alias("request_id"),
        F.when(k % 2 == 0, F.concat(F.lit("  "), F.upper(F.col("s_name")), F.lit(" ")))
        .when(k % 5 == 1, F.concat(F.col("s_name"), F.lit(", Los Angeles")))
        .otherwise(F.col("s_name"))
        .alias("address"),
    )
    unknown = n.select(
        (F.lit(-1) - F.col("n_nationkey").cast("bigint")).alias("request_id"),
        F.concat(F.lit("Plaza "), F.col("n_name")).alias("address"),
    )
    return known.unionByName(unknown)


def fixture_scores(df: DataFrame, lat: str = "lat", lon: str = "lon", hour: str = "hour") -> DataFrame:
    """Deterministic stand-in for the classifiers so route operators have an exact oracle.

    Adds prediction, confidence, severity, severity_confidence.
    """
    z = (F.floor(F.abs(F.col(lat)) * 10000) + F.floor(F.abs(F.col(lon)) * 10000) + F.col(hour)).cast("bigint")
    return df.withColumn("_z", z).select(
        "*",
        _crime_at(F.col("_z") % 10).alias("prediction"),
        ((F.lit(10) + F.col("_z") % 60) / F.lit(100.0)).alias("confidence"),
        F.when(F.col("_z") % 3 == 0, F.lit("SEGURO")).otherwise(F.lit("PELIGROSO")).alias("severity"),
        ((F.lit(50) + F.col("_z") % 50) / F.lit(100.0)).alias("severity_confidence"),
    ).drop("_z")


def fixture_scorer(df: DataFrame) -> DataFrame:
    """Scorer protocol wrapper: expects columns lat, lon, hour."""
    return fixture_scores(df, "lat", "lon", "hour")


def logged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to log, one per probability vector (each of a known customer's point), dates spread over four weeks, ten
    users: the request's fields, its time and the type head's probabilities."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = points(spark, sf_dir)
    probs = class_probabilities(spark, sf_dir).withColumnRenamed("point_id", "request_id")
    k = F.col("o_orderkey")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        (k % 28).cast("int"), F.lit(0), F.lit(0), ((k * 37) % 86400).cast("int")
    )
    asked = o.join(p.hint("merge"), o.o_custkey == p.point_id).select(
        k.alias("request_id"), at.alias("asked_at"), F.concat(F.lit("user_"), (k % 10).cast("string")).alias("user_name"),
        "area", "lat", "lon", F.col("date_year").alias("year"), F.col("date_month").alias("month"), "day_of_week",
        F.col("hour_of_day").alias("hour"), F.col("victim_age").alias("age"), F.col("victim_sex").alias("sex"),
    )
    return asked.join(probs.hint("merge"), "request_id")
