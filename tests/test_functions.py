"""Literal edge rows for the scalar expressions (traps T1-T6, T10, T21 of the blueprint)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from urbanlens.functions import calendar, coords, text


def _one(spark, expr, value, dtype):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


def _loop_rescale(v, limit):
    if v is None or math.isnan(v) or math.isinf(v):
        return None
    while abs(v) > limit and abs(v) > 0:
        v /= 10.0
    return v


def test_rescale_matches_loop(spark):
    values = [340141.0, -1182739.0, 90.0, 90.0000001, 0.0, 34.05, -118.24, 1e300, -7.5e12, 180.0, 180.5]
    for limit in (90, 180):
        rows = spark.createDataFrame([(v,) for v in values], "v double").select(
            "v", coords.rescale_coordinate(F.col("v"), limit).alias("r")
        ).collect()
        for r in rows:
            assert r["r"] == _loop_rescale(r["v"], limit), (r["v"], limit)


def test_coerce_double(spark):
    rows = spark.createDataFrame([("34.5",), ("n/a",), ("NaN",), ("Infinity",), ("-Infinity",), (None,), ("0",)], "v string")
    got = [r[0] for r in rows.select(coords.coerce_double(F.col("v"))).collect()]
    assert got == [34.5, None, None, None, None, None, 0.0]


def test_hours_two_rules(spark):
    clipped = [_one(spark, calendar.hour_clipped, t, "int") for t in (-50, 2400, 1330, 59)]
    modular = [_one(spark, calendar.hour_modular, t, "int") for t in (-50, 2400, 1330, 59)]
    assert clipped == [0, 23, 13, 0]
    assert modular == [23, 0, 13, 0]


def test_weekday_monday_zero(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 7),)], "d date")
    assert [r[0] for r in d.select(calendar.weekday_monday0(F.col("d"))).collect()] == [0, 6]


def test_parse_date_formats(spark):
    vals = ["2020-01-08", "01/08/2020 12:00:00 AM", "not-a-date", None, "2020-01-08 10:00:00"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string").select(calendar.parse_date("v")).collect()]
    assert got == [dt.date(2020, 1, 8), dt.date(2020, 1, 8), None, None, dt.date(2020, 1, 8)]


def test_severity(spark):
    vals = [None, "THEFT, PERSON", "THEFT OF IDENTITY", "VANDALISM", "theft plain", "BATTERY - SIMPLE ASSAULT"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string").select(text.classify_severity(F.col("v"))).collect()]
    assert got == ["PELIGROSO", "PELIGROSO", "SEGURO", "SEGURO", "SEGURO", "PELIGROSO"]


def test_translate(spark):
    vals = ["", None, "theft plain - petty", "SHOPLIFTING - PETTY THEFT", "ZZZ", "BURGLARY FROM VEHICLE"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string").select(text.translate_crime(F.col("v"))).collect()]
    assert got == ["Desconocido", "Desconocido", "HURTO MENOR", "HURTO", "ZZZ", "ROBO DE VEHÍCULO"]


def test_question_terms_order(spark):
    vals = ["Tendencia de robos", "robo menor en la zona", "asesinatos", "hola"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string").select(text.question_crime(F.col("v"))).collect()]
    assert got == ["ROBBERY", "ROBBERY", "HOMICIDE", None]


def test_sex_duration_cut_address(spark):
    sex = [r[0] for r in spark.createDataFrame([("F",), ("M",), ("X",), ("H",), (None,)], "v string").select(
        text.encode_sex(F.col("v"))).collect()]
    assert sex == [0, 1, 2, 2, 2]
    dur = [r[0] for r in spark.createDataFrame([(0,), (59,), (60,), (135,)], "v int").select(text.duration_text(F.col("v"))).collect()]
    assert dur == ["0 min", "59 min", "1h 0min", "2h 15min"]
    long = "x" * 51
    cut = [r[0] for r in spark.createDataFrame([(long,), ("short",)], "v string").select(text.cut_text(F.col("v"), 50)).collect()]
    assert cut == ["x" * 50 + "...", "short"]
    key = spark.createDataFrame([("  Union Station \t",)], "v string").select(text.address_key(F.col("v"))).first()[0]
    assert key == "union station"


def test_city_box(spark):
    rows = [(33.7, -118.7), (34.35, -118.0), (34.36, -118.2), (34.0, -117.9)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, o double").select(coords.in_city_box(F.col("a"), F.col("o"))).collect()]
    assert got == [True, True, False, False]


def test_fixed_matches_python_formatting(spark):
    vals = [0.15, 0.25, 0.35, 0.45, 2.675, 12.25, 1234.55, 0.05, 3.5000000000000004, 28.999999999999996, 99.95, 2400.0, -0.04]
    rows = spark.createDataFrame([(v,) for v in vals], "x double").select(
        "x", text.fixed(F.col("x"), 1).alias("f1"), text.fixed(F.col("x"), 0).alias("f0")).collect()
    for r in rows:
        assert r["f1"] == f"{r['x']:.1f}" and r["f0"] == f"{r['x']:.0f}", r["x"]
