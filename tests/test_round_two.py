"""Rows that real files hold: quoted quotes, whole numbers with a point, other date layouts, doubled headers and keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F


def test_csv_as_it_is_written(spark, tmp_path):
    from urbanlens.sources.incidents import read_incident_csv

    (tmp_path / "a.csv").write_text('DR_NO,Crm Cd Desc,Vict Age,LAT\n7.0,"VEHICLE ""BIG"" THEFT, GRAND",34.0,34.5\n8,plain,34.5,1\n')
    rows = {r.dr_no: r for r in read_incident_csv(spark, str(tmp_path)).collect()}
    assert (rows[7].crm_cd_desc, rows[7].vict_age, rows[7].lat) == ('VEHICLE "BIG" THEFT, GRAND', 34, "34.5")
    assert rows[8].vict_age is None
    assert read_incident_csv(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="(?i)scheme|file ?system|unknown"):
        read_incident_csv(spark, "unknownfs://x/y").count()


def test_published_header_wins(spark):
    from urbanlens.sources.incidents import rename_aliases

    row = rename_aliases(spark.createDataFrame([("alias", "published")], ["area_name", "AREA NAME"])).first()
    assert row.asDict() == {"area_name": "published"}


def test_dates(spark):
    from urbanlens.functions.calendar import parse_date

    day = dt.date(2020, 1, 8)
    texts = ["2020-01-08T00:00:00", "2020-01-08T00:00:00.000", "2020-01-08T05:00:00Z", "1/8/2020", "2020/01/08", "01/08/2020 12:00:00 AM", "1/8/2020 7:05:00 AM", "2020-01-08"]
    df = spark.createDataFrame([(t,) for t in [*texts, "junk", None]], "t string").select("t", parse_date(F.col("t")).alias("d"))
    assert {r.t: r.d for r in df.collect()} == {**dict.fromkeys(texts, day), "junk": None, None: None}


def test_exact_split_keeps_repeated_keys(spark):
    from urbanlens.operators.features import TARGET, stratified_split_exact

    df = spark.createDataFrame([(1, "a")] * 5 + [(i, "b") for i in range(10)], f"dr_no long, {TARGET} string")
    out = stratified_split_exact(df)
    assert out.count() == 15
    assert {(r[TARGET], r["count"]) for r in out.filter("split = 'test'").groupBy(TARGET).count().collect()} == {("a", 1), ("b", 2)}


def test_no_shared_folder_is_an_error():
    from types import SimpleNamespace

    from urbanlens.session import shared_dir

    none = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(none)
