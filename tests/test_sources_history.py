"""Sources (CSV scan, aliases, curated round trip, routes JSON, log), history views, place lookup, streaming."""

import os

from pyspark.sql import functions as F

from urbanlens.operators import clean as C
from urbanlens.operators import history as H
from urbanlens.plans import catalog as CT
from urbanlens.session import fresh_dir
from urbanlens.sources import fixtures as X
from urbanlens.sources import history as HS
from urbanlens.sources import incidents as I
from urbanlens.sources import places as P
from urbanlens.streaming import predictions as ST


def test_csv_scan_missing_and_extra_columns(spark):
    assert I.read_incident_csv(spark, "/nonexistent/path.csv").count() == 0
    path = fresh_dir(spark, "csv-extra")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part.csv"), "w") as f:
        f.write("DR_NO,Date Rptd,DATE OCC,AREA NAME,LAT,LON,Status\n")
        f.write("7,01/01/2020,01/08/2020 12:00:00 AM,Central,34.05,-118.24,IC\n")
        f.write("8,x,junk,,n/a,0,AA\n")
    df = I.read_incident_csv(spark, path)
    assert df.columns == I.RAW_SCHEMA.fieldNames()
    rows = {r["dr_no"]: r for r in df.collect()}
    assert rows[7]["area_name"] == "Central" and rows[7]["time_occ"] is None and rows[8]["lat"] == "n/a"


def test_header_with_byte_order_mark(spark):
    path = fresh_dir(spark, "csv-bom")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part.csv"), "w", encoding="utf-8-sig") as f:
        f.write("DR_NO,DATE OCC,LAT,LON\n9,2020-01-08,34.05,-118.24\n")
    assert I.read_incident_csv(spark, path).first()["dr_no"] == 9


def test_alias_names(spark):
    df = spark.createDataFrame([(1, "34.1", "-118.2", "Central", "2020-01-01")], "DR_NO long, lat string, lon string, area_name string, date_occ string")
    out = I.conform_raw(df)
    assert out.first()["area_name"] == "Central" and out.columns == I.RAW_SCHEMA.fieldNames()


def test_curated_prefers_written_table(spark, sf_small):
    path = fresh_dir(spark, "curated-test")
    clean = CT.clean(spark, sf_small)
    I.write_curated(clean, path)
    back = I.load_incidents(spark, curated_path=path)
    assert back.count() == clean.count() and back.columns == clean.columns
    again = fresh_dir(spark, "curated-audited")
    counts = I.curate(CT.raw(spark, sf_small), again)
    assert counts == C.clean_audit(CT.raw(spark, sf_small)).first().asDict()
    assert counts["valid_rows"] == clean.count()
    assert I.load_incidents(spark, curated_path=again).exceptAll(back).count() == 0


def test_log_append_and_views(spark, sf_small):
    path = fresh_dir(spark, "log-test")
    assert HS.read_log(spark, path).count() == 0
    log = HS.entries(X.fixture_scorer(X.logged_requests(spark, sf_small)), F.col("asked_at"))
    for batch in ("a", "b", "b"):  # a batch that is written again replaces itself
        HS.append_log(log.filter(F.col("log_id") < 40), path, batch)
    assert HS.read_log(spark, path).count() == 2 * log.filter(F.col("log_id") < 40).count()
    g = CT.logged(spark, sf_small)
    hist = H.user_history(g, "user_3").collect()
    keys = [(r["timestamp"], r["log_id"]) for r in hist]
    assert keys == sorted(keys, reverse=True) and len(hist) > 0
    top = H.log_top3(g).filter(F.col("log_id") == hist[0]["log_id"]).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and all(r["pct_text"].endswith("%") for r in top)


def test_latest_routes_caps_per_user(spark):
    rows = [(f"user_{u}", t, t * 10) for u in range(3) for t in range(25)]
    df = spark.createDataFrame(rows, "user_name string, trip_id long, requested_at long")
    out = H.latest_routes(df, 10).collect()
    assert len(out) == 30
    assert all(r["trip_id"] >= 15 for r in out)


def test_place_lookup_outcomes(spark):
    gz = spark.createDataFrame([("union station", 34.056, -118.236), ("far away", 36.0, -118.2)], "address_key string, lat double, lon double")
    req = spark.createDataFrame([(1, "  Union Station "), (2, "Far Away"), (3, "Nowhere, Los Angeles")], "request_id long, address string")
    r = {x["request_id"]: x for x in P.place_lookup(req, gz).collect()}
    assert r[1]["found"] and r[1]["lat"] == 34.056 and r[1]["search_text"] == "  Union Station , Los Angeles, California, USA"
    assert not r[2]["found"] and r[2]["error"] == P.OUTSIDE and r[2]["lat"] is None
    assert not r[3]["found"] and r[3]["error"] == P.NOT_FOUND and r[3]["search_text"] == "Nowhere, Los Angeles"


def test_stream_scoring_matches_batch(spark, sf_small):
    src = CT._request_files(spark, sf_small)
    log = fresh_dir(spark, "stream-log-test")
    ST.run_to_log(ST.request_stream(spark, src, 1), X.fixture_scorer, log)
    same = ["log_id", "user_name", "area", "input", "result"]
    streamed = HS.read_log(spark, log).select(same)
    batch = HS.entries(X.fixture_scorer(spark.read.parquet(src))).select(same)
    assert HS.read_log(spark, log).select("batch").distinct().count() == 4
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_training_job_end_to_end(spark, sf_small):
    from urbanlens import jobs
    from urbanlens.operators.models import load_models

    csv = fresh_dir(spark, "job-csv")
    I.write_incident_csv(CT.raw(spark, sf_small), csv)
    out = fresh_dir(spark, "job-out")
    s = jobs.training_job(spark, csv, out, sample=1000)
    assert s["audit"]["loaded_rows"] == 1000 and s["audit"]["valid_rows"] > 0
    assert spark.read.parquet(s["outputs"]["top_crimes"]).count() > 0
    assert set(s["models"]["accuracy"]) == {"type", "severity"}
    loaded = load_models(spark, s["models"]["path"])
    assert loaded.type_labels == s["models"]["type_labels"]


def test_training_job_cli(spark, sf_small, capsys):
    import json

    from urbanlens import jobs

    csv = fresh_dir(spark, "cli-csv")
    I.write_incident_csv(CT.raw(spark, sf_small), csv)
    out = fresh_dir(spark, "cli-out")
    jobs.main(["--input", csv, "--out", out, "--no-explore"])
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert summary["audit"]["loaded_rows"] == CT.raw(spark, sf_small).count()
    assert list(summary["outputs"]) == ["curated"] and summary["models"]["path"].endswith("models")
