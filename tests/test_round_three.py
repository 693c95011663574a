"""Box joins over nested cells, the two-headed classifier, the log's folders, exact splits and samples, date layouts."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from urbanlens.operators import features as FE
from urbanlens.operators import geo as G
from urbanlens.operators import models as M
from urbanlens.operators.network import Network

POINTS = "point_id long, lat double, lon double"
INCIDENTS = "dr_no long, lat double, lon double, crm_cd_desc string"


def _near(inc, la, lo, half=0.002):
    return [c for _, a, o, c in inc if a is not None and o is not None and la - half <= a <= la + half and lo - half <= o <= lo + half]


def _mode(types):
    known = [t for t in types if t is not None]
    return min(set(known), key=lambda t: (-known.count(t), t)) if known else None


def _check(spark, inc, pts):
    idf, pdf = spark.createDataFrame(inc, INCIDENTS), spark.createDataFrame(pts, POINTS)
    want = [(p, _near(inc, la, lo) if la is not None and lo is not None else []) for p, la, lo in pts]
    assert sorted(map(tuple, G.incidents_near_point(pdf, idf).collect())) == sorted((p, len(t)) for p, t in want)
    modes = sorted(map(tuple, G.mode_near_point(pdf, idf).select("point_id", "n_incidents", "top_crime").collect()), key=str)
    assert modes == sorted(((p, len(t), _mode(t)) for p, t in want if t), key=str)


# few distinct values, so that coordinates fall on cell and box edges, and dense clumps that split cells down to the last level
coordinate = st.one_of(
    st.integers(-12, 12).map(lambda i: i * 0.0005),
    st.integers(-40, 40).map(lambda i: 0.002 + i * 0.00003),
    st.floats(-0.01, 0.01),
)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(coordinate, coordinate, st.sampled_from(["a", "b", "c", None])), min_size=1, max_size=250),
       st.lists(st.tuples(coordinate, coordinate), min_size=1, max_size=40))
def test_box_join_property(spark, incidents, points):
    inc = [(i, 34.05 + a, -118.25 + o, c) for i, (a, o, c) in enumerate(incidents)]
    _check(spark, inc, [(j, 34.05 + a, -118.25 + o) for j, (a, o) in enumerate(points)])


def test_box_join_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    inc = [(1, 34.0, -118.3, "a"), (2, None, -118.3, "a"), (3, 34.0, None, "a"), (4, nan, nan, "a"), (5, inf, -118.3, "a"), (6, 34.0, -118.3, None), (7, 0.0, 0.0, "z")]
    pts = [(1, 34.0, -118.3), (1, 34.0, -118.3), (2, None, -118.3), (3, 34.002, -118.302), (5, 0.0, 0.0)]
    _check(spark, inc, pts)
    got = G.incidents_near_point(spark.createDataFrame([(8, nan, 0.0), (9, inf, 0.0), (10, -inf, nan)], POINTS), spark.createDataFrame(inc, INCIDENTS))
    assert {tuple(r) for r in got.collect()} == {(8, 0), (9, 0), (10, 0)}
    _check(spark, [(1, None, None, None)], pts)


def test_a_hot_cell_costs_a_point_its_border(spark):
    """40,000 coordinates in one first-level cell: points hand on sums of cells, and test a small share of coordinates."""
    rnd = random.Random(1)
    inc = [(i, 34.0 + 0.006 * rnd.random(), -118.3 + 0.006 * rnd.random(), rnd.choice("abc")) for i in range(40_000)]
    pts = [(j, 34.0 + 0.006 * rnd.random(), -118.3 + 0.006 * rnd.random()) for j in range(60)]
    idf, pdf = spark.createDataFrame(inc, INCIDENTS), spark.createDataFrame(pts, POINTS)
    got = {r.point_id: r.n_incidents for r in G.incidents_near_point(pdf, idf).collect()}
    la, lo = (np.array([r[i] for r in inc]) for i in (1, 2))
    for p, a, o in pts:
        assert got[p] == int(((la >= a - 0.002) & (la <= a + 0.002) & (lo >= o - 0.002) & (lo <= o + 0.002)).sum())
    matched = G.box_matches(pdf, idf, ["point_id"]).count()
    assert matched < 0.2 * sum(got.values())
    # histograms: cells inside hand on as many pairs as there are types
    hists = G.box_matches(pdf, idf, ["point_id"], with_type=True)
    assert max(len(r.hist) for r in hists.collect()) <= 3
    assert hists.count() == matched


# ---------------------------------------------------------------- classifier
def test_gradient_by_finite_differences():
    rng = np.random.default_rng(2)
    net = Network(4, (6, 5), 4, 3, 3, 2)
    x, labels = rng.normal(size=(20, 4)), [rng.integers(0, 3, 20), rng.integers(0, 2, 20)]
    w = net.first(1) + rng.normal(size=net.size()) * 0.1
    losses, slope = net.gradient(w, x, labels)
    assert np.allclose(losses, net.losses(w, x, labels))
    joint = lambda v: np.dot(net.losses(v, x, labels), [1.0, 0.5])
    for i in rng.choice(net.size(), 40, replace=False):
        step = np.zeros(net.size())
        step[i] = 1e-6
        assert abs((joint(w + step) - joint(w - step)) / 2e-6 - slope[i]) < 1e-4 * max(1, abs(slope[i]))
    assert all(np.allclose(p.sum(axis=1), 1) for p in net.predict(w, x))


def test_minimize_keeps_the_best_watched_vector():
    bowl = lambda x: (float(((x - 3) ** 2).sum()), 2 * (x - 3), None)
    assert np.allclose(M.minimize(bowl, np.zeros(5), 50, 5), 3, atol=1e-4)
    # the watched loss is least near 1: the way to 3 passes it and goes on, but what is kept is near
    watched = lambda x: (float(((x - 3) ** 2).sum()), 2 * (x - 3), abs(float(x[0]) - 1))
    assert abs(M.minimize(watched, np.zeros(1), 50, 5)[0] - 1) <= 1
    broken = lambda x: (float("nan"), np.full(2, np.nan), float("nan"))
    assert (M.minimize(broken, np.ones(2), 5, 2) == 1).all()


def _training(spark, n=600, role=True):
    """Two types that the coordinates tell apart, one severity each."""
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        rows.append((i, 2020, 34.0 + 0.1 * bad + 0.02 * rnd.random(), -118.3, 100 * (i % 24), 20 + i % 50, i % 3, 1 + i % 12, 0.0, 0.0, i % 7, "ROBBERY" if bad else "VANDALISM", "PELIGROSO" if bad else "SEGURO", "test" if i % 5 == 0 else "validation" if i % 5 == 1 else "fit"))
    schema = "dr_no long, year int, lat double, lon double, time_occ int, vict_age int, vict_sex int, month_num int, premis_cd double, weapon_used_cd double, day_of_week int, crm_cd_desc string, severity string, role string"
    df = spark.createDataFrame(rows, schema)
    return df if role else df.drop("role")


def test_classifier_learns_and_counts_the_whole_frame(spark):
    frame = _training(spark)
    m = M.fit_models(frame, max_iter=25)
    assert m.type_counts == {"ROBBERY": 200, "VANDALISM": 400} and m.severity_counts == {"PELIGROSO": 200, "SEGURO": 400}
    lat = np.array([r.lat for r in frame.collect()])
    assert np.allclose(m.stats["lat"], (lat.mean(), lat.std())) and m.stats["year"] == (2020.0, 1.0)
    test = frame.filter("role = 'test'")
    matrix = M.confusion(m, test).collect()
    assert sum(r.n for r in matrix if r.target == "type") == test.count() == sum(r.n for r in matrix if r.target == "severity")
    found = {r.target: (r.accuracy, r.n_test) for r in M.accuracy(m, test).collect()}
    for t, (a, n) in found.items():
        assert n == 120 and a == sum(r.n for r in matrix if r.target == t and r.actual == r.predicted) / n > 0.95
    assert M.accuracy(m, test.limit(0)).count() == 0


def test_classifier_without_validation_rows_or_with_one_class(spark):
    frame = _training(spark, 90, role=False)
    assert M.accuracy(M.fit_models(frame, max_iter=10), frame).filter("target = 'type'").first().accuracy > 0.7
    one = frame.filter("severity = 'SEGURO'")
    m = M.fit_models(one, max_iter=2)
    request = spark.createDataFrame([(34.0, -118.3, 2020, 1, 1, 1, 30, "M")], "lat double, lon double, year int, month int, day_of_week int, hour int, age int, sex string")
    r = M.score(m, request).first()
    assert (r.severity, r.severity_confidence, r.prediction, len(r.top_3)) == ("SEGURO", 1.0, "VANDALISM", 1)


def test_one_bad_request_leaves_the_others_scored(spark):
    m = M.fit_models(_training(spark, 90), max_iter=2)
    good = (34.0, -118.3, 2020, 1, 1, 1, 30, "M")
    rows = [(1, *good), (2, *good)] + [(10 + i, *good[:i], None, *good[i + 1 :]) for i in range(8)] + [(30, float("nan"), *good[1:]), (1, *good)]
    req = spark.createDataFrame(rows, "_f0 long, lat double, lon double, year int, month int, day_of_week int, hour int, age int, sex string")
    out = M.score(m, req)
    got = {r["_f0"]: r for r in out.collect()}
    assert out.count() == len(rows) and out.columns[: len(req.columns)] == req.columns
    assert {i for i, r in got.items() if r.prediction is None} == {*range(10, 18), 30}
    assert all(r.severity_confidence is None and r.top_3 is None for i, r in got.items() if i >= 10) and got[1].top_3 == got[2].top_3
    plan = M.probabilities(m, req.select(*[F.lit(0.0).alias(c) for c in m.feature_cols]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()  # written: a filter on top can't run it again


def test_saved_versions(spark, tmp_path):
    path = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        M.load_models(spark, path)
    a, b = (M.fit_models(_training(spark, n), max_iter=1) for n in (60, 90))
    first = M.save_models(a, path, spark)
    # a save that fails before it points to its version leaves the former one
    spark.range(1).write.parquet(f"{path}/versions/half/weights")
    assert (M.load_models(spark, path).weights == a.weights).all()
    M.save_models(b, path, spark)
    loaded = M.load_models(spark, path)
    assert (loaded.weights == b.weights).all() and loaded.stats == b.stats and loaded.type_counts == b.type_counts
    assert M.load_models(spark, path, first).type_counts == a.type_counts
    spark.createDataFrame([(0, 0.0)], "i long, weight double").write.mode("overwrite").parquet(f"{path}/versions/{first}/weights")
    with pytest.raises(ValueError, match="isn't what was saved"):
        M.load_models(spark, path, first)


# ---------------------------------------------------------------- splits, samples, dates, types
def test_exact_split_without_keys(spark):
    rows = [(None if i % 5 < 2 else i, "a") for i in range(100)] + [(None, "b")] * 10 + [(7, "c")] * 10 + [(i, None) for i in range(20)]
    out = FE.stratified_split_exact(spark.createDataFrame(rows, f"dr_no long, {FE.TARGET} string"))
    assert out.count() == len(rows) and out.columns == ["dr_no", FE.TARGET, "split"]
    test = {r[FE.TARGET]: r["n"] for r in out.filter("split = 'test'").groupBy(FE.TARGET).agg(F.count("*").alias("n")).collect()}
    assert test == {"a": 20, "b": 2, "c": 2, None: 4}
    assert out.filter(f"split = 'test' and {FE.TARGET} = 'a' and dr_no is null").count() == 0


def test_exact_sample(spark):
    import hashlib

    from urbanlens.operators import dashboard as D

    keys = [*range(3000), *([5] * 40)]
    df = spark.createDataFrame([(k, "x") for k in keys], "dr_no long, _bucket string")
    order = sorted(keys, key=lambda k: (hashlib.md5(f"{k}42".encode()).hexdigest(), k))
    for n in (0, 1, 700, 2999, 3040, 9999):
        got = D.sample_n(df, n)
        assert sorted(r.dr_no for r in got.select("dr_no").collect()) == sorted(order[:n]), n
    hot = spark.createDataFrame([(None if i < 60 else 1,) for i in range(100)], "dr_no long")
    assert [D.sample_n(hot, n).count() for n in (10, 60, 75, 100)] == [10, 60, 75, 100]


def test_more_date_layouts(spark):
    from urbanlens.functions.calendar import parse_date

    texts = ["2020-01-08 00:00", "2020-01-08T00:00", "20200108", "1/8/2020 12:00 AM", "Jan 8, 2020", "January 8, 2020", "8 Jan 2020", "8-Jan-2020", "2020-1-8", "2020/1/8 7:05", "1-8-2020", "Jan 8, 2020 7:05 PM", "20200108T070500"]
    junk = ["2020", "20201", "8", "Jan 2020", "2020-13-45", "32/1/2020", ""]
    df = spark.createDataFrame([(t,) for t in [*texts, *junk]], "t string").select("t", parse_date(F.col("t")).alias("d"))
    assert {r.t: r.d for r in df.collect()} == {**dict.fromkeys(texts, dt.date(2020, 1, 8)), **dict.fromkeys(junk)}


def test_a_type_named_like_all_types(spark):
    from urbanlens.operators import questions as Q

    rows = [("*", 2019, 1)] * 4 + [("*", 2020, 1)] + [("ROBBERY", 2020, 1)] * 9 + [("ROBBERY", 2021, 1)] * 3
    inc = spark.createDataFrame(rows, "crm_cd_desc string, year int, time_occ int").withColumn("area_name", F.lit("x"))
    got = {r.crime: (r.prev_year, r.last_year, r.prev_count, r.last_count) for r in Q.yearly_trend(inc).collect()}
    assert got == {"*": (2019, 2020, 4, 1), "ROBBERY": (2020, 2021, 9, 3), None: (2020, 2021, 10, 3)}
    answers = Q.answer_questions(spark.createDataFrame([(1, "tendencia"), (2, "tendencia de robos"), (3, None)], "question_id long, text string"), inc)
    said = {r.question_id: r.answer for r in answers.collect()}
    assert "'todos los crímenes' ha **bajado** un 70.0%" in said[1] and "'ROBBERY' ha **bajado** un 66.7%" in said[2] and said[3]


def test_areas_are_found_by_an_index(spark):
    from urbanlens.operators import questions as Q

    rnd = random.Random(3)
    names = sorted({"".join(rnd.choice("abÉ ") for _ in range(rnd.randrange(0, 7))) for _ in range(300)})
    inc = spark.createDataFrame([(n, 1) for n in names] + [(None, 1)], "area_name string, time_occ int")
    texts = [None, "", "a"] + ["".join(rnd.choice("abÉ xB") for _ in range(rnd.randrange(0, 60))) for _ in range(40)]
    qs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "another text of one id")], "question_id long, text string")
    out = Q.areas_found(Q.question_features(qs), inc)
    got = sorted((r.question_id, r.text or "", [x.area for x in r.found]) for r in out.collect())
    want = sorted((i, t or "", [] if t is None else [n for n in names if n.lower() in t.lower()]) for i, t in [*enumerate(texts), (3, "another text of one id")])
    assert got == want
    joins = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in joins


def test_junk_years_are_an_error_not_columns(spark):
    from urbanlens.operators.explore import year_month_pivot

    day = dt.date
    df = spark.createDataFrame([(1, day(2020, 1, 5)), (2, day(2021, 12, 5)), (3, None)], "dr_no long, date_occ date").withColumns({"year": F.year("date_occ"), "month": F.date_format("date_occ", "yyyy-MM")})
    assert year_month_pivot(df).columns == ["year", "2020-01", "2021-12"]
    junk = df.withColumn("date_occ", F.when(F.col("dr_no") == 1, F.lit(day(1203, 1, 1))).otherwise(F.col("date_occ")))
    with pytest.raises(ValueError, match="1203-01-01"):
        year_month_pivot(junk)
    assert year_month_pivot(df.limit(0)).count() == 0


# ---------------------------------------------------------------- log and curated table
def test_user_history_scans_the_users_folders(spark):
    from urbanlens.operators import history as H
    from urbanlens.session import fresh_dir
    from urbanlens.sources import history as HS

    rows = [(i, f"user_{i % 20}", "Central", 34.0, -118.3, 2020, 1, 2, 3, 30, "M", "ROBBERY", 0.5, "PELIGROSO", 0.9, f"2024-01-0{1 + i % 3} 10:00:00") for i in range(200)]
    scored = spark.createDataFrame(rows, "request_id int, user_name string, area string, lat double, lon double, year int, month int, day_of_week int, hour int, age int, sex string, prediction string, confidence double, severity string, severity_confidence double, at string")
    log = HS.entries(scored, F.col("at").cast("timestamp"))
    assert log.schema.simpleString() == HS.LOG_SCHEMA.simpleString()
    path = fresh_dir(spark, "log-folders")
    HS.append_log(log, path, "a")
    HS.append_log(log.withColumn("timestamp", F.lit("no time")).limit(1), path, "b")
    g = HS.read_log(spark, path)
    assert g.count() == 201 and g.filter("day is null").count() == 1
    mine = H.user_history(g.filter("batch = 'a'"), "user_7")
    assert [r.log_id for r in mine.collect()] == sorted([r[0] for r in rows if r[1] == "user_7"], key=lambda i: (-(i % 3), -i))
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "user_part" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {r.user_part for r in g.filter("user_name = 'user_7'").collect()} == {g.filter("user_name = 'user_7'").select(HS.user_part(F.col("user_name"))).first()[0]}


def test_curated_write_scans_once(spark):
    from urbanlens.session import fresh_dir
    from urbanlens.sources import incidents as I

    path, raw = fresh_dir(spark, "one-scan"), fresh_dir(spark, "one-scan-raw")
    rows = [(i, f"20{10 + i % 3}-01-08" if i % 4 else "junk", 1200, "Central", "ROBBERY", 30, "M", None, None, None, "34.05", "0" if i % 7 == 0 else "-118.2") for i in range(300)]
    spark.createDataFrame(rows, I.RAW_SCHEMA).write.parquet(raw)
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    source = spark.read.parquet(raw)
    counts = I.curate(source.mapInArrow(count, source.schema), path)
    dated, valid = sum(1 for r in rows if r[1] != "junk"), sum(1 for r in rows if r[1] != "junk" and r[11] != "0")
    assert counts == {"loaded_rows": 300, "dated_rows": dated, "valid_rows": valid}
    assert reads.value == 300
    assert spark.read.parquet(path).count() == valid and {r.year for r in spark.read.parquet(path).select("year").distinct().collect()} == {2010, 2011, 2012}
