"""Plans and tasks at size: what small files of many rows, and small rows of much work, may not do."""

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from urbanlens.operators import geo as G
from urbanlens.operators import models as M
from urbanlens.operators import questions as Q
from urbanlens.operators import routes as R
from urbanlens.sources import fixtures as X


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_questions_of_a_small_file_are_never_gathered_in_the_driver(spark, tmp_path):
    asked = spark.range(30_000).select(F.col("id").alias("question_id"), F.lit("Compara Alfa versus BETA").alias("text"))
    asked.coalesce(1).write.parquet(f"{tmp_path}/q")
    crimes = spark.createDataFrame([Row(area_name=a) for a in ("Alfa", "Beta", "Beta", "Gamma", None)], "area_name string")
    found = Q.areas_found(Q.question_features(spark.read.parquet(f"{tmp_path}/q")), crimes)
    assert "BroadcastExchange" not in plan(found)
    got = {tuple((a.area, a.n) for a in r.found): r.n for r in found.groupBy("found").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(("Alfa", 1), ("Beta", 2)): 30_000}


def test_repeated_ids_of_questions_keep_their_own_areas(spark):
    rows = [(1, "alfa"), (1, "beta"), (1, "alfa"), (None, "alfa"), (2, None), (3, "delta")]
    asked = Q.question_features(spark.createDataFrame(rows, "question_id long, text string"))
    crimes = spark.createDataFrame([Row(area_name=a) for a in ("Alfa", "Beta")])
    got = sorted([(r.question_id or 0, r.text or "", [a.area for a in r.found]) for r in Q.areas_found(asked, crimes).collect()])
    assert got == [(0, "alfa", []), (1, "alfa", ["Alfa"]), (1, "alfa", ["Alfa"]), (1, "beta", ["Beta"]), (2, "", []), (3, "delta", [])]


def suppliers(spark, folder, n):
    spark.range(n).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey")).coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def test_routes_of_a_small_file_of_suppliers_are_made_in_many_tasks(spark, tmp_path):
    n = 4 * X.TRIPS_A_TASK
    made = X.routes(spark, suppliers(spark, tmp_path, n)).select("trip_id", F.spark_partition_id().alias("task"))
    tasks = made.groupBy("task").agg(F.count_distinct("trip_id").alias("n")).collect()
    assert sum(r.n for r in tasks) == n and max(r.n for r in tasks) < 2 * X.TRIPS_A_TASK
    assert made.count() == sum((6 if t % 9 == 0 else 1 + t % 3) + 10 for t in range(n))


def test_points_and_zones_of_trips_are_dealt_over_the_tasks(spark, tmp_path):
    trips = X.trips(spark, suppliers(spark, tmp_path, 200))
    seen = []

    def scorer(df):
        seen.append(df)
        return X.fixture_scorer(df)

    zones = R.danger_zones(trips, scorer)
    dealt = lambda df: df.select(F.spark_partition_id()).distinct().count()
    assert dealt(seen[0]) == dealt(R.zone_lists(zones)) == 8


def model():
    layers = {"trunk": list(M.TRUNK), "type": M.TYPE_BRANCH, "severity": M.SEVERITY_BRANCH}
    feats = ["year", "lat", "lon", "time_occ", "vict_age", "vict_sex", "month_num", "day_of_week"]
    m = M.IncidentModels(np.empty(0), layers, ["a", "b", "c"], ["x", "y"], feats, {c: (0.0, 1.0) for c in feats}, {}, {})
    m.weights = m.network().first(1)
    return m


def test_scored_requests_of_a_small_file_are_never_gathered_in_the_driver(spark, tmp_path):
    asked = spark.range(3_000).select("id", *[F.lit(v).alias(c) for c, v in {"lat": 34.0, "lon": -118.3}.items()], (F.col("id") % 7).cast("int").alias("year"),
                                      *[F.lit(1).alias(c) for c in ("month", "day_of_week", "hour", "age")], F.lit("M").alias("sex"))
    asked.coalesce(1).write.parquet(f"{tmp_path}/asked")
    out = M.score(model(), spark.read.parquet(f"{tmp_path}/asked"))
    assert "BroadcastExchange" not in plan(out)
    assert out.filter("size(top_3) = 3 and prediction = top_3[0].crim").count() == 3_000


def test_one_row_of_sums_comes_back_for_each_task(spark):
    m = model()
    rnd, k, rows = np.random.default_rng(1), len(m.feature_cols), []
    for i in range(60):
        n = 5 + i % 3
        x, t, s = rnd.random((n, k)), rnd.integers(0, 3, n).astype("<i4"), rnd.integers(0, 2, n).astype("<i4")
        rows.append((i % 4 == 0, n, bytearray(x.tobytes()), bytearray(t.tobytes()), bytearray(s.tobytes())))
    blocks = M.dealt_blocks(spark.createDataFrame(rows, "validates boolean, n long, x binary, types binary, severities binary"))
    returned = []

    class Seen:
        def mapInArrow(self, f, schema):
            out = blocks.mapInArrow(f, schema)
            returned.append(out.groupBy("validates").count().collect())
            return out

    loss, slope, val = M.Objective(Seen(), m.network())(m.weights)
    assert all(r["count"] <= M.FIT_TASKS for r in returned[0])
    sums, steep, n, v, n_v = 0.0, 0.0, 0, 0.0, 0
    for validates, size, x, t, s in rows:
        x, labels = np.frombuffer(x).reshape(size, -1), [np.frombuffer(c, "<i4") for c in (t, s)]
        if validates:
            v, n_v = v + m.network().losses(m.weights, x, labels)[0], n_v + size
        else:
            (a, b), g = m.network().gradient(m.weights, x, labels)
            sums, steep, n = sums + M.TYPE_WEIGHT * a + M.SEVERITY_WEIGHT * b, steep + g, n + size
    assert np.isclose(loss, sums / n) and np.allclose(slope, steep / n) and np.isclose(val, v / n_v)


def test_the_box_join_reads_incidents_and_points_once(spark, tmp_path):
    spark.range(500).select((F.lit(34.0) + F.col("id") % 50 / 10_000).alias("lat"), F.lit(-118.0).alias("lon"), F.lit("T").alias("crm_cd_desc")).write.parquet(f"{tmp_path}/inc")
    pts = spark.createDataFrame([(1, 34.0, -118.0), (2, 34.0, -118.0), (3, 40.0, -118.0)], "point_id long, lat double, lon double")
    out = G.mode_near_point(pts, spark.read.parquet(f"{tmp_path}/inc"))
    assert f"{tmp_path}/inc" not in out._jdf.queryExecution().optimizedPlan().toString() and "/inc" not in "".join(out.inputFiles())
    assert {tuple(r) for r in out.collect()} == {(1, 210, "T"), (2, 210, "T")}
