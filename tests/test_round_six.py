"""The classifier is fitted on all rows of its frame."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanlens.operators import features as FE
from urbanlens.operators import models as M
from urbanlens.plans import catalog as CT


def held(blocks):
    """Rows of the blocks to fit and to validate."""
    return {r.validates: r.n for r in blocks.groupBy("validates").agg(F.sum("n").alias("n")).collect()}


def frame(spark, n, key=None):
    k = F.col("id")
    role = F.when(k % 5 == 0, "test").when(k % 5 == 1, "validation").otherwise("fit")
    return spark.range(n).select((k if key is None else key).alias("dr_no"), (F.lit(2000) + k % 7).cast("int").alias("year"), (34 + k % 97 / 1000).alias("lat"),
                                 F.when(k % 3 == 0, "ROBBERY").otherwise("VANDALISM").alias(FE.TARGET), F.when(k % 3 == 0, "PELIGROSO").otherwise("SEGURO").alias("severity"), role.alias("role"))


def blocks(training):
    feats = FE.select_features(training)
    return M._blocks(training, feats, M.frame_statistics(training, feats), 42)


def test_every_row_of_a_large_frame_is_fitted_or_validates(spark):
    """fit_type_model: more rows than the 400,000 and 100,000 that were once chosen."""
    found = blocks(frame(spark, 750_000)).persist()
    assert held(found) == {False: 450_000, True: 150_000}
    assert found.agg(F.max("n")).first()[0] <= 10_000  # blocks stay small
    found.unpersist()


def test_rows_without_a_key_and_repeated_rows_are_fitted(spark):
    lost = frame(spark, 1_000, F.when(F.col("id") % 2 == 0, F.col("id")))
    assert held(blocks(lost.unionByName(lost))) == {False: 1_200, True: 400}


def test_tasks_of_the_fit_grow_with_the_frame(spark):
    assert [M.fit_tasks(n) for n in (1, 16 * M.TASK_ROWS, 16 * M.TASK_ROWS + 1, 1_000 * M.TASK_ROWS)] == [16, 16, 17, 1_000]
    some = blocks(frame(spark, 50_000))
    dealt = M.dealt_blocks(some, 20)
    assert dealt.rdd.getNumPartitions() == 20 and held(dealt) == held(some)


def test_blocks_longer_than_a_slice_give_the_sums_of_all_rows(spark):
    training = frame(spark, 4_000)
    feats = FE.select_features(training)
    stats = M.frame_statistics(training, feats)
    network = M.Network(len(feats), M.TRUNK, M.TYPE_BRANCH, M.SEVERITY_BRANCH, 2, 2)
    w = network.first(3)
    loss, slope, val = M.Objective(M.dealt_blocks(blocks(training)), network)(w)
    rows = {role: training.filter(F.col("role") == role).collect() for role in ("fit", "validation")}
    x, y = {}, {}
    for role, some in rows.items():
        x[role] = np.column_stack([(np.array([r[c] for r in some], float) - stats["stats"][c][0]) / stats["stats"][c][1] for c in feats])
        y[role] = [np.array([int(r[FE.TARGET] == "VANDALISM") for r in some]), np.array([int(r.severity == "SEGURO") for r in some])]
    (a, b), steep = network.gradient(w, x["fit"], y["fit"])
    assert len(x["fit"]) > M.SLICE and np.isclose(loss, (M.TYPE_WEIGHT * a + M.SEVERITY_WEIGHT * b) / len(x["fit"]))
    assert np.allclose(slope, steep / len(x["fit"])) and np.isclose(val, network.losses(w, x["validation"], y["validation"])[0] / len(x["validation"]))


def test_batches_of_the_fit_are_small_and_the_session_keeps_its_own(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(M, "minimize", lambda f, x, *rest: seen.append(int(spark.conf.get(M.BATCH_BYTES_CONF).rstrip("b"))) or x)
    before = spark.conf.get(M.BATCH_BYTES_CONF)
    M.fit_models(frame(spark, 100))
    assert seen == [M.BATCH_BYTES] and spark.conf.get(M.BATCH_BYTES_CONF) == before


def test_a_row_has_the_same_scores_in_any_batch(spark):
    """stream_predictions_model: a micro-batch scores a request as a batch job does, to the last bit."""
    network = M.Network(10, M.TRUNK, M.TYPE_BRANCH, M.SEVERITY_BRANCH, 10, 2)
    w, x = network.first(1), np.random.default_rng(0).standard_normal((1_000, 10))
    whole = network.predict(w, x)
    for n in range(1, 80):
        assert all((p[:n] == q).all() for p, q in zip(whole, network.predict(w, x[:n]), strict=True)), n
        assert all((p[-n:] == q).all() for p, q in zip(whole, network.predict(w, x[-n:]), strict=True)), n


def small_tables(spark, folder, n=150):
    """``n`` customers with four orders each, and five suppliers."""
    k = F.col("id")
    spark.range(n).select(k.alias("c_custkey"), (k % 3).alias("c_nationkey")).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "Alfa"), (1, "Beta"), (2, "Gamma")], "n_nationkey long, n_name string").coalesce(1).write.parquet(f"{folder}/nation.parquet")
    spark.range(4 * n).select(k.alias("o_orderkey"), (k % n).alias("o_custkey"), F.lit("1995-03-04").cast("timestamp").alias("o_orderdate")).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.range(5).select(k.alias("s_suppkey"), (k % 3).cast("int").alias("s_nationkey")).coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["fit_type_model", "route_risk_model", "stream_predictions_model"])
def test_queries_fit_all_rows_whatever_a_bound_says(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(M, "FIT_ROWS", 50, raising=False)
    monkeypatch.setattr(M, "VALIDATION_ROWS", 10, raising=False)
    folder, fitted, dealt = small_tables(spark, tmp_path), [], M.dealt_blocks
    monkeypatch.setattr(M, "dealt_blocks", lambda blocks, *rest: fitted.append(held(blocks)) or dealt(blocks, *rest))
    rows = CT.REGISTRY[name](spark, folder).collect()
    roles = {r.role: r["count"] for r in CT.split_frame(spark, folder).groupBy("role").count().collect()}
    assert fitted == [{False: roles["fit"], True: roles["validation"]}] and roles["fit"] > 200
    if name == "route_risk_model":
        assert len(rows) == 5 and all(r.is_route and r.is_least and r.is_whole for r in rows)
    if name == "stream_predictions_model":
        assert len(rows) == 150 and all(r.as_batch for r in rows)
