"""Inputs whose files are small and whose rows are many."""

from pyspark.sql import functions as F

from urbanlens.sources import fixtures as X


def small_files(spark, folder, n=200):
    """``n`` customers, each with two orders, and an order of nobody."""
    key = F.col("id")
    spark.range(n).select(key.alias("c_custkey"), (key % 2).alias("c_nationkey")).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "Alfa"), (1, "Beta")], "n_nationkey long, n_name string").write.parquet(f"{folder}/nation.parquet")
    orders = spark.range(1, 2 * n + 2).select(key.alias("o_orderkey"), F.when(key <= 2 * n, key % n).alias("o_custkey"), F.lit("1995-03-04").cast("timestamp").alias("o_orderdate"))
    orders.coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_customers_of_a_small_file_are_never_gathered_in_the_driver(spark, tmp_path):
    folder = small_files(spark, tmp_path)
    for made, joins in ((X.incidents_raw(spark, folder), ["[o_custkey"]), (X.logged_requests(spark, folder), ["[o_custkey", "[request_id"])):
        assert made.count() == 400
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert all(f"SortMergeJoin {on}" in plan for on in joins)
        assert plan.count("BroadcastExchange") == 1  # the nations
    assert {r.area_name for r in X.incidents_raw(spark, folder).filter("dr_no % 101 > 0").collect()} == {"Alfa", "Beta"}
