"""History views: a user's predictions newest first (L4), the newest route analyses per user
and the translated top-3 of each logged prediction (P21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanlens.functions import text
from urbanlens.sources.history import user_part


def user_history(log: DataFrame, user: str) -> DataFrame:
    """L4: one user's log entries, newest first (ties: larger log id first).

    Of a log read by :func:`urbanlens.sources.history.read_log` only the folders of the user's part are scanned.
    """
    if "user_part" in log.columns:
        log = log.filter(F.col("user_part") == user_part(F.lit(user)))
    return (
        log.filter(F.col("user_name") == user)
        .select("log_id", "timestamp", "area", text.translate_crime(F.col("result.prediction")).alias("prediction_es"))
        .orderBy(F.col("timestamp").desc(), F.col("log_id").desc())
    )


def latest_routes(analyses: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest route analyses of every user.

    ``row_number() <= n`` lets Spark insert a partial per-task group limit
    before the shuffle, so a user with very many analyses never sends more
    than ``n`` rows per task to the window.
    """
    w = Window.partitionBy("user_name").orderBy(F.col("requested_at").desc(), F.col("trip_id").desc())
    return analyses.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)


def log_top3(log: DataFrame) -> DataFrame:
    """One row per predicted class of each entry: rank, Spanish label, percentage text (1 decimal)."""
    e = log.select("log_id", F.posexplode("result.top_3").alias("pos", "t"))
    return e.select(
        "log_id",
        (F.col("pos") + 1).cast("int").alias("rank"),
        text.translate_crime(F.col("t.crim")).alias("crim_es"),
        F.concat(text.fixed(F.col("t.probabilitat") * 100, 1), F.lit("%")).alias("pct_text"),
    )
