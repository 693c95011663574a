"""Prediction requests as a stream: score each micro-batch and append it to the prediction log.

This is the request-at-a-time prediction service of the original application
(score one request, then prepend it to the user's history) re-expressed as a
Structured Streaming query: requests arrive as files, every micro-batch is
scored in one distributed pass, and its entries become one batch of the log.
The checkpoint location (under the cluster's shared checkpoint folder) makes
the query restartable; a replayed micro-batch replaces its own entries. No
state is kept between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from urbanlens.session import fresh_dir
from urbanlens.sources.history import append_log, entries

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("area", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("sex", T.StringType()),
    ]
)


def request_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of prediction requests dropped into ``source_dir``."""
    r = spark.readStream.schema(REQUEST_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir)


def run_to_log(requests: DataFrame, scorer: Callable[[DataFrame], DataFrame], log_dir: str, checkpoint_dir: str | None = None,
               available_now: bool = True):
    """Score every micro-batch of ``requests`` and add it to the prediction log; ``available_now`` processes what is there
    and stops.

    A micro-batch is a batch of the log, named by its number, so one that is replayed after a failure replaces its own
    entries. The entries are those that a batch job writes (:func:`urbanlens.sources.history.entries`).
    """
    ckpt = checkpoint_dir or fresh_dir(requests.sparkSession, "stream-ckpt")

    def add(batch: DataFrame, number: int) -> None:
        append_log(entries(scorer(batch)), log_dir, f"stream-{number}")

    w = requests.writeStream.foreachBatch(add).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
