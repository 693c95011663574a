"""Questions as a stream: every micro-batch of questions is answered and written to an answers table.

The question service of the original application answers one message at a
time from statistics loaded at start-up. Here the statistics are prepared
once when the stream starts (:class:`urbanlens.operators.questions.Answerer`:
one scan of the incident table, checkpointed), questions arrive as files, and
``foreachBatch`` answers each micro-batch with a projection plus a broadcast
join. Each batch is written to its own folder with overwrite, so a batch
replayed after a failure replaces its own output instead of duplicating it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from urbanlens.operators.questions import Answerer
from urbanlens.session import fresh_dir

QUESTION_SCHEMA = T.StructType([T.StructField("question_id", T.LongType()), T.StructField("text", T.StringType())])


def question_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(QUESTION_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir)


def run_answers(questions: DataFrame, answerer: Answerer, sink_dir: str, checkpoint_dir: str | None = None,
                available_now: bool = True):
    """Answer every micro-batch and write it to ``sink_dir/batch=<id>``."""
    spark = questions.sparkSession
    ckpt = checkpoint_dir or fresh_dir(spark, "answers-ckpt")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        answerer(batch).write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch={batch_id}"))

    w = questions.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q
