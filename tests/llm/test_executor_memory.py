"""What Arrow functions hold at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from urbanlens.llm import blocks, common
from urbanlens.llm.line_dedup import drop_repeated_lines
from urbanlens.llm.near_dedup import near_duplicates
from urbanlens.llm.set_join import joined_documents
from urbanlens.llm.toxicity import without_toxic

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def most_rows(spark):
    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return spark.range(5000, numPartitions=1).mapInArrow(count, "n long").agg({"n": "max"}).first()[0]


@pytest.mark.parametrize("made", [
    lambda spark, docs: near_duplicates(docs),
    lambda spark, docs: joined_documents(docs),
    lambda spark, docs: drop_repeated_lines(docs),
    lambda spark, docs: without_toxic(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")),
], ids=["near_dedup", "set_join", "line_dedup", "toxicity"])
def test_small_batches(spark, made):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g")], "doc_id long, text string")
    before = spark.conf.get(ROWS)
    try:
        spark.conf.set(ROWS, "10000")
        result = made(spark, docs)
        assert most_rows(spark) == common.BATCH_ROWS  # also when the result is read
        assert {r.doc_id for r in result.collect()} <= {1, 2, 3}
        spark.conf.set(ROWS, "100")
        common.small_batches(spark)
        assert spark.conf.get(ROWS) == "100"  # never raised
    finally:
        spark.conf.set(ROWS, before)


def test_overlaps_of_like_sets_in_little_memory():
    rng = np.random.default_rng(1)
    base = np.arange(400)
    a = [np.sort(rng.choice(base, 380, replace=False)) for _ in range(128)]
    tracemalloc.start()
    try:
        found = blocks.overlaps(a, a)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    held = np.zeros((128, 400), np.int64)
    for i, s in enumerate(a):
        held[i, s] = 1
    assert (found == held @ held.T).all()
    assert peak < 60_000_000  # six million matching pairs
