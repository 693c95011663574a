"""Token counts of whole texts by a public byte-level BPE tokenizer.

Arrow functions return lengths only. A task takes its rows in slices of about equal bytes, cuts every text at
safe boundaries (see :mod:`urbanlens.llm.pieces`), encodes the pieces that it hasn't met yet (plain words singly
by the model, others in batches of about equal bytes), and sums the lengths. No shuffle: a row's count needs no other row.

Results by case: a null or empty text has 0 bytes and 0 tokens; very long texts are cut into segments, so memory
doesn't grow with them, unless they hold no white space at all; repeated rows and null ids each give a row of their
own; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanlens.llm.common import row_slices
from urbanlens.llm.pieces import coder, pieces, segments

#: Bytes of text that a task cuts and counts at a time.
SLICE_BYTES = 1 << 20


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs`` (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = coder(tokenizer_path, "lengths", len)
        for batch in batches:
            for rows in row_slices(batch, "text", slice_bytes):
                split = [[p for part in segments(t) for p in pieces(part)] if t else [] for t in rows.column("text").to_pylist()]
                n = [*map(sum, lengths.of_groups(split))]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
