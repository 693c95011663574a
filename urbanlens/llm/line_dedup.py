"""Lines that many documents repeat, by sorted streams of line hashes.

1. Tasks split texts at line feeds and hash each line's key (stripped of ASCII white space, A-Z lower-cased; 128
   bits). The hashes, with document and position, are a table in the shared folder; texts stay where they are.
2. The table is range-partitioned by hash and document and sorted by hash, document and position, so the rows of a
   common line lie in several partitions. Each partition is streamed: a line's rows are held only until its documents
   are enough, then handed on one by one. Of a partition's first and last line, which neighbours may share, the
   partial counts are handed on as well (two rows a partition) and added up. So are those of a line whose rows are more
   than ``HELD`` before its documents are enough (one document may repeat it without end), so a task holds no more.
3. What repeats comes back as positions, packed into one compressed keep bitmap a document, and only the bitmaps are
   joined with the texts.

Results by case: a null or empty text is one empty line; lines with an empty key are always kept; a line that one
document repeats counts once for it; rows of one id count as one document, and each row keeps its own bitmap, by id and
hash of the text; rows without an id are one document; an empty table gives no rows; extra columns stay as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanlens.llm.common import row_slices, shuffle_partitions, small_batches, unused, written

SLICE_BYTES, HELD, BLANK = 1 << 20, 10_000, b" \t\n\x0b\x0c\r"


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_hashes(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, text_hash, position) of every line with a key."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "text", SLICE_BYTES):
                keys, row, position = [], [], []
                for i, text in enumerate(rows.column("text").to_pylist()):
                    for p, line in enumerate(text.encode().split(b"\n") if text else ()):
                        if key := line.strip(BLANK).lower():
                            keys.append(xxhash.xxh3_128_digest(key))
                            row.append(i)
                            position.append(p)
                h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                row = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), rows.column("doc_id").take(row), rows.column("text_hash").take(row), pa.array(position, pa.int32())], names=["h1", "h2", "doc_id", "text_hash", "position"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), "text")
    return rows.mapInArrow(lines, "h1 long, h2 long, doc_id long, text_hash long, position int")


#: kind 0: a row of a line that enough documents hold; 1: a row whose line had too few documents so far, and a neighbouring
#: partition may hold it too, or more rows came before than a task holds; 2: a partition's count of such a line. ``lead`` marks the line's first row in the partition.
_MARKS = "kind int, h1 long, h2 long, doc_id long, text_hash long, position int, lead boolean, documents long"


def _stream(least: int):
    names = [f.split(" ")[0] for f in _MARKS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, first_line, held, documents, last_doc, head, over = None, True, [], 0, (), None, False
        out: list[tuple] = []

        def end(at_edge: bool) -> None:
            """The line's rows are over."""
            if line is not None and (at_edge or first_line or over):
                out.extend((1, *line, *r, None) for r in held)
                out.append((2, *line, *head, True, documents))

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2 = (np.asarray(batch.column(k)) for k in (0, 1))
            new = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            size = np.diff(np.r_[new, n])
            # inside the batch, lines of fewer rows than documents are asked for are over at once
            small = size < least
            small[0] = small[-1] = False
            for s, e in zip(new[~small], (new + size)[~small], strict=True):
                key = (int(h1[s]), int(h2[s]))
                if key != line:
                    end(False)
                    first_line = line is None
                    line, held, documents, last_doc, head, over = key, [], 0, (), None, False
                part = batch.slice(s, e - s)
                for doc, text, position in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                    lead = head is None
                    head = head or (doc, text, position)
                    if (doc,) != last_doc:
                        documents, last_doc = documents + 1, (doc,)
                    if documents < least:
                        held.append((doc, text, position, lead))
                        if len(held) > HELD:
                            over = True
                            out.extend((1, *line, *r, None) for r in held)
                            held = []
                            if len(out) >= 50_000:
                                yield made()
                    else:
                        out.extend((0, *line, *r, None) for r in held)
                        held = []
                        out.append((0, *line, doc, text, position, lead, None))
                if len(out) >= 50_000:
                    yield made()
        end(True)
        yield made()

    return stream


def repeated_lines(docs: DataFrame, least: int = 10, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, position) of the lines whose keys at least ``least`` documents hold; with ``keep_first``
    without each key's first occurrence by document and position."""
    spark = docs.sparkSession
    small_batches(spark)
    hashed = written(line_hashes(docs), "line-hashes")
    dealt = hashed.repartitionByRange(shuffle_partitions(spark), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "text_hash", "position")
    marks = written(dealt.mapInArrow(_stream(least), _MARKS), "line-marks")
    # two rows a partition, and one for each line that a task couldn't hold; Spark broadcasts the sums if they are small
    place = F.struct("doc_id", "text_hash", "position")
    shared = marks.filter("kind = 2").groupBy("h1", "h2").agg(F.sum("documents").alias("documents"), F.min(place).alias("head"))
    rows = marks.filter("kind < 2").drop("documents").join(shared, ["h1", "h2"], "left").filter((F.col("kind") == 0) | (F.col("documents") >= least))
    if keep_first:
        rows = rows.filter(~F.when(F.col("head").isNull(), F.col("lead")).otherwise(place.eqNullSafe(F.col("head"))))
    return rows.select("doc_id", "text_hash", "position")


def keep_bitmaps(docs: DataFrame, least: int = 10, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, keep_bitmap) of each text that loses a line: bit p (lowest first) is set if line p stays, lines
    beyond the bitmap stay; compressed by zlib."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for positions in batch.column("positions"):
                p = np.asarray(positions.values)
                bits = np.ones((int(p.max()) // 8 + 1) * 8, bool)
                bits[p] = False
                packed.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(packed, pa.binary())], names=["doc_id", "text_hash", "keep_bitmap"])

    found = repeated_lines(docs, least, keep_first).groupBy("doc_id", "text_hash").agg(F.collect_list("position").alias("positions"))
    return found.mapInArrow(pack, "doc_id long, text_hash long, keep_bitmap binary")


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    """Lines, lines dropped, and the text that stays."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), 0, text or ""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[: len(lines)]
    drop = set(np.flatnonzero(bits == 0).tolist())
    return len(lines), len(drop), "\n".join(x for i, x in enumerate(lines) if i not in drop)


def with_bitmaps(docs: DataFrame, least: int = 10, keep_first: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, with their bitmap in one more column, the last (null: every line stays)."""
    doc, text, bitmap = unused(docs.columns, "_keep_doc", "_keep_text", "_keep_bitmap")
    found = keep_bitmaps(docs, least, keep_first).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text), F.col("keep_bitmap").alias(bitmap))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (_text_hash() == F.col(text))
    return docs.join(found, match, "left").drop(doc, text)


def line_digests(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [kept_lines(t, b) for t, b in zip(batch.column("text").to_pylist(), batch.column(2).to_pylist(), strict=True)]
            n, dropped = (pa.array([m[k] for m in made], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, dropped, pa.array([sha256(m[2].encode()).hexdigest() for m in made], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_bitmaps(docs.select("doc_id", "text"), least).mapInArrow(digest, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def drop_repeated_lines(docs: DataFrame, least: int = 10, keep_first: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, their texts without repeated lines (a null text stays null)."""
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if b is None else kept_lines(t, b)[2] for t, b in zip(batch.column("text").to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(names)], names=names)

    return with_bitmaps(docs, least, keep_first).mapInArrow(cut, docs.schema)
