"""Token ids of whole texts as binary files in ascending doc_id order, and back.

Format: a folder of three Parquet tables, written by Spark and so readable wherever Spark's storage is.

* ``blocks``: about ``BLOCK_BYTES`` of documents a row: part, block, before (ids of the part's blocks before it), first_doc, last_doc, dict_hash, id_bytes (2 or
  4), doc_ids, lengths (ids of each document, end id included), offsets (of each document's frame in the payload, and
  the payload's end), payload. A frame is one document's little-endian ids, compressed alone by zstandard with the
  shared dictionary, so a short document is read by unpacking its own frame.
* ``dictionary``: the dictionary and its SHA-256; readers refuse blocks of another hash.
* ``starts``: by part, the ids of all parts before it.

Tasks encode and compress where the rows are; only the compressed frames are dealt out by doc_id ranges (from
approximate quantiles of the ids) and sorted there. The dictionary is trained on about ``SAMPLE_DOCS`` documents of the
smallest id hashes, each encoded whole where it is and giving ``SAMPLE_IDS`` ids at most from a place that its hash
chooses: a bound on what shapes compression, the same in every run, never on what is written.

Results by case: a null or empty text is the end id alone; null ids come first, repeated ids follow one another and
each row keeps its own ids; a table too small to train on gets an empty dictionary; an empty table gives empty files
and no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanlens.llm.common import about, row_slices, shuffle_partitions
from urbanlens.llm.pieces import coder, load_tokenizer, pieces, segments

BLOCK_BYTES, SLICE_BYTES = 1 << 20, 1 << 20
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_IDS, LEVEL = 1 << 16, 1000, 4096, 1
_BLOCKS = "part int, block int, before long, first_doc long, last_doc long, dict_hash string, id_bytes int, doc_ids array<long>, lengths array<int>, offsets array<int>, payload binary"


def _ids(texts: list[str | None], known, end_id: int) -> Iterator[bytes]:
    """Of each text the ids and the end id, as little-endian 32-bit integers."""
    split = [[p for part in segments(t) for p in pieces(part)] if t else [] for t in texts]
    end = end_id.to_bytes(4, "little")
    for found in known.of_groups(split):
        found.append(end)
        yield b"".join(found)


def _coder(path: str):
    return coder(path, "ids", lambda ids: array("I", ids).tobytes())


def train_dictionary(docs: DataFrame, tokenizer_path: str, id_bytes: int) -> bytes:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "text", SLICE_BYTES):
                out = []
                for ids, h in zip(_ids(rows.column("text").to_pylist(), _coder(tokenizer_path), 0), rows.column("h").to_pylist(), strict=True):
                    n = len(ids) // 4
                    at = h % max(1, n - SAMPLE_IDS + 1)
                    out.append(np.frombuffer(ids, "<u4")[at : at + SAMPLE_IDS].astype(f"<u{id_bytes}").tobytes())
                yield pa.RecordBatch.from_arrays([rows.column("h"), pa.array(out, pa.binary())], names=["h", "ids"])

    # rows of one id, or of none, have one hash: their texts' hashes tell them apart
    hashed = docs.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("h"))
    chosen = about(hashed, "h", SAMPLE_DOCS, docs.count()).select("h", "text").dropDuplicates(["h"])
    arrays = [bytes(r.ids) for r in chosen.mapInArrow(part, "h long, ids binary").orderBy("h").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too uniform samples
        return b""


def _dictionary(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Write the files of ``docs`` (doc_id long, text) to the new folder ``path``."""
    spark = docs.sparkSession
    id_bytes = 2 if load_tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer_path, id_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    n = shuffle_partitions(spark)
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("b")).first().b if n > 1 else None
    bounds = np.array(bounds or [], "i8")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer = _coder(tokenizer_path), zstandard.ZstdCompressor(LEVEL, dict_data=_dictionary(dictionary))
        for batch in batches:
            for rows in row_slices(batch, "text", SLICE_BYTES):
                lengths, frames = [], []
                for raw in _ids(rows.column("text").to_pylist(), known, end_id):
                    ids = np.frombuffer(raw, "<u4")
                    lengths.append(len(ids))
                    frames.append(packer.compress(ids.astype(f"<u{id_bytes}").tobytes()))
                doc = rows.column("doc_id")
                part = np.where(np.asarray(doc.is_null()), 0, np.searchsorted(bounds, np.asarray(doc.fill_null(0))))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc, pa.array(lengths, pa.int32()), pa.array(frames, pa.binary())], names=["part", "doc_id", "n", "frame"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted frames of one part into blocks."""
        docs_, lengths, offsets, frames, part, number, before = [], [], [0], [], None, 0, 0

        def row():
            known = [d for d in docs_ if d is not None]
            values = [part, number, before, min(known, default=None), max(known, default=None), digest, id_bytes, docs_, lengths, offsets, b"".join(frames)]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, values, strict=True))], schema=schema)

        for batch in batches:
            for p, d, n_, frame in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if frames and (p != part or offsets[-1] >= BLOCK_BYTES):
                    yield row()
                    number, before = (number + 1, before + sum(lengths)) if p == part else (0, 0)
                    docs_, lengths, offsets, frames = [], [], [0], []
                part = p
                docs_.append(d)
                lengths.append(n_)
                frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
        if frames:
            yield row()

    ints = pa.int32()
    schema = pa.schema([("part", ints), ("block", ints), ("before", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("dict_hash", pa.string()), ("id_bytes", ints), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(ints)), ("offsets", pa.list_(ints)), ("payload", pa.binary())])
    frames = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "part int, doc_id long, n int, frame binary")
    dealt = frames.repartitionById(n, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "frame")
    dealt.mapInArrow(block, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    sizes = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in sizes:  # one row a part
        starts.append((r.part, total))
        total += r.n
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(f"{path}/starts")


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, str, dict[int, int]]:
    d = spark.read.parquet(f"{path}/dictionary").first()
    starts = {r.part: r.start for r in spark.read.parquet(f"{path}/starts").collect()}
    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks"), bytes(d.dictionary), d.dict_hash, starts


def _unpack(blocks: DataFrame, dictionary: bytes, digest: str, starts: dict[int, int], schema: str, wanted: int | None, result) -> DataFrame:
    """One row of each document of the blocks (or of one document): ``result(start, ids)`` after its id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if hashlib.sha256(dictionary).hexdigest() != digest:
            raise ValueError("the dictionary isn't the one that its hash names")
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            part, before, hashes, widths, docs, lengths, offsets, payload = (batch.column(batch.schema.get_field_index(k)) for k in ("part", "before", "dict_hash", "id_bytes", "doc_ids", "lengths", "offsets", "payload"))
            for i in range(batch.num_rows):
                if hashes[i].as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                start, at, data = starts[part[i].as_py()] + before[i].as_py(), offsets[i].as_py(), memoryview(payload[i].as_buffer())
                rows = []
                for k, (doc, n) in enumerate(zip(docs[i].as_py(), lengths[i].as_py(), strict=True)):
                    if wanted is None or doc == wanted:
                        raw = unpacker.decompress(data[at[k] : at[k + 1]], max_output_size=n * widths[i].as_py())
                        rows.append((doc, *result(start, np.frombuffer(raw, f"<u{widths[i].as_py()}").astype("<u4"))))
                    start += n
                columns = list(zip(*rows, strict=True)) or [[]] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    arrow = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    out = pa.schema([(name, arrow[kind]) for name, kind in (f.split() for f in schema.split(", "))])
    return blocks.mapInArrow(read, schema)


def read_token_files(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """(doc_id, start, ids) of every document of the files; with ``digests`` (doc_id, start, n_tokens, ids_crc32)."""
    blocks, *files = _opened(spark, path)
    if digests:
        return _unpack(blocks, *files, "doc_id long, start long, n_tokens long, ids_crc32 long", None, lambda s, ids: (s, len(ids), zlib.crc32(ids.tobytes())))
    return _unpack(blocks, *files, "doc_id long, start long, ids array<long>", None, lambda s, ids: (s, ids.tolist()))


def read_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """(doc_id, start, ids) of one document: only blocks whose range holds the id are read, and only its frame is unpacked."""
    blocks, *files = _opened(spark, path)
    here = (F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)
    return _unpack(blocks.filter(here), *files, "doc_id long, start long, ids array<long>", doc_id, lambda s, ids: (s, ids.tolist()))
