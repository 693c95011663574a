"""Similarity join of documents as sets of word shingles, by set-relation skipping.

1. A class of equal sets that has a link shares with other texts at least ceil(t n) of its n shingles. Shingle hashes, cut
   to a few bits more than the corpus needs to tell them apart, are sorted in slices and counted by ranges, packed; each
   document learns how many of its shingles nobody else has, and leaves if those are too many. (Cut hashes that meet by
   chance keep a document; they never lose one.)
2. The classes left are indexed. Shingles have one global order, rarest first by exact counts over those classes. A class
   posts the first n - ceil(t n) + 1 of its shingles, with their positions, and ``n // EXTRA`` more; those that no other
   class has needn't be written. Linked classes share at least 1 + min(extras) postings, so texts that merely share a
   phrase never meet.
3. Each class is held against the hub of its largest list (the list's smallest document) on full sets: one pair a class.
   A class near its hub is described by what it lacks of the hub's set and what it has besides.
4. Index-level skipping: list entries lie in blocks of at most ``CHUNK`` classes, of one hub or else of one largest list.
   Within a list, blocks meet as wholes; a pair of blocks is skipped if the ranges of sizes and positions rule links out,
   or if a hub joins both already. Block pairs left with as many lists in common as links need are compared.
5. Answer-level skipping: of a block described by a hub the overlaps of the hub's set with the other block are counted
   first. They bound each member's from both sides by the size of its differences; where the bounds don't decide, the
   member's overlap follows from the hub's by counting its differences alone.
6. Connected components of the links. A block pair hands on links that join something, fewer than its classes.

Every pair of classes either is joined through verified links, or was compared or ruled out by a bound: no link between
components is lost. A group of near copies costs one comparison a member, and blocks of those members that the hub isn't
similar enough to are spread over tasks.

Results by case: a text without words (null, empty, white space) has no shingles, is linked with nothing and is its own
component; fewer words than a shingle has make one shingle; rows of one id are judged each by its own text, and share
the id in components; a row without an id is linked with nothing and has no component; equal sets are one component
whatever the texts' order of words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanlens.llm.blocks import CHUNK, homes, hub_links, links_apart, members, whole_sets
from urbanlens.llm.common import row_slices, shuffle_partitions, small_batches, written
from urbanlens.llm.components import components
from urbanlens.llm.near_dedup import shingles

#: Shingles that are sorted at once, shingles of a range (a bound on its task's memory), and spare bits of cut hashes.
SLICE, RANGE, SPARE = 1 << 21, 1 << 21, 5
EXTRA, SLICE_BYTES = 20, 1 << 20
_U = np.uint64


def needed(n: Column | int, percent: int) -> Column:
    """Shingles that a set of n shares with any linked set, at least."""
    return F.ceil(n * F.lit(percent) / 100)


def key_of(shingle_set: np.ndarray) -> np.ndarray:
    """128 bits that name a set, as two numbers."""
    return np.frombuffer(xxhash.xxh3_128_digest(shingle_set.tobytes()), "<i8")


def _small(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, and in front how many that are."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _large(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


_SKETCH = "doc_id long, n_shingles long, k1 long, k2 long, slice long, idx long"


def _sliced(docs: DataFrame, words: int, bits: int, ranges: int) -> DataFrame:
    """Each row's sketch; and of slices of documents the sorted cut hashes, each with its one holder (or the number of
    documents: several), by ranges."""
    names = ["doc_id", "n_shingles", "k1", "k2", "slice", "idx", "range", "cut", "holders"]

    def cut_up(sets: list[np.ndarray], name: int) -> pa.RecordBatch:
        values = (np.concatenate(sets) if sets else np.empty(0, _U)) >> _U(64 - bits)
        holders = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        values, holders = values[order], holders[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, int)
        holders = np.where(np.diff(np.append(first, len(values))) == 1, holders[first], len(sets))
        values = values[first]
        of = (((values << _U(64 - bits)) >> _U(40)) * _U(ranges)) >> _U(24)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, int)
        rows = list(zip(starts, [*starts[1:], len(of)], strict=False))
        gaps = [_small(np.diff(values[x:y])) for x, y in rows]
        none = pa.nulls(len(rows), pa.int64())
        heads = values[starts].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [none, pa.array([len(sets)] * len(rows), pa.int64()), pa.array(heads), none, pa.array([name] * len(rows), pa.int64()), none, pa.array(of[starts].astype(np.int64)), pa.array(gaps, pa.binary()), pa.array([_small(holders[x:y]) for x, y in rows], pa.binary())], names=names)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, name = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in row_slices(batch, "text", SLICE_BYTES):
                sets = [shingles(t, words) for t in rows.column("text").to_pylist()]
                keys = np.array([key_of(s) for s in sets]).reshape(-1, 2)
                at = np.arange(len(held), len(held) + len(sets))
                # sketches pass through the ranges' tasks too, evenly
                none = pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([name] * len(sets), pa.int64()), pa.array(at), pa.array((keys[:, 0] & 0xFFFFFF) * ranges >> 24), none, none], names=names)
                held += sets
                size += sum(map(len, sets))
                if size >= SLICE:
                    yield cut_up(held, name)
                    held, size, name = [], 0, name + 1
        if held:
            yield cut_up(held, name)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, f"{_SKETCH}, range long, cut binary, holders binary")


def sketches(docs: DataFrame, words: int, bits: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, k1, k2, slice, idx) of each row; and (slice, idx, alone): by document the shingles whose cut
    hash no other document has."""

    columns = ["doc_id", "n_shingles", "k1", "k2", "slice", "idx"]

    def counted(group: list[dict]) -> pa.RecordBatch:
        values = np.concatenate([np.cumsum(np.concatenate([[r["k1"]], _large(r["cut"])])) for r in group])
        holders = [_large(r["holders"]) for r in group]
        own = np.concatenate([np.where(h < r["n_shingles"], h, -1).astype(np.int32) for h, r in zip(holders, group, strict=True)])
        of = np.repeat(np.arange(len(group), dtype=np.int32), [len(h) for h in holders])
        order = np.argsort(values, kind="stable")
        values = values[order]
        same = np.append(values[1:] == values[:-1], False)
        alone = order[~(same | np.append(False, same[:-1]))]
        alone = alone[own[alone] >= 0]
        own, of = own[alone], of[alone]
        by = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[by], np.arange(len(group) + 1))
        names = [r["slice"] for r in group]
        found = [_small(np.bincount(own[by[ends[i] : ends[i + 1]]], minlength=r["n_shingles"])) for i, r in enumerate(group)]
        none = pa.nulls(len(names), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(names, pa.int64()), none, pa.array(found, pa.binary())], names=[*columns, "alone"])

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None
        for batch in batches:
            packed = pc.is_valid(batch.column("cut"))
            plain = batch.filter(pc.invert(packed)).select(columns)
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([*plain.columns, pa.nulls(plain.num_rows, pa.binary())], names=[*columns, "alone"])
            for r in batch.filter(packed).to_pylist():
                if r["range"] != at and group:
                    yield counted(group)
                    group = []
                at = r["range"]
                group.append(r)
        if group:
            yield counted(group)

    dealt = _sliced(docs, words, bits, ranges).repartition("range").sortWithinPartitions("range")
    both = written(dealt.mapInArrow(by_range, f"{_SKETCH}, alone binary"), "join-sketches")

    def sums(key: tuple, group: pa.Table) -> pa.Table:
        # a slice has as many counts a range as documents
        total = sum(_large(x.as_py()) for x in group["alone"])
        at = np.flatnonzero(total)
        return pa.table([pa.array([key[0].as_py()] * len(at), pa.int64()), pa.array(at), pa.array(total[at])], names=["slice", "idx", "alone"])

    alone = both.filter("alone is not null").select("slice", "alone").groupBy("slice").applyInArrow(sums, "slice long, idx long, alone long")
    return both.filter("alone is null").drop("alone"), alone


def index(sets: DataFrame, percent: int) -> DataFrame:
    """(token, k, rep, n, pos, rest): the postings of each class that another class shares, of classes (k, rep, n, shingles)
    that share as many as a link needs."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "shingles", SLICE_BYTES):  # a few rows at a time become very many
                found = [np.frombuffer(x.as_py(), np.int64) for x in part.column("shingles")]
                many = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *(part.column(c).take(many) for c in ("k", "rep", "n"))], names=["token", "k", "rep", "n"])

    rows = sets.select("k", "rep", "n", "shingles").mapInArrow(tokens, "token long, k long, rep long, n long")
    counts = rows.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
    shared = rows.join(counts, "token").groupBy("k", "rep", "n").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("found"))
    # what nobody shares comes first in the order and takes places
    places = F.size("found") - needed(F.col("n"), percent) + 1 + F.floor(F.col("n") / EXTRA)
    shared = shared.filter(F.size("found") >= needed(F.col("n"), percent))
    posted = shared.select("k", "rep", "n", F.size("found").alias("s"), F.posexplode(F.slice("found", F.lit(1), places.cast("int"))).alias("i", "t"))
    posted = written(posted.select("t.token", "k", "rep", "n", (F.col("n") - F.col("s") + F.col("i")).alias("pos")), "join-postings")
    lists = posted.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
    posted = posted.join(lists, "token")
    least = 1 + F.floor(needed(F.col("n"), percent) / EXTRA)  # with the smallest set that may be linked
    enough = posted.groupBy("k", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("k")
    return posted.join(enough, "k").withColumn("rest", F.col("n") - F.col("pos") - 1)


def joined_documents(docs: DataFrame, words: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text): documents whose sets of ``words``-word
    shingles share at least ``percent`` of their union are linked."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shingle_bound = max(1, size // 4)  # about as many shingles, or fewer
    ranges = min(1 << 23, max(shuffle_partitions(docs.sparkSession), -(-shingle_bound // RANGE)))
    sketched, alone = sketches(docs, words, min(64, max(24, shingle_bound.bit_length() + SPARE)), ranges)
    taking_part = sketched.filter("n_shingles > 0 and doc_id is not null")
    classes = written(taking_part.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.min_by("slice", "doc_id").alias("slice"), F.min_by("idx", "doc_id").alias("idx")), "join-classes")
    spare = F.col("n") - needed(F.col("n"), percent)
    likely = classes.join(alone, ["slice", "idx"], "left").filter(F.coalesce("alone", F.lit(0)) <= spare)

    def made(texts: list[str | None]) -> list[tuple]:
        return [(int(key_of(s)[0]), s.tobytes()) for s in (shingles(t, words) for t in texts)]

    whole = whole_sets(docs, likely.select(F.col("k1").alias("k"), "rep", "n"), made, {"k": "long", "shingles": "binary"}, "join-sets")
    rows = written(index(whole, percent), "join-index")
    placed = written(homes(rows), "join-homes")
    met_sets = whole.join(placed.select("k", "home", "hub", "hub_n"), "k")
    found = written(members(met_sets, percent), "join-members")
    # tokens at these places leave room for as many in common as the smallest sets here need
    room = lambda x, y: (100 + percent) * (F.least(x["pos1"], y["pos1"]) + 1 + F.least(x["rest1"], y["rest1"])) >= percent * (x["n0"] + y["n0"])
    least = lambda x, y: 1 + F.floor(F.least(x, y) / EXTRA)
    links = hub_links(found, placed).unionByName(links_apart(found, rows, whole, percent, chunk, room, least))
    joined = components(links)
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    linked = taking_part.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    others = sketched.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(others)
