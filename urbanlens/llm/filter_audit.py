"""Interaction of quality filters, in every order at once, from truth-table survival words.

1. Each document's failing filters make a mask of five bits. Four follow from its text alone; the fifth, being a copy of
   a smaller id's text, comes from the least id of each text digest. Rows of equal digest, mask, part and labels are
   added up before that, so a text that a third of the table holds shuffles a few rows a task.
2. A mask becomes a word of 32 bits, one for each subset of the filters: set if the document survives that subset.
3. Words are added up position by position with carry-save adders: three words of one weight become one of that weight
   and one carry of twice the weight, until two at most are left at each weight. A word that stands for n documents enters
   at the weights of n's bits. The 32 sums of a task are the survivors of every subset, by part and label.
4. Whatever an order of filters keeps, removes, or leaves redundant is a difference of two subsets' survivors, so the
   orders are a projection of one row a part.

Results by case: a null text is empty and fails ``short`` alone (besides being a copy of smaller empty ones); a null
source is the part of the empty string; a row without an id is never a copy and makes none; rows that repeat an id and
its text aren't copies of each other, and each counts; a document that several label rows name has a label if one of them
says so; labels of unknown documents count nothing; a very long text is split a megabyte at a time; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters' letters; bit i of a mask or subset is the i-th.
LETTERS = "ABCDE"
SHORT, VARIED, CAPITALS, MARKS, COPY = (1 << i for i in range(5))
SUBSETS = 1 << len(LETTERS)
CUT = 1 << 20
_BLANK, _MARK = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[#$%&*|]")


def word_counts(raw: bytes, cut: int = CUT) -> tuple[int, int]:
    """Words and distinct words; about ``cut`` bytes are split at a time."""
    n, seen, at = 0, set(), 0
    while at < len(raw):
        end = _BLANK.search(raw, at + cut) if len(raw) - at > cut else None
        part = raw[at : end.start() if end else len(raw)].split()
        at = end.start() if end else len(raw)
        n += len(part)
        seen.update(part)
    return n, len(seen)


def text_mask(raw: bytes) -> int:
    """The failing filters that the text alone decides."""
    words, distinct = word_counts(raw)
    x = np.frombuffer(raw, np.uint8)
    chars, capitals = len(x) - int(((x & 0xC0) == 0x80).sum()), int(((x - np.uint8(65)) < 26).sum())
    return SHORT * (words < 200) | VARIED * (100 * distinct < 50 * words) | CAPITALS * (100 * capitals > 2 * chars) | MARKS * (_MARK.search(raw) is not None)


def survival_word(mask: int) -> int:
    """Bit S is set if a document that fails ``mask`` survives the subset S of filters."""
    return sum(1 << s for s in range(SUBSETS) if not s & mask)


def positional_popcounts(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each of the 32 bits how many of the documents have it set; words[i] stands for counts[i] documents."""
    out = np.zeros(SUBSETS, np.int64)
    carried, weight = np.empty(0, np.uint32), 0
    while len(carried) or (counts >> weight).any():
        at = np.concatenate([carried, words[(counts >> weight & 1).astype(bool)]])
        carries = []
        while len(at) > 2:
            third = len(at) // 3
            a, b, c, rest = at[:third], at[third : 2 * third], at[2 * third : 3 * third], at[3 * third :]
            half = a ^ b
            carries.append(a & b | half & c)
            at = np.concatenate([half ^ c, rest])
        out += ((at[:, None] >> np.arange(SUBSETS, dtype=np.uint32)) & 1).sum(axis=0, dtype=np.int64) << weight
        carried, weight = np.concatenate([np.empty(0, np.uint32), *carries]), weight + 1
    return out


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of each row, the mask without COPY."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, mask = [], []
            for x in batch.column("raw"):
                raw = x.as_py()
                digest.append(sha256(raw).digest())
                mask.append(text_mask(raw))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digest, pa.binary()), pa.array(mask, pa.int32())], names=["doc_id", "part", "digest", "mask"])

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), raw.alias("raw"))
    return rows.mapInArrow(measure, "doc_id long, part string, digest binary, mask int")


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, every, good, toxic): by part, for each subset of the filters, the surviving documents, and how many of
    those are labelled of good quality or toxic."""
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality"), said("toxic"))
    # the scan's own filter, so that texts are measured once
    found, nobody = masks(docs.filter("doc_id is not null")), masks(docs.filter("doc_id is null"))
    no = F.lit(False)
    named = found.join(marked, "doc_id", "left").withColumns({"quality": F.coalesce("quality", no), "toxic": F.coalesce("toxic", no)})
    alike = ["digest", "mask", "part", "quality", "toxic"]
    # repeated rows of a document add up first, so that a group knows how many rows its least id has
    by_doc = named.groupBy("doc_id", *alike).agg(F.count("*").alias("n"))
    by_text = by_doc.groupBy(*alike).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    least = F.min("first").over(Window.partitionBy("digest"))  # over a row for each part and label that holds the text
    own = F.when(F.col("first") == least, F.col("n_first")).otherwise(F.lit(0))
    split = by_text.withColumn("own", own).select("part", "quality", "toxic", F.explode(F.array(F.struct("mask", F.col("own").alias("n")), F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), (F.col("n") - F.col("own")).alias("n")))).alias("x"))
    nameless = nobody.groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", no.alias("quality"), no.alias("toxic"), "mask", "n")
    counted = split.select("part", "quality", "toxic", "x.mask", "x.n").filter("n > 0").unionByName(nameless)
    words = np.array([survival_word(m) for m in range(SUBSETS)], np.uint32)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = defaultdict(list)
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "quality", "toxic")), strict=True)):
                groups[key].append(i)
            mask, n = (np.asarray(batch.column(c)) for c in ("mask", "n"))
            sums = [positional_popcounts(words[mask[rows]], n[rows]) for rows in groups.values()]
            keys = list(zip(*groups, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.bool_()), pa.array(keys[2], pa.bool_()), pa.array([s.tolist() for s in sums], pa.list_(pa.int64()))], names=["part", "quality", "toxic", "sums"])

    partial = counted.mapInArrow(add_up, "part string, quality boolean, toxic boolean, sums array<long>")
    at = lambda s: F.get("sums", F.lit(s))
    kinds = {"every": lambda s: at(s), "good": lambda s: F.when(F.col("quality"), at(s)).otherwise(0), "bad": lambda s: F.when(F.col("toxic"), at(s)).otherwise(0)}
    summed = partial.groupBy("part").agg(*[F.sum(value(s)).alias(f"{kind}{s}") for kind, value in kinds.items() for s in range(SUBSETS)])
    return summed.select("part", *[F.array(*[F.col(f"{kind}{s}") for s in range(SUBSETS)]).alias("toxic" if kind == "bad" else kind) for kind in kinds])


def _steps() -> Column:
    """All orders' steps as literals: the order, the step, the filter's bit and the subset applied before it."""
    rows = []
    for order in permutations(LETTERS):
        before = 0
        for i, letter in enumerate(order):
            bit = 1 << LETTERS.index(letter)
            rows.append(f"struct('{''.join(order)}' AS filter_order, {i + 1} AS step, {LETTERS.index(letter)} AS filter, {before} AS before, {before | bit} AS after)")
            before |= bit
    return F.expr(f"array({', '.join(rows)})")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part,
    order of the filters and step of ``docs`` (doc_id, text, source) and ``labels`` (doc_id, quality, toxic)."""
    n, full = len(LETTERS), SUBSETS - 1
    at = lambda kind, s: F.get(F.col(kind), s if isinstance(s, Column) else F.lit(s))

    def shapley(bit: int) -> Column:
        terms = []
        for s in range(SUBSETS):
            if not s & bit:
                orders = factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())
                terms.append((at("every", s) - at("every", s | bit)) * F.lit(orders).cast("long"))
        return sum(terms[1:], terms[0])

    bits = [1 << i for i in range(n)]
    parts = survivors(docs, labels).select(
        "*",
        F.array(*[at("every", 0) - at("every", b) for b in bits]).alias("fails"),
        F.array(*[at("every", full ^ b) - at("every", full) for b in bits]).alias("only"),
        F.array(*[shapley(b) for b in bits]).alias("all_orders"),
    )
    rows = parts.select("*", F.explode(_steps()).alias("s")).select("*", "s.*")
    lost = lambda kind: at(kind, F.col("before")) - at(kind, F.col("after"))
    of = lambda c: F.get(F.col(c), F.col("filter"))
    return rows.select("part", "filter_order", "step", at("every", F.col("after")).alias("kept"), lost("every").alias("removed"), (of("fails") - lost("every")).alias("redundant"), of("only").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), of("all_orders").alias("shapley"))
