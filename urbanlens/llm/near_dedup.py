"""Near-duplicate documents by MinHash signatures and an inverted join of their coordinates.

1. Each text's set of word shingles gets a signature of ``COORDINATES`` minima. Texts of equal sets become one class.
2. Classes are posted under each coordinate-value pair (a token). A pair of classes is a candidate if at least
   ``least_matches`` tokens agree, a bound over four standard deviations below what similar texts expect. Prefix
   rule: under one global order of tokens, rarest first, candidates share 1 + ``EXTRA`` of the first ``COORDINATES`` -
   ``least_matches`` + 1 + ``EXTRA`` of each. Tokens of one class only come first and match nothing, so classes with too
   few shared tokens are skipped, and common tokens (of passages that many documents share) are posted only by
   classes that hold hardly any others.
3. Collisions in the posted lists are counted by pairs of blocks of classes, so a list of many classes is neither one
   task's work nor expanded into pairs. Before that each class is held against the smallest document of its largest
   list; those of one such hub lie in blocks of their own, and blocks that the hub joins don't meet.
4. Of two blocks with enough lists in common the remaining coordinates are merged in parts, skipping classes that can't
   reach the threshold any more. Pairs at or above it are confirmed on the full sets. Only links that join something
   leave a task, fewer than the classes it holds.
5. Connected components of the links, over classes; documents take their class's.

A true pair is missed only if its signatures agree in fewer places than the bound: at a similarity right on the
threshold 3.0 times in 10^5 at 85 percent and 1.4 times at 80, less above it.

Results by case: a text without words (null, empty, white space) has no shingles and is linked with nothing, its own
component; fewer words than a shingle has make one shingle; rows of one id are judged each by its own text, and share
the id in components; a row without an id is linked with nothing, has no component and is kept; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanlens.llm.blocks import CHUNK, homes, hub_links, links_apart, members, whole_sets
from urbanlens.llm.common import row_slices, small_batches, written
from urbanlens.llm.components import components

#: Signature length, postings beyond the prefix rule, and bytes of texts that a task shingles at once.
COORDINATES, EXTRA, SLICE_BYTES = 64, 4, 1 << 20
_U = np.uint64
_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=_U) * _U(2) + _U(1)
_TERMS = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=_U)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted. Words end at ASCII white space; A-Z are lower-cased."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, _U)
    h = np.array([*map(xxhash.xxh3_64_intdigest, found)], _U)
    n = max(len(h) - words + 1, 1)
    width = min(words, len(h))
    made = _mixed(h[:n] + _U(width))
    for j in range(1, width):
        made = _mixed(made * _U(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(made)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of each coordinate's hash over the set (not empty)."""
    least = np.full(COORDINATES, np.iinfo(_U).max, _U)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[None, at : at + 2048] * _FACTORS[:, None] + _TERMS[:, None]).min(axis=1))
    return least


def tokens(least: np.ndarray) -> np.ndarray:
    """Coordinate-value pairs as numbers: the coordinate in the lowest bits."""
    return (least >> _U(6) << _U(6) | np.arange(COORDINATES, dtype=_U)).view(np.int64)


def least_matches(percent: int) -> int:
    """Matching coordinates that a pair of similarity ``percent`` has but for 1 to 3 times in 10^5 (at 80 and 85)."""
    p = percent / 100
    return max(1, int(COORDINATES * p - 4.3 * (COORDINATES * p * (1 - p)) ** 0.5))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2: hash of the whole set, tokens) of each row; no tokens without shingles."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "text", SLICE_BYTES):
                n, k1, k2, t = [], [], [], []
                for text in rows.column("text").to_pylist():
                    s = shingles(text, words)
                    key = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                    n.append(len(s))
                    k1.append(key[0])
                    k2.append(key[1])
                    t.append(tokens(signature(s)) if len(s) else None)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(t, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "k1", "k2", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, "doc_id long, n_shingles long, k1 long, k2 long, tokens array<long>")


def index(classes: DataFrame, matches: int) -> DataFrame:
    """(token, k, rep, n, pos, rest): the posted tokens of each class (k, rep, n, tokens) that another class shares, of
    classes that share as many as candidates do."""
    posted = classes.select("k", "rep", "n", F.explode("tokens").alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
    ranked = posted.join(shared, "token").groupBy("k", "rep", "n").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("found")).filter(F.size("found") >= matches)
    # what nobody shares comes first in the order and takes places
    first = F.slice("found", F.lit(1), F.size("found") - (matches - 1) + EXTRA)
    rows = written(ranked.select("k", "rep", "n", F.size("found").alias("s"), F.posexplode(first).alias("i", "t")).select("t.token", "k", "rep", "n", (COORDINATES - F.col("s") + F.col("i")).alias("pos")), "near-postings")
    rows = rows.join(rows.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token"), "token")
    enough = rows.groupBy("k").agg(F.count("*").alias("c")).filter(F.col("c") > EXTRA).select("k")
    return rows.join(enough, "k").withColumn("rest", COORDINATES - 1 - F.col("pos"))


def collide(a: np.ndarray, b: np.ndarray, matches: int, part: int = 16) -> np.ndarray:
    """Whether signatures (rows) of ``a`` and ``b`` agree in ``matches`` coordinates. Coordinates are merged ``part`` at a
    time; rows that can't get there with anyone are skipped from then on."""
    out = np.zeros((len(a), len(b)), bool)
    x, y = np.arange(len(a)), np.arange(len(b))
    found = np.zeros(out.shape, np.int16)
    for at in range(0, COORDINATES, part):
        found = found + (a[x, None, at : at + part] == b[None, y, at : at + part]).sum(axis=2, dtype=np.int16)
        alive = found + (COORDINATES - min(at + part, COORDINATES)) >= matches
        rows, columns = alive.any(axis=1), alive.any(axis=0)
        x, y, found = x[rows], y[columns], found[np.ix_(rows, columns)]
    out[np.ix_(x, y)] = found >= matches
    return out


def links_of(docs: DataFrame, classes: DataFrame, words: int, percent: int, chunk: int = CHUNK) -> DataFrame:
    """Confirmed links (a, b) between documents of classes: enough of them to join all that are linked."""
    matches = least_matches(percent)
    rows = written(index(classes, matches), "near-index")
    placed = written(homes(rows), "near-homes")

    def made(texts: list[str | None]) -> list[tuple]:
        sets = [shingles(t, words) for t in texts]
        # 16 bits of each coordinate: chance agreements only make a pair that is confirmed, or not, on its sets
        return [(int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")[0]), s.tobytes(), (signature(s) >> _U(16)).astype("<u2").tobytes() if len(s) else b"") for s in sets]

    whole = whole_sets(docs, placed, made, {"k": "long", "shingles": "binary", "signed": "binary"}, "near-sets")
    found = written(members(whole, percent, ("signed",)), "near-members")

    def likely(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(r["signed"]), "<u2").reshape(-1, COORDINATES) for r in (a, b))
        return collide(x, y, matches)

    room = lambda x, y: F.least(x["pos1"], y["pos1"]) + 1 + F.least(x["rest1"], y["rest1"]) >= matches
    apart = links_apart(found, rows, whole, percent, chunk, room, lambda x, y: F.lit(1 + EXTRA), likely, ("signed",))
    return hub_links(found, placed).unionByName(apart)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text): documents whose sets of
    ``words``-word shingles share at least ``percent`` of their union are linked."""
    small_batches(docs.sparkSession)
    sketched = written(sketches(docs, words), "near-sketches")
    taking_part = sketched.filter("n_shingles > 0 and doc_id is not null")
    classes = taking_part.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))
    classes = written(classes, "near-classes")
    found = components(links_of(docs, classes.withColumnRenamed("k1", "k"), words, percent, chunk))
    named = classes.select("k1", "k2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    linked = taking_part.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    alone = sketched.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
