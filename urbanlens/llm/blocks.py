"""Links between classes of texts from an index of postings, by blocks of classes instead of single pairs.

Two operators on sets share this: one posts shingles, the other signature coordinates. Both give ``rows`` (token, k, rep,
n, pos, rest): the lists of the index, where k names a class, rep its document and n its set's size; pos and rest are the
places before and after the token in the class's order of tokens. And both give the classes' sets (k, rep, n, shingles).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanlens.llm.common import row_slices, written
from urbanlens.llm.components import Joined

#: Most classes, and about the most shingles, of a block.
CHUNK, WEIGHT = 128, 1 << 18
#: Matching pairs that are counted at once (their numbers take some 40 bytes each).
MATCHES = 1 << 19
#: Bits that say which documents' sets are asked for (8 MB, whatever their number), and bytes of texts cut up at once.
BITS, SLICE_BYTES = 1 << 26, 1 << 20


def without(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What sorted distinct ``x`` has and sorted distinct ``y`` lacks, sorted."""
    if not len(y):
        return x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return x[y[at] != x]


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all of ``a`` with all of ``b`` (lists of distinct numbers)."""
    out = np.zeros(len(a) * len(b), np.int64)
    if len(a) and len(b) and sum(map(len, a)) and sum(map(len, b)):
        x, who = np.concatenate(a), np.repeat(np.arange(len(a)), [len(s) for s in a])
        y, whose = np.concatenate(b), np.repeat(np.arange(len(b)), [len(s) for s in b])
        order = np.argsort(y, kind="stable")
        y, whose = y[order], whose[order]
        first, last = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
        hit = np.flatnonzero(last > first)
        who, first, many = who[hit], first[hit], (last - first)[hit]
        ends = np.cumsum(many)
        start = 0
        while start < len(many):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + MATCHES, "right")))
            m = many[start:stop]
            at = np.repeat(first[start:stop] - (ends[start:stop] - m - base), m) + np.arange(int(m.sum()))
            out += np.bincount(np.repeat(who[start:stop], m) * len(b) + whose[at], minlength=len(out))
            start = stop
    return out.reshape(len(a), len(b))


def _bit(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), doc_id), F.lit(BITS))


def whole_sets(docs: DataFrame, wanted: DataFrame, make: Callable[[list[str | None]], list[tuple]], columns: dict[str, str], name: str) -> DataFrame:
    """The rows of ``wanted`` (k, rep and more) with what ``make`` gives for the texts of their documents: the class k of a
    text, its set and more (``columns``: name -> type), a row a class, as a table in the shared folder.

    Texts stay where they are. Documents that aren't asked for are left out there by a bitmap of hashed ids, of ``BITS``
    bits at any size; those that it lets pass by chance go in the join, which decides.
    """
    at = _bit(F.col("rep")) + 1
    marked = wanted.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    bits = {r.b - 1: bytes(r.bits) for r in marked}  # a part of the bitmap a row
    size = len(next(iter(bits.values()), b"")) * 8 or 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {b: np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little").astype(bool) for b, x in bits.items()} if len(bits) < 256 else None

        def asked(bit: np.ndarray) -> np.ndarray:
            if parts is not None:
                return np.array([b // size in parts and parts[b // size][b % size] for b in bit.tolist()], bool)
            return np.array([b // size in bits and bits[b // size][b % size >> 3] >> (b & 7) & 1 for b in bit.tolist()], bool)

        for batch in batches:
            batch = batch.filter(pa.array(asked(np.asarray(batch.column("bit")))))
            for rows in row_slices(batch, "text", SLICE_BYTES):
                made = list(zip(*make(rows.column("text").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([rows.column("rep"), *(pa.array(m, t) for m, t in zip(made, kinds, strict=True))], names=["rep", *columns])

    kinds = [pa.int64() if t == "long" else pa.binary() for t in columns.values()]
    asked = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").filter("rep is not null").withColumn("bit", _bit(F.col("rep")))
    found = asked.mapInArrow(cut, "rep long, " + ", ".join(f"{c} {t}" for c, t in columns.items()))
    # an id may have other texts, and a row be repeated
    return written(found.join(wanted, ["rep", "k"]).dropDuplicates(["rep", "k"]), name)


def homes(rows: DataFrame) -> DataFrame:
    """(k, rep, n, home, hub, hub_n): of each class its largest list and that list's smallest document."""
    lists = rows.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("rep", "k", "n")).alias("hub"))
    best = F.max(F.struct("c", "token", "hub")).alias("best")
    return rows.join(lists, "token").groupBy("k", "rep", "n").agg(best).select("k", "rep", "n", F.col("best.token").alias("home"), F.col("best.hub.k").alias("hub"), F.col("best.hub.n").alias("hub_n"))


def fits(n: Column, other: Column, percent: int) -> Column:
    """Whether sets of these sizes may be linked."""
    return (F.least(n, other) * 100) >= (F.greatest(n, other) * percent)


def members(sets: DataFrame, percent: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Of classes (k, rep, n, home, hub, hub_n, shingles) their relation to their hubs (k, rep, n, home, hub, label, by_hub,
    plus, minus): label names the hub that a class is linked with (else itself). Where that is shorter a class is described
    ``by_hub``: plus and minus are its differences from the hub's set; else plus is the whole set. Columns ``more`` (binary)
    stay as they are."""

    def relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (s for batch in batches for s in row_slices(batch, "shingles", SLICE_BYTES)):
            label, by_hub, plus, minus = [], [], [], []
            for k, hub, x, h in zip(*(rows.column(c).to_pylist() for c in ("k", "hub", "shingles", "hub_shingles")), strict=True):
                x, h = np.frombuffer(x, np.uint64), np.frombuffer(h, np.uint64)
                lacks, has = without(h, x), without(x, h)
                both = len(h) - len(lacks)
                linked = 100 * both >= percent * (len(x) + len(h) - both)
                near = len(has) + len(lacks) < len(x)
                label.append(hub if linked else k)
                by_hub.append(near)
                plus.append((has if near else x).tobytes())
                minus.append(lacks.tobytes() if near else b"")
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(label, pa.int64()), pa.array(by_hub), pa.array(plus, pa.binary()), pa.array(minus, pa.binary())], names=[*names, "label", "by_hub", "plus", "minus"])

    names = ["k", "rep", "n", "home", "hub", *more]
    tried = (F.col("hub") != F.col("k")) & fits(F.col("n"), F.col("hub_n"), percent)
    hubs = sets.select(F.col("k").alias("hub"), F.col("shingles").alias("hub_shingles"))
    pairs = sets.filter(tried).join(hubs, "hub").select(*names, "shingles", "hub_shingles")
    own = sets.filter(~tried).select(*names, F.col("k").alias("label"), F.lit(False).alias("by_hub"), F.col("shingles").alias("plus"), F.lit(b"").alias("minus"))
    kinds = "k long, rep long, n long, home long, hub long, " + "".join(f"{c} binary, " for c in more)
    return pairs.mapInArrow(relate, f"{kinds}label long, by_hub boolean, plus binary, minus binary").unionByName(own)


def hub_links(found: DataFrame, placed: DataFrame) -> DataFrame:
    """Links (a, b) between documents: of :func:`members` with their hubs, which :func:`homes` names."""
    hubs = placed.select(F.col("k").alias("hub"), F.col("rep").alias("b"))
    return found.filter("label != k").select(F.col("rep").alias("a"), F.col("label").alias("hub")).join(hubs, "hub").select("a", "b")


def _rebuilt(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray | None, list[np.ndarray], list[np.ndarray]]:
    """The members, their hub's set (None: the block came without one) and their differences from it."""
    plus = [np.frombuffer(x, np.uint64) for x in rows["plus"]]
    minus = [np.frombuffer(x, np.uint64) for x in rows["minus"]]
    lead, by_hub = rows["leads"].to_numpy(), rows["by_hub"].to_numpy()
    if not lead.any():
        return rows, None, plus, minus
    hub, of = plus[int(lead.argmax())], np.flatnonzero(~lead)
    more = [plus[i] if by_hub[i] else without(plus[i], hub) for i in of]
    return rows.iloc[of], hub, more, [minus[i] if by_hub[i] else without(hub, plus[i]) for i in of]


def _whole(hub: np.ndarray | None, plus: list[np.ndarray], minus: list[np.ndarray]) -> list[np.ndarray]:
    return plus if hub is None else [np.sort(np.concatenate([without(hub, m), p])) for p, m in zip(plus, minus, strict=True)]


def answers(sets: list[np.ndarray], sizes: np.ndarray, hub: np.ndarray, plus: list[np.ndarray], minus: list[np.ndarray], others: np.ndarray, open_: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``sets`` are linked with which members of a hub, of the pairs that are ``open_``. The members' overlaps
    follow from the hub's."""
    with_hub = overlaps(sets, [hub])
    more, less = (np.array([len(x) for x in d]) for d in (plus, minus))
    least = percent * (sizes[:, None] + others[None, :])
    sure = open_ & ((100 + percent) * (with_hub - less[None, :]) >= least)
    unsure = open_ & ~sure & ((100 + percent) * (with_hub + more[None, :]) >= least)
    x, y = np.flatnonzero(unsure.any(axis=1)), np.flatnonzero(unsure.any(axis=0))
    if len(x):
        own = [sets[i] for i in x]
        exact = with_hub[x] + overlaps(own, [plus[j] for j in y]) - overlaps(own, [minus[j] for j in y])
        sure[np.ix_(x, y)] |= unsure[np.ix_(x, y)] & ((100 + percent) * exact >= least[np.ix_(x, y)])
    return sure


def links_apart(found: DataFrame, rows: DataFrame, whole: DataFrame, percent: int, chunk: int, room: Callable, least: Callable, likely: Callable | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Links (a, b) between documents of classes that no hub joins: of :func:`members` ``found``, index ``rows`` and
    ``whole`` sets. ``room`` and ``least`` bound blocks that share lists, as in :func:`block_pairs`; ``likely`` rules
    pairs of two blocks' rows out by the columns ``more``."""
    blocked = written(block_names(found, chunk), "blocks")
    names = ["block", "k", "rep", "n", "label", "by_hub", "plus", "minus", *more]
    placed = rows.select("token", "k", "pos", "rest").join(blocked.select("k", "n", "label", "block"), "k")
    reach = lambda x, y: F.least(x["n1"], y["n1"]) * 100 >= F.greatest(x["n0"], y["n0"]) * percent
    pairs = block_pairs(placed, lambda x, y: reach(x, y) & room(x, y), least)
    # a block has one hub; its set goes with each block that is described by it
    hubs = blocked.filter("by_hub").select("block", "hub").distinct()
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in more]
    of_hub = whole.select(F.col("k").alias("hub"), "k", "rep", "n", F.col("k").alias("label"), F.lit(False).alias("by_hub"), F.col("shingles").alias("plus"), F.lit(b"").alias("minus"), *none, F.lit(True).alias("leads"))
    shipped = blocked.select(*names, F.lit(False).alias("leads")).unionByName(hubs.join(of_hub, "hub").select(*names, "leads"))

    def compare(a: pd.DataFrame, b: pd.DataFrame | None) -> list[tuple[int, int]]:
        a, hub, plus, minus = _rebuilt(a)
        b, hub2, plus2, minus2 = (a, hub, plus, minus) if b is None else _rebuilt(b)
        if hub2 is None and hub is not None:
            a, hub, plus, minus, b, hub2, plus2, minus2 = b, hub2, plus2, minus2, a, hub, plus, minus
        n, n2 = a["n"].to_numpy(), b["n"].to_numpy()
        label, label2 = a["label"].to_numpy(), b["label"].to_numpy()
        open_ = (label[:, None] != label2[None, :]) & (100 * np.minimum(n[:, None], n2[None, :]) >= percent * np.maximum(n[:, None], n2[None, :]))
        if likely is not None and open_.any():
            open_ &= likely(a, b)
        x, y = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if not len(x):
            return []
        a, b, n, n2, label, label2, open_ = a.iloc[x], b.iloc[y], n[x], n2[y], label[x], label2[y], open_[np.ix_(x, y)]
        plus, minus, plus2, minus2 = ([d[i] for i in at] for d, at in ((plus, x), (minus, x), (plus2, y), (minus2, y)))
        whole = _whole(hub, plus, minus)
        if hub2 is None:
            linked = open_ & ((100 + percent) * overlaps(whole, plus2) >= percent * (n[:, None] + n2[None, :]))
        else:
            linked = answers(whole, n, hub2, plus2, minus2, n2, open_, percent)
        joined, out, rep, rep2 = Joined(), [], a["rep"].to_numpy(), b["rep"].to_numpy()
        for i, j in zip(*np.nonzero(linked), strict=True):
            if joined.join(int(label[i]), int(label2[j])):
                out.append((int(rep[i]), int(rep2[j])))
        return out

    return met(pairs, shipped, compare)


def block_names(found: DataFrame, chunk: int) -> DataFrame:
    """``found`` (k, n, home, label and more) with ``block``.

    Classes linked with a hub lie in that hub's blocks, others in those of their largest list, by hash. Either way the
    classes of a block have the same hub.
    """
    linked = F.col("label") != F.col("k")
    named = found.withColumn("linked", linked).withColumn("key", F.when(linked, F.col("label")).otherwise(F.col("home")))
    chunks = named.groupBy("linked", "key").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n") / WEIGHT)).cast("long").alias("chunks"))
    block = F.xxhash64("linked", "key", F.pmod(F.xxhash64(F.lit(1), "k"), F.col("chunks")))
    return named.join(chunks, ["linked", "key"]).withColumn("block", block).drop("linked", "key", "chunks")


def block_pairs(placed: DataFrame, possible: Callable[[Callable, Callable], Column], least: Callable[[Column, Column], Column]) -> DataFrame:
    """(i, j): the pairs of blocks that lists of ``placed`` (token, k, pos, rest, n, label, block) bring together in as many
    lists as ``least`` says of their smallest sizes, where ``possible`` holds for their ranges. Blocks of one label only
    don't meet."""
    entries = placed.groupBy("token", "block").agg(
        F.count("*").alias("c"),
        F.min("n").alias("n0"),
        F.max("n").alias("n1"),
        F.max("pos").alias("pos1"),
        F.max("rest").alias("rest1"),
        F.min("label").alias("label0"),
        F.max("label").alias("label1"),
    )
    mixed = entries.groupBy("token").agg(F.min("label0").alias("x"), F.max("label1").alias("y")).filter("x != y").select("token")
    entries = entries.join(mixed, "token")
    kinds = ["block", "c", "n0", "n1", "pos1", "rest1", "label0", "label1"]
    side = lambda s: {c: F.col(f"{s}_{c}") for c in kinds}
    x, y = side("x"), side("y")
    left, right = (entries.select("token", *[F.col(c).alias(f"{s}_{c}") for c in kinds]) for s in "xy")
    pairs = left.join(right, "token").filter((x["block"] < y["block"]) | ((x["block"] == y["block"]) & (x["c"] > 1)))
    apart = F.greatest(x["label1"], y["label1"]) != F.least(x["label0"], y["label0"])
    counted = pairs.filter(apart & possible(x, y)).groupBy(x["block"].alias("i"), y["block"].alias("j")).agg(F.count("*").alias("c"), F.min(x["n0"]).alias("x"), F.min(y["n0"]).alias("y"))
    return counted.filter(F.col("c") >= least(F.col("x"), F.col("y"))).select("i", "j")


def met(pairs: DataFrame, shipped: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame | None], list[tuple[int, int]]]) -> DataFrame:
    """Links (a, b) that ``compare`` finds between the rows of ``shipped`` (block and more) of each pair of blocks; a block
    held against itself comes without a second one."""
    sides = pairs.select("i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("block", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")))
    # by both names: pairs of one block are spread over tasks
    rows = sides.join(shipped, "block").drop("block").repartition("i", "j")

    def held(key: tuple, group: pa.Table) -> pa.Table:
        pdf = group.to_pandas()
        first, second = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        found = compare(first, None if key[0].as_py() == key[1].as_py() else second)
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.groupBy("i", "j").applyInArrow(held, "a long, b long")
