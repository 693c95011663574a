"""Approximate nearest neighbours by balanced posting lists.

* Centroids come from balanced hierarchical clustering of about ``SAMPLE`` vectors at most (those of the smallest id hashes):
  a set is split by k-means until its parts are small, so dense regions get more lists. There are as many lists as the
  square root of the number of vectors, ``LISTS`` at most. Every vector is indexed.
* A vector goes to its nearest centroid's list, and near a boundary to those of up to ``COPIES`` centroids: such as are
  within a ratio of the nearest distance, and nearer to the vector than to a centroid chosen before.
* Centroids are searched by best-first beams in a neighbour graph that is kept in memory. A query reads the lists whose
  centroids are within a ratio of its nearest one's distance, and more while those hold too few vectors. A query whose
  beam ends before that is held against every centroid, so no number of lists bounds what it reads.
* The ratio is fitted: about ``TRIALS`` vectors of the sample are held against all vectors, and the ratio is the one at
  which their lists hold ``RECALL`` of their true neighbours.
* A query reads in two steps. Its nearest lists, ``FIRST`` vectors or more, give the score that a neighbour must reach.
  Of its other lists those are skipped whose centroid is so far, and whose radius so small, that they can't hold one (no
  neighbour is lost by that); the rest return only vectors that reach it, so about ``k`` a query are handed on.
* Lists are stored in blocks of about ``BLOCK`` vectors, and a list's queries in blocks of about as many, so a list of
  many equal vectors is spread over tasks. A task scores its block pair; each query's best are merged afterwards.

Scores are cosines in double precision on the original vectors. Results by case: vectors that are null, zero or hold a
null or a non-finite component take no part, neither do rows without an id; equal scores go to the smaller id; a query
never finds its own row; with fewer candidates than asked for all are found; rows that repeat both id and vector count
once, and rows of one id with other vectors are vectors of their own (found once where they score equally); an empty
table gives no rows; vectors of different lengths are an error; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanlens.llm.common import about, written

SAMPLE, LISTS, BLOCK = 20_000, 4096, 2048
COPIES, COPY_RATIO, BEAM, LINKS, FAR_LINKS, SEARCHED = 2, 1.03, 96, 24, 4, 1024
#: Vectors whose true neighbours fit the ratio, the share of these to be found, and what a query's first step reads.
TRIALS, RECALL, FIRST = 256, 0.98, 512


def valid(vector: Column) -> Column:
    x = vector.cast("array<double>")
    return F.coalesce(F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & F.exists(x, lambda v: v != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = set(column.value_lengths().to_pylist())
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    return np.asarray(column.flatten(), "f8").reshape(len(column), -1)


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """About ``lists`` unit centroids of unit vectors, each of about as many of them."""
    rng = np.random.default_rng(seed)
    most = max(1, len(x) / lists)
    found, open_ = [], [np.arange(len(x))]
    while open_:
        part = open_.pop()
        ways = min(8, math.ceil(len(part) / most))
        points = x[part]
        if ways > 1 and np.ptp(points, axis=0).max() > 1e-9:
            centres = points[rng.choice(len(part), ways, replace=False)]
            load = np.zeros(ways)
            for _ in range(8):
                # a part that holds more than its share looks farther away
                near = (points @ centres.T - 0.1 * load / len(part)).argmax(axis=1)
                load = np.bincount(near, minlength=ways).astype(float)
                for c in np.flatnonzero(load):
                    centres[c] = points[near == c].mean(axis=0)
                centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
            pieces = [part[near == c] for c in range(ways) if load[c]]
            if len(pieces) > 1:
                open_ += pieces
                continue
        centre = points.mean(axis=0)
        norm = np.linalg.norm(centre)
        found.append(centre / norm if norm > 1e-9 else points[0])
    return np.array(found)


class Graph:
    """Centroids linked with their nearest ones and a few others, for best-first search of many vectors at once."""

    def __init__(self, centres: np.ndarray, seed: int = 7):
        self.centres = centres
        n, rng = len(centres), np.random.default_rng(seed)
        near = min(LINKS, n - 1)
        links = []
        for at in range(0, n, 512):
            c = centres[at : at + 512] @ centres.T
            c[np.arange(len(c)), np.arange(at, at + len(c))] = -9
            links.append(np.argpartition(-c, near - 1, axis=1)[:, :near] if near else np.zeros((len(c), 0), int))
        self.links = np.hstack([np.vstack(links), rng.integers(0, n, (n, FAR_LINKS))])
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def search(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit vector the found centroids, nearest first, and their distances (missing: -1 and infinity)."""
        rows, n = np.arange(len(q)), len(self.centres)
        beam = min(beam, n)
        seen = np.zeros((len(q), n), bool)
        seen[:, self.entries] = True
        ids = np.full((len(q), beam + len(self.entries)), -1)
        close = np.full(ids.shape, -np.inf)
        ids[:, : len(self.entries)] = self.entries
        close[:, : len(self.entries)] = q @ self.centres[self.entries].T
        order = np.argsort(-close, axis=1, kind="stable")[:, :beam]
        ids, close = np.take_along_axis(ids, order, 1), np.take_along_axis(close, order, 1)
        done = np.zeros(ids.shape, bool)
        while True:
            todo = ~done & (ids >= 0)
            active = rows[todo.any(axis=1)]
            if not len(active):
                break
            at = todo[active].argmax(axis=1)  # the nearest that hasn't been expanded
            done[active, at] = True
            next_ = self.links[ids[active, at]]
            new = ~seen[active[:, None], next_]
            # a centroid named twice in one row counts once
            order = np.argsort(next_, axis=1, kind="stable")
            sorted_ = np.take_along_axis(next_, order, 1)
            twice = np.zeros(new.shape, bool)
            np.put_along_axis(twice, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
            new &= ~twice
            seen[active[:, None], next_] = True
            c = np.where(new, np.einsum("ijk,ik->ij", self.centres[next_], q[active]), -np.inf)
            all_ids, all_close = np.hstack([ids[active], np.where(new, next_, -1)]), np.hstack([close[active], c])
            all_done = np.hstack([done[active], np.zeros(new.shape, bool)])
            order = np.argsort(-all_close, axis=1, kind="stable")[:, :beam]
            ids[active], close[active], done[active] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_close, all_done))
        return ids, np.where(ids >= 0, np.sqrt(np.maximum(2 - 2 * close, 0)), np.inf)

    def all(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with every centroid, without a search."""
        close = q @ self.centres.T
        ids = np.argsort(-close, axis=1, kind="stable")
        return ids, np.sqrt(np.maximum(2 - 2 * np.take_along_axis(close, ids, 1), 0))


def lists_of(graph: Graph, x: np.ndarray) -> list[list[int]]:
    """The lists of each unit vector: its nearest centroid's, and others' near a boundary."""
    ids, far = graph.search(x, 16)
    out = []
    for row, d in zip(ids, far, strict=True):
        chosen = [int(row[0])]
        for c, dist in zip(row[1:], d[1:], strict=True):
            if dist > COPY_RATIO * d[0] + 1e-9 or len(chosen) == COPIES:
                break
            if dist <= np.sqrt(np.maximum(2 - 2 * (graph.centres[chosen] @ graph.centres[c]), 0)).min():
                chosen.append(int(c))
        out.append(chosen)
    return out


def _scored(q: np.ndarray, own: np.ndarray, who: np.ndarray, x: np.ndarray, norms: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(query id, vector id, cosine): of each query the ``k`` best places among ``x``, an id that scores twice alike being
    one; with ``least`` only those that reach it."""
    order = np.argsort(ids, kind="stable")
    ids, x, norms = ids[order], x[order], norms[order]
    most = int(np.unique(ids, return_counts=True)[1].max())  # an id's vectors may score equally and are one place then
    out = []
    for at in range(0, len(who), 512):
        close = (q[at : at + 512] / own[at : at + 512, None]) @ (x / norms[:, None]).T
        close[who[at : at + 512, None] == ids[None, :]] = -np.inf
        top = min(k * most, close.shape[1])
        floor = np.partition(close, -top, axis=1)[:, -top]
        if least is not None:
            floor = np.maximum(floor, least[at : at + 512])
        for i, row in enumerate(close):
            near = np.flatnonzero((row >= floor[i] - 1e-9) & np.isfinite(row))
            # scored one by one, so that equal vectors score equally wherever they lie
            exact = (x[near] * q[at + i]).sum(axis=1) / (norms[near] * own[at + i])
            if least is not None:
                reach = exact >= least[at + i]
                near, exact = near[reach], exact[reach]
            best = np.argsort(-exact, kind="stable")
            if most > 1:
                _, first = np.unique(np.rec.fromarrays([exact[best], ids[near[best]]]), return_index=True)
                best = best[np.sort(first)]
            out += [(int(who[at + i]), int(ids[near[b]]), float(exact[b])) for b in best[:k]]
    return out


_FOUND = "query_id long, vec_id long, score double"


def _table(found: list[tuple[int, int, float]]) -> pa.Table:
    columns = list(zip(*found, strict=True)) or [[], [], []]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])


def true_neighbours(vectors: DataFrame, q: np.ndarray, who: np.ndarray, k: int) -> dict[int, list[int]]:
    """Of each query (``TRIALS`` of them, say) the ids of its ``k`` nearest among all ``vectors``, by brute force: every
    batch of vectors hands on its best, and those of a query are merged."""
    own = np.linalg.norm(q, axis=1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            for i, v, c in _scored(q, own, who, x, np.linalg.norm(x, axis=1), np.asarray(batch.column("vec_id")), k):
                held[i] = sorted({*held.get(i, []), (-c, v)})[:k]
        yield from _table([(i, v, -c) for i, found in held.items() for c, v in found]).to_batches()

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = vectors.select("vec_id", "embedding").mapInArrow(best, _FOUND).distinct().withColumn("rank", rank).filter(F.col("rank") <= k)
    out: dict[int, list[int]] = {}
    for r in found.collect():  # k rows a trial
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def fitted_ratio(vectors: DataFrame, graph: Graph, ids: np.ndarray, x: np.ndarray, k: int) -> float:
    """The ratio at which the lists of the sample's trial vectors hold ``RECALL`` of their true neighbours."""
    trials = np.unique(np.linspace(0, len(x) - 1, min(len(x), TRIALS)).astype(int))
    true = true_neighbours(vectors, x[trials], ids[trials], k)
    named = sorted({v for found in true.values() for v in found})
    if not named:
        return 1.0
    rows = vectors.filter(F.col("vec_id").isin(named)).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).toArrow()  # k a trial at most
    lists = dict(zip(rows["vec_id"].to_pylist(), lists_of(graph, _unit(_matrix(rows["embedding"].combine_chunks()))), strict=True))
    ratios = []
    for i, t in zip(ids[trials].tolist(), trials, strict=True):
        far = np.sqrt(np.maximum(2 - 2 * (graph.centres @ x[t]), 0))
        ratios += [far[lists[v]].min() / max(far.min(), 1e-12) for v in true.get(i, [])]
    return float(np.quantile(ratios, RECALL, method="higher"))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, ratio: float | None = None, seen: Callable[[dict], None] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each row of ``vectors`` (vec_id, embedding) that fits
    ``queries``. ``ratio`` overrides the fitted one; ``seen`` is called with what was fitted."""
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", queries.alias("asks")).filter(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    # a row that is repeated would take places from other vectors, and lists would fill with it
    clean = written(clean.groupBy("vec_id", "embedding").agg(F.max("asks").alias("asks")), "vectors").withColumn("embedding", F.col("embedding").cast("array<double>"))
    n = clean.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = about(clean.select("vec_id", "embedding"), "vec_id", SAMPLE, n).orderBy("vec_id").toArrow()
    if not sample.num_rows:  # all ids alike, say
        sample = clean.select("vec_id", "embedding").limit(SAMPLE).toArrow()
    x = _unit(_matrix(sample["embedding"].combine_chunks()))
    graph = Graph(balanced_centroids(x, max(1, min(LISTS, math.isqrt(n), len(x) // 4))))
    reach = fitted_ratio(clean, graph, np.asarray(sample["vec_id"]), x, k) if ratio is None else ratio

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SEARCHED):
                part = batch.slice(at, SEARCHED)
                unit = _unit(_matrix(part.column("embedding")))
                found = lists_of(graph, unit)
                row, of = np.repeat(np.arange(part.num_rows), [len(f) for f in found]), np.array([c for f in found for c in f])
                close = (unit[row] * graph.centres[of]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), part.column("vec_id").take(pa.array(row)), part.column("embedding").take(pa.array(row)), pa.array(close)], names=["list", "vec_id", "embedding", "close"])

    posted = written(clean.select("vec_id", "embedding").mapInArrow(post, "list int, vec_id long, embedding array<double>, close double"), "posting-lists")
    size = {r.list: r for r in posted.groupBy("list").agg(F.count("*").alias("n"), F.min("close").alias("close")).collect()}  # at most LISTS rows
    sizes = np.array([size[c].n if c in size else 0 for c in range(len(graph.centres))])
    radii = np.array([np.arccos(np.clip(size[c].close, -1, 1)) if c in size else 0.0 for c in range(len(graph.centres))])
    enough = (k + 1) * COPIES  # postings that hold k vectors besides the query's own, whatever is posted twice
    beam = BEAM
    if seen:
        seen({"ratio": reach, "lists": len(graph.centres), "postings": int(sizes.sum()), "sizes": sizes, "graph": graph})

    def to_read(ids: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the found lists, nearest first, a query reads, and which of these first."""
        held = np.cumsum(np.where(ids >= 0, sizes[ids], 0), axis=1)
        before = np.hstack([np.zeros((len(ids), 1)), held[:, :-1]])
        read = (ids >= 0) & ((far <= reach * far[:, :1] + 1e-9) | (before < enough))
        first = (ids >= 0) & (before < FIRST) & read
        # where the graph's search found fewer than the beam holds, those may be not all
        read[:, -1] |= ids[:, -1] < 0
        return read, first

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SEARCHED):
                part = batch.slice(at, SEARCHED)
                unit = _unit(_matrix(part.column("embedding")))
                ids, far = graph.search(unit, beam)
                read, first = to_read(ids, far)
                rows = [(i[r], d[r], f[r]) for i, d, r, f in zip(ids, far, read, first, strict=True)]
                cut = np.flatnonzero(read[:, -1])  # the beam ends before the ratio does, or holds too little
                if len(cut):
                    ids, far = graph.all(unit[cut])
                    for c, i, d, r, f in zip(cut, ids, far, *to_read(ids, far), strict=True):
                        rows[c] = (i[r], d[r], f[r])
                # the best cosine that a list may hold: its centroid's angle less its radius
                best = [np.cos(np.maximum(2 * np.arcsin(np.minimum(d / 2, 1)) - radii[i], 0)) + 1e-9 for i, d, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i[f].tolist() for i, _, f in rows], pa.list_(pa.int32())), pa.array([i[~f].tolist() for i, _, f in rows], pa.list_(pa.int32())), pa.array([b[~f].tolist() for b, (_, _, f) in zip(best, rows, strict=True)], pa.list_(pa.float64())), part.column("vec_id"), part.column("embedding")],
                    names=["first", "later", "best", "query_id", "query"])

    # a query's lists lie in one row, so its vector is written once however many it reads
    wanted = written(clean.filter("asks").select("vec_id", "embedding").mapInArrow(ask, "first array<int>, later array<int>, best array<double>, query_id long, query array<double>"), "posting-queries")
    parts = F.array(*[F.lit(max(1, math.ceil(int(s) / BLOCK))) for s in sizes])

    def score(key: tuple, p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return _table([])
        x, y = _matrix(p["embedding"].combine_chunks()), _matrix(q["query"].combine_chunks())
        return _table(_scored(y, np.linalg.norm(y, axis=1), np.asarray(q["query_id"]), x, np.linalg.norm(x, axis=1), np.asarray(p["vec_id"]), k, np.asarray(q["least"])))

    def found_in(asked: DataFrame) -> DataFrame:
        """What the lists of ``asked`` (list, query_id, query, least) return."""
        load = {r.list: r.n for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most LISTS rows
        turns = F.array(*[F.lit(max(1, math.ceil(load.get(c, 0) / BLOCK))) for c in range(len(sizes))])
        many = lambda a: F.get(a, F.col("list"))
        every = lambda a: F.explode(F.sequence(F.lit(0), many(a) - 1))
        left = posted.select("list", "vec_id", "embedding").withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), many(parts)).cast("int")).withColumn("turn", every(turns))
        right = asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), many(turns)).cast("int")).withColumn("part", every(parts))
        keys = ["list", "part", "turn"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, _FOUND)

    none = F.lit(float("-inf")).alias("least")
    start = written(found_in(wanted.select(F.explode("first").alias("list"), "query_id", "query", none)).distinct(), "neighbours")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = start.withColumn("rank", rank).filter(F.col("rank") <= k)
    # rows of one id are queries of their own vectors; the score to reach is the least of theirs
    due = ranked.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s")).select("query_id", F.when(F.col("c") == k, F.col("s")).alias("least"))
    rest = wanted.join(due, "query_id", "left").select("query_id", "query", F.coalesce("least", F.lit(float("-inf"))).alias("least"), F.explode(F.arrays_zip("later", "best")).alias("l"))
    rest = written(rest.filter(F.col("l.best") >= F.col("least")).select(F.col("l.later").alias("list"), "query_id", "query", "least"), "posting-queries")
    found = start.unionByName(found_in(rest)).distinct()
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
