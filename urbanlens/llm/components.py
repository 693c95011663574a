"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from urbanlens.llm.common import written

#: Links that a task joins at once, a bound on its memory.
SLICE = 1 << 17


class Joined:
    """Union-find; a group is named by its least member."""

    def __init__(self) -> None:
        self.names: dict = {}

    def root(self, x):
        names = self.names
        top = x
        while (up := names.get(top, top)) != top:
            top = up
        while (up := names.get(x, x)) != top:
            names[x] = top
            x = up
        return top

    def join(self, x, y) -> bool:
        """Whether that joined two groups."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.names[max(x, y)] = min(x, y)
        self.names.setdefault(min(x, y), min(x, y))
        return True


def _forests(links: DataFrame) -> DataFrame:
    """The same components with fewer links: in each slice of links every node hangs on its group's least node."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            groups = Joined()
            for x, y in held:
                for a, b in zip(x, y, strict=True):
                    groups.join(a, b)
            pairs = [(x, r) for x in list(groups.names) if (r := groups.root(x)) != x]
            a, b = np.array(pairs, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            size += batch.num_rows
            if size >= SLICE:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return links.select("a", "b").mapInArrow(stars, "a long, b long")


def _kept(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The written links and, from the job that writes them, what tells whether they changed."""
    seen = Observation()
    out = written(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "links")
    return out, (seen.get["n"], seen.get["s"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); a component's id is its smallest node.

    Slices of links are joined in their tasks first. Then large-star and small-star in turn until the links don't change:
    every node comes to hang on the smallest of its component. A turn is aggregations and equi-joins, written to the
    shared folder; no links reach the driver. A node with many links is split by the joins, as nothing above them needs
    its links in one task.
    """
    links = _forests(links.filter("a != b")).distinct()
    links, state = _kept(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # of a node's larger neighbours each comes to hang on the least of them all
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        before = state
        links, state = _kept(small.filter("a != b").distinct())
        if state == before:
            break
    # converged: every link leads from a node to the smallest of its component
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
