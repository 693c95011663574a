"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanlens.session import fresh_dir

#: Unicode white space, as the regular expressions of the public tokenizers read ``\s``; the inside of a character class.
SPACE = "\\x09-\\x0d \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Rows of texts, sets or lines that an Arrow function gets at once.
BATCH_ROWS = 1000
#: ASCII white space, the word separators of the word-based operators.
ASCII_SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, so a lost executor costs only what reads it."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Arrow functions ``BATCH_ROWS`` rows at once at most, or what it is set to if less. Spark's
    10,000 are tens of MB of texts or sets; an executor holds several such batches a core, in its JVM and its workers, and
    both keep what they once took. The setting stays, as lazily read results need it; rows and results don't depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def unused(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores after them where a table has them already (in any case)."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def about(df: DataFrame, key: str, most: int, n: int) -> DataFrame:
    """About ``most`` of the ``n`` rows, those of the smallest hashes of ``key``: a filter, so nothing is gathered to choose them."""
    cut = 1 << 30
    return df if n <= most else df.filter(F.pmod(F.xxhash64(F.lit(5), key), F.lit(cut)) < int(cut * most / n))


def row_slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterable[pa.RecordBatch]:
    """The batch in slices of about ``most_bytes`` of one text column (one row at least)."""
    start = size = 0
    for i, x in enumerate(batch.column(column)):
        size += x.as_buffer().size if x.is_valid else 0
        if size >= most_bytes:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


class Remembered:
    """What a function of a batch of strings gave, by string, in two generations of bounded size.

    A full generation becomes the old one; strings seen again move over, so frequent ones stay.
    """

    def __init__(self, compute: Callable[[list[str]], list], limit: int = 400_000):
        self.compute, self.limit = compute, limit
        self.new: dict = {}
        self.old: dict = {}

    def of_groups(self, groups: list[list[str]]) -> Iterator[list]:
        """The values of several lists of strings, list by list. Each string that occurs in them is looked up once in
        the generations; a small table of their own serves all its occurrences."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        here = dict.fromkeys(chain.from_iterable(groups))
        missing = []
        for s in here:
            value = new.get(s)
            if value is None:
                value = old.get(s)
                if value is None:
                    missing.append(s)
                    continue
                new[s] = value
            here[s] = value
        computed = dict(zip(missing, self.compute(missing), strict=True))
        new.update(computed)
        here.update(computed)
        for g in groups:
            yield [*map(here.__getitem__, g)]


_KEPT: dict = {}


def kept(key: tuple, make: Callable[[], object]):
    """What ``make`` gave for the key, kept in this worker process for the tasks that follow until another key is asked
    for: a worker that goes on to another operator, as in a pipeline, lets the former one's memory go."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]
