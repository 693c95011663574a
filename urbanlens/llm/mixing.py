"""Mixing sources to target weights, on DataFrame functions only.

Sizes are added up by source, targets are shares of the whole by weight, none above ``most`` times its source, and a
source's repetition rate is its target over its size. A document is emitted floor(rate) times, and once more if its
hash-seeded uniform number falls below the fraction: a Bernoulli copy that reruns repeat.

Targets are found in rounds over the table of sources, each one aggregation to a single row: sources whose share is
over their bound are set to it, and what is left is shared anew among the rest. Sources are ranked in two steps, so
that no task holds all of them.

Results by case: a null or empty text has size 0; a null source is a source of its own, the last; a source or a whole
table of size 0 has target 0 and no copies; repeated rows are rows of their own, and rows of equal ids are copied alike;
an empty table gives no rows. Columns of ``docs`` are kept by :func:`mix` (its own are named ``_mix_...`` meanwhile).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanlens.llm.common import ASCII_SPACE, shuffle_partitions, written

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{ASCII_SPACE}]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """``_mix_rank`` from 0 by source, null last: the place in its range and the sources of the ranges before."""
    spark = sources.sparkSession
    ranged = written(sources.repartitionByRange(shuffle_partitions(spark), F.col("_mix_source").asc_nulls_last()).withColumn("_mix_part", F.spark_partition_id()), "mix-sources")
    place = F.row_number().over(Window.partitionBy("_mix_part").orderBy(F.col("_mix_source").asc_nulls_last())) - 1
    parts = ranged.groupBy("_mix_part").agg(F.count("*").alias("n"))  # one row a partition
    before = parts.select("_mix_part", (F.sum("n").over(Window.orderBy("_mix_part")) - F.col("n")).alias("_mix_before"))
    return ranged.withColumn("_mix_place", place).join(F.broadcast(before), "_mix_part").withColumn("_mix_rank", F.col("_mix_place") + F.col("_mix_before")).drop("_mix_part", "_mix_place", "_mix_before")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(_mix_source, source_size, target) from ``sized`` (_mix_source, _mix_size)."""
    sums = sized.groupBy("_mix_source").agg(F.sum("_mix_size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_mix_rank") % len(weights) + 1).cast("int")).cast("long")
    sources = written(_ranked(sums).select("_mix_source", "source_size", weight.alias("_mix_weight")), "mix-weights")
    bound = F.col("source_size") * most
    full = F.lit(False)  # whether the source stands at its bound
    left_before = None
    total = sources.agg(F.sum("source_size").alias("n")).first().n or 0
    while True:
        r = sources.agg(F.coalesce(F.sum(F.when(full, bound)), F.lit(0)).alias("taken"), F.coalesce(F.sum(F.when(~full, F.col("_mix_weight"))), F.lit(0)).alias("weight")).first()
        left = (share * total - r.taken, r.weight)
        part = F.lit(left[0]) * F.col("_mix_weight") / F.lit(float(max(left[1], 1)))
        if left == left_before or not left[1]:
            break
        # part grows from round to round, so a source once at its bound stays there
        left_before, full = left, part > bound
    return sources.select("_mix_source", "source_size", F.when(full | (part > bound), bound.cast("double")).otherwise(part).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the key (null: empty)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of each row, and the columns ``keep``."""
    sized = docs.select("doc_id", F.col("source").alias("_mix_source"), word_count(F.col("text")).alias("_mix_size"), *(F.col(c).alias(f"_mix_own_{c}") for c in keep))
    targets = source_targets(sized, weights, share, most)
    joined = sized.alias("d").join(targets.alias("t"), F.col("d._mix_source").eqNullSafe(F.col("t._mix_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = F.when(uniform(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    n = (F.floor(rate) + extra).cast("long")
    out = joined.select("doc_id", F.col("_mix_size").alias("size"), "source_size", "target", n.alias("copies"), *(F.col(f"_mix_own_{c}") for c in keep))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept."""
    names = docs.columns
    planned = copies(docs, weights, share, most, seed, keep=tuple(names))
    rows = planned.filter("copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*(F.col(f"_mix_own_{c}").alias(c) for c in names))
