"""Centroid clustering in integers, on JVM expressions only.

* Components become integers, ``floor(scale * x)``, so distances and sums are exact and the same on any number of tasks.
* The starting centroids are the vectors of the smallest SHA-256 of ``seed:id`` (a top-k over the table, ``clusters`` rows).
* A round is one scan: ``zip_with`` and ``aggregate`` give the squared distance to every literal centroid, ``array_min``
  over (distance, number) structs picks the cluster, and grouped column sums move the centroids. Sums are partial in each
  task, so a cluster that holds most vectors shuffles one row a task; only ``clusters`` rows of sums reach the driver.

Results by case: a vector that is null, has another number of components, or holds a null or a non-finite one takes no
part and gives no row; integers are held to +-2^27, so that every squared distance fits a long; equal distances go to the
smaller centroid number; a cluster that loses all its vectors keeps its centroid; repeated rows count as often as they
occur (and may all start as centroids); equal hashes (repeated ids, or none: a null id hashes as the empty string) go by
id, then by components; fewer vectors than ``clusters`` give as many centroids as there are vectors; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanlens.llm.common import written

#: Squared distances of so many components of at most twice this size stay below 2^62.
MOST, MOST_SIZE = 1 << 27, 64


def integers(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that take part, in integers."""
    if size > MOST_SIZE:
        raise ValueError(f"distances of {size} components may not fit a long; {MOST_SIZE} at most")
    x = F.col("embedding").cast("array<double>")
    whole = (F.size("embedding") == size) & F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    held = lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("long")
    return vectors.filter(F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, held).alias("v"))


def _literal(numbers: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{n}L' for n in numbers)})")


def assigned(v: Column, centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the nearest centroid; ties go to the smaller number."""
    def distance(c: list[int]) -> Column:
        return F.aggregate(F.zip_with(v, _literal(c), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def first_centroids(points: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r.v for r in points.select(key.alias("key"), "vec_id", "v").orderBy("key", "vec_id", "v").limit(clusters).collect()]


def moved(points: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """The centroids after one round: exact floored means of what is nearest to each."""
    near = points.select("v", assigned(F.col("v"), centroids)["cluster"].alias("cluster"))
    sums = near.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(size)]).collect()
    after = list(centroids)
    for r in sums:
        after[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(size)]
    return after


def clusters_of(vectors: DataFrame, clusters: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, watch: Callable[[list[list[int]]], None] | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each row of ``vectors`` (vec_id,
    embedding) that takes part. ``watch`` is called with each round's centroids."""
    points = integers(vectors, size, scale)
    centroids = first_centroids(points, clusters, seed)
    if not centroids:
        none = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return points.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    for _ in range(rounds):
        if watch:
            watch(centroids)
        centroids = moved(points, centroids, size)
    if watch:
        watch(centroids)
    near = written(points.select("vec_id", assigned(F.col("v"), centroids).alias("near")).select("vec_id", "near.cluster", "near.distance"), "clusters")
    held = {r.cluster: int(r.s) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # a row a centroid
    digests = F.array(*[F.lit(sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids])
    return near.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(_literal([held.get(i, 0) for i in range(len(centroids))]), F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(held.values())).cast("long").alias("inertia"),
        F.get(digests, F.col("cluster")).alias("centroid_sha256"),
    )
