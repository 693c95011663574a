"""Geo operators: nearest area (J2), box join point <-> incidents (J3), recent-years filter (J4),
mode of nearby types (A22) and historical route risk (R6).

The box join is an equi-join on nested grid cells, over incidents added up per
exact coordinate. Cells that lie inside a point's box answer with their summed
counts (or histograms of types); the exact inclusive ``between`` test runs only
for coordinates in cells on the box's border, and a border cell that holds many
of them is first split into smaller cells. So a hot cell costs a point its
border's share, not all the cell's coordinates.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanlens.functions import text, vocab
from urbanlens.session import written

BOX_HALF = vocab.HIST_BOX
# Cell edges of the levels: a box overlaps at most 3 x 3 cells of the first, half as wide as the box; border cells of more
# than LIGHT coordinates are split into 4 x 4 of the next. On the last level 1/32 of the box's width is left to test.
EDGES = (BOX_HALF, BOX_HALF / 4, BOX_HALF / 16)
LIGHT = 128


# ---------------------------------------------------------------- J2 nearest area
def nearest_area(points: DataFrame, centroids: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Name of the area whose centroid is nearest (squared Euclidean); ties -> alphabetically first.

    One exact path for any number of areas, without a cross join: round r uses
    cells of size ``s * 4**r``, candidates come from the 3 x 3 block around the
    point's cell (equi-join on cells). A point is settled when its best distance
    is at most the cell size (nothing outside the block can be closer); the rest
    go on to the next, coarser round. The first size is that of a grid with
    about one centroid a cell, so most points settle in the first rounds; the
    last is the first one beyond the extent of points and centroids, where every
    point settles. Each distinct coordinate is matched once.

    Points with a null, NaN or infinite coordinate get null; such centroids, and
    those without a name, are ignored; without any named centroid every point
    gets the default area.
    """
    from urbanlens.session import shared_dir

    def finite(la, lo):
        return F.abs(la) + F.abs(lo) < F.lit(float("inf"))  # false for null, NaN (greater than any) and infinities

    shared_dir(points.sparkSession)  # checkpoint() below needs the shared checkpoint folder
    named = centroids.filter(F.col("area_name").isNotNull())
    if named.isEmpty():
        return points.withColumn("nearest_area", F.lit("Central"))
    cents = named.filter(finite(F.col("lat"), F.col("lon"))).select(
        F.col("area_name").alias("area"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    todo = points.select(F.col(lat).alias("p_lat"), F.col(lon).alias("p_lon")).filter(finite(F.col("p_lat"), F.col("p_lon"))).distinct()
    n, la0, la1, lo0, lo1 = cents.agg(F.count(F.lit(1)), F.min("c_lat"), F.max("c_lat"), F.min("c_lon"), F.max("c_lon")).first()
    if not n:
        return points.withColumn("nearest_area", F.lit(None).cast("string"))
    done = None
    size = max(la1 - la0, lo1 - lo0, 0.01) / n ** 0.5
    off = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    while not todo.isEmpty():
        cc = cents.select("*", F.floor(F.col("c_lat") / size).alias("cy"), F.floor(F.col("c_lon") / size).alias("cx"))
        pc = todo.select("*", F.explode(off).alias("dy")).select("*", F.explode(off).alias("dx")).select(
            "p_lat", "p_lon",
            (F.floor(F.col("p_lat") / size) + F.col("dy")).alias("cy"),
            (F.floor(F.col("p_lon") / size) + F.col("dx")).alias("cx"),
        )
        d2 = F.pow(F.col("c_lat") - F.col("p_lat"), F.lit(2.0)) + F.pow(F.col("c_lon") - F.col("p_lon"), F.lit(2.0))
        # a left join keeps points without a candidate, so one table holds the settled and the rest
        best = pc.join(cc, ["cy", "cx"], "left").groupBy("p_lat", "p_lon").agg(
            F.min(F.when(F.col("area").isNotNull(), F.struct(d2.alias("d2"), F.col("area")))).alias("b")).checkpoint()
        near = F.coalesce(F.col("b.d2") <= size * size, F.lit(False))
        settled = best.filter(near).select("p_lat", "p_lon", F.col("b.area").alias("nearest_area"))
        done = settled if done is None else done.unionByName(settled)
        todo = best.filter(~near).select("p_lat", "p_lon")
        size *= 4
    if done is None:
        return points.withColumn("nearest_area", F.lit(None).cast("string"))
    found = points.join(done, (F.col(lat) == F.col("p_lat")) & (F.col(lon) == F.col("p_lon")), "left")
    return found.select(*points.columns, "nearest_area")


# ---------------------------------------------------------------- J3 box join
def _finite(*c: Column) -> Column:
    return reduce(and_, [F.coalesce(F.abs(x) < float("inf"), F.lit(False)) for x in c])  # false for null, NaN and infinities


def coordinate_counts(incidents: DataFrame, with_type: bool = False) -> DataFrame:
    """(i_lat, i_lon, cnt[, hist]): incidents added up per exact coordinate; ``hist`` holds (type, count) pairs."""
    at = incidents.filter(_finite(F.col("lat"), F.col("lon"))).withColumnsRenamed({"lat": "i_lat", "lon": "i_lon"})
    if not with_type:
        return at.groupBy("i_lat", "i_lon").agg(F.count(F.lit(1)).alias("cnt"))
    per_type = at.groupBy("i_lat", "i_lon", "crm_cd_desc").agg(F.count(F.lit(1)).alias("cnt"))
    return per_type.groupBy("i_lat", "i_lon").agg(F.sum("cnt").alias("cnt"), _hist())


def _hist() -> Column:
    # as many pairs as there are types, whatever the number of incidents
    return F.collect_list(F.struct(F.col("crm_cd_desc").alias("type"), F.col("cnt").alias("n"))).alias("hist")


def cell_index(coords: DataFrame, with_type: bool = False, edges: tuple[float, ...] = EDGES) -> tuple[DataFrame, DataFrame]:
    """Coordinates under their cell of every level, and the cells: (level, cy, cx, coords, cnt[, hist])."""
    levels = F.explode(F.array(*[F.struct(F.lit(r).alias("level"), _cell(F.col("i_lat"), e).alias("cy"), _cell(F.col("i_lon"), e).alias("cx")) for r, e in enumerate(edges)]))
    placed = coords.select("*", levels.alias("c")).select("c.*", *coords.columns)
    key = ["level", "cy", "cx"]
    cells = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("coords"), F.sum("cnt").alias("cnt"))
    if with_type:
        typed = placed.select(*key, F.explode("hist").alias("h")).groupBy(*key, F.col("h.type").alias("crm_cd_desc")).agg(F.sum("h.n").alias("cnt"))
        cells = cells.join(typed.groupBy(*key).agg(_hist()), key)
    return placed, cells


def _cell(c: Column, edge: float) -> Column:
    return F.floor(c / F.lit(edge))


def _parts(points: DataFrame, cells: DataFrame, key: list[str], lat: str, lon: str, half: float,
           edges: tuple[float, ...], light: int, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """What each point's box is made of: whole cells with their sums, and (level, cell) pairs to test exactly.

    Cells strictly between those of the box's edges lie inside it (floors are monotone), so their sums count whole. Of
    the cells on its border, those of at most ``light`` coordinates are tested; a fuller one gives way to its 4 x 4
    cells of the next level, down to the last. (Edges differ by powers of two, so nested floors agree exactly.)
    """
    p_lat, p_lon = F.col(lat), F.col(lon)
    boxes = points.filter(_finite(p_lat, p_lon)).select(
        *key, p_lat.alias("p_lat"), p_lon.alias("p_lon"), (p_lat - half).alias("lo_la"), (p_lat + half).alias("hi_la"),
        (p_lon - half).alias("lo_lo"), (p_lon + half).alias("hi_lo"))
    box = [*key, "p_lat", "p_lon", "lo_la", "hi_la", "lo_lo", "hi_lo"]
    axes = {"cy": ("lo_la", "hi_la"), "cx": ("lo_lo", "hi_lo")}
    whole, tested = [], []
    probes = boxes
    for c, (lo, hi) in axes.items():
        probes = probes.withColumn(c, F.explode(F.sequence(_cell(F.col(lo), edges[0]), _cell(F.col(hi), edges[0]))))
    for r, edge in enumerate(edges):
        level = cells.filter(F.col("level") == r).drop("level")
        # dealt by the box once; all three uses below read that exchange again
        met = probes.join(level, ["cy", "cx"]).repartition("p_lat", "p_lon")
        inside = reduce(and_, [(F.col(c) > _cell(F.col(lo), edge)) & (F.col(c) < _cell(F.col(hi), edge)) for c, (lo, hi) in axes.items()])
        last = r == len(edges) - 1
        full = F.lit(False) if last else F.col("coords") > light
        whole.append(met.filter(inside).select(*key, "p_lat", "p_lon", *values))
        tested.append(met.filter(~inside & ~full).select(*box, F.lit(r).alias("level"), "cy", "cx"))
        if not last:
            n = round(edge / edges[r + 1])
            probes = met.filter(~inside & full).select(*box, "cy", "cx")
            for c, (lo, hi) in axes.items():
                first = F.greatest(F.col(c) * n, _cell(F.col(lo), edges[r + 1]))
                probes = probes.withColumn(c, F.explode(F.sequence(first, F.least(F.col(c) * n + (n - 1), _cell(F.col(hi), edges[r + 1])))))
    return reduce(DataFrame.unionByName, whole), reduce(DataFrame.unionByName, tested)


def box_matches(points: DataFrame, incidents: DataFrame, key: list[str], lat: str = "lat", lon: str = "lon",
                with_type: bool = False, half: float = BOX_HALF, edges: tuple[float, ...] = EDGES,
                light: int = LIGHT) -> DataFrame:
    """(point key, p_lat, p_lon, cnt[, hist]): sums of incidents that together are those in each point's inclusive box,
    of whole cells inside it and of single coordinates in cells on its border."""
    values = ["cnt", "hist"] if with_type else ["cnt"]
    # read by every level: added up once, not from the incidents each time
    placed, cells = cell_index(written(coordinate_counts(incidents, with_type), "coordinates"), with_type, edges)
    whole, tested = _parts(points, cells, key, lat, lon, half, edges, light, values)
    # shuffled: a coordinate's file is small beside its histograms on every level
    exact = tested.join(placed.hint("merge"), ["level", "cy", "cx"]).filter(
        F.col("i_lat").between(F.col("lo_la"), F.col("hi_la")) & F.col("i_lon").between(F.col("lo_lo"), F.col("hi_lo")))
    return whole.unionByName(exact.select(*key, "p_lat", "p_lon", *values))


def _distinct_coords(points: DataFrame, lat: str, lon: str) -> DataFrame:
    """Distinct query coordinates (the heavy matching runs once per coordinate, not per point), written: every level reads
    them."""
    return written(points.select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).distinct(), "query-coordinates")


def _back_to_points(points: DataFrame, per_coord: DataFrame, key: list[str], lat: str, lon: str, how: str) -> DataFrame:
    """Attach per-coordinate results to every point with those coordinates (equi-join on lat, lon)."""
    p = points.select(*key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
    return p.join(per_coord, ["_lat", "_lon"], how)


def incidents_near_point(points: DataFrame, incidents: DataFrame, key: str = "point_id", lat: str = "lat",
                         lon: str = "lon") -> DataFrame:
    """Number of incidents with lat and lon within +-0.002 (inclusive) of each point (0 if none).

    The box join runs once per distinct coordinate and the counts are joined back, so repeated query points cost one
    match. A point with a null, NaN or infinite coordinate has 0; such incidents are in no box.
    """
    m = box_matches(_distinct_coords(points, lat, lon), incidents, ["_lat", "_lon"], "_lat", "_lon")
    per = m.groupBy("_lat", "_lon").agg(F.sum("cnt").alias("n"))
    out = _back_to_points(points, per, [key], lat, lon, "left")
    return out.select(key, F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n_incidents"))


def _mode_per(m: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms added up per point and type; then the total and the most frequent type."""
    per_type = m.select(*keys, F.explode("hist").alias("h")).groupBy(*keys, F.col("h.type").alias("crm_cd_desc")).agg(F.sum("h.n").alias("cnt"))
    # most frequent first, then alphabetical: the minimum of (-count, type); null types never win
    order = F.when(F.col("crm_cd_desc").isNotNull(), F.struct((-F.col("cnt")).alias("n"), F.col("crm_cd_desc").alias("c")))
    return per_type.groupBy(*keys).agg(
        F.sum("cnt").cast("bigint").alias("n_incidents"), F.min_by("crm_cd_desc", order).alias("top_crime")
    )


def mode_near_point(points: DataFrame, incidents: DataFrame, key: list[str] | str = "point_id",
                    carry_coords: bool = False, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Per point with nearby incidents: count and most frequent non-null type (ties -> alphabetically first).

    Cells inside a box hand on their histograms of types (as many pairs as there are types), not coordinates, and
    histograms add up per point. With ``carry_coords`` the point's lat/lon are returned too. Matching runs once per
    distinct coordinate.
    """
    key = [key] if isinstance(key, str) else key
    m = box_matches(_distinct_coords(points, lat, lon), incidents, ["_lat", "_lon"], "_lat", "_lon", with_type=True)
    per = _mode_per(m, ["_lat", "_lon"])
    out = _back_to_points(points, per, key, lat, lon, "inner")
    cols = key + ([F.col("_lat").alias("lat"), F.col("_lon").alias("lon")] if carry_coords else [])
    return out.select(*cols, "n_incidents", "top_crime")


# ---------------------------------------------------------------- J4 recent years
def recent_years(df: DataFrame, span: int = 1) -> DataFrame:
    """Rows whose year is at least max(year) - span.

    The maximum is computed first as a literal so the filter can prune
    year partitions of the curated table.
    """
    mx = df.agg(F.max("year")).first()[0]
    if mx is None:
        return df.limit(0)
    return df.filter(F.col("year") >= F.lit(int(mx) - span))


# ---------------------------------------------------------------- R6 historical route risk
def route_risk_historical(routes: DataFrame, incidents: DataFrame, every: int = vocab.HIST_PATH_EVERY,
                          min_count: int = vocab.HIST_MIN_COUNT) -> DataFrame:
    """Every 10th path point with more than 5 recent incidents in its box, with the most frequent type."""
    # positions 0, every, 2*every, ... read directly (no explode of the whole path)
    n = F.floor((F.size("path") + (every - 1)) / every).cast("int")
    picked = F.transform(F.sequence(F.lit(0), n - 1),
                         lambda k: F.struct((k * every).alias("idx"), F.element_at("path", k * every + 1).alias("pt")))
    pts = routes.select("trip_id", "route_seq", F.explode(F.when(n > 0, picked)).alias("e")).select(
        "trip_id", "route_seq", F.col("e.idx").alias("idx"), F.col("e.pt.lat").alias("lat"), F.col("e.pt.lon").alias("lon"))
    key = ["trip_id", "route_seq", "idx"]
    out = mode_near_point(pts, recent_years(incidents), key, carry_coords=True).filter(F.col("n_incidents") > min_count)
    label = text.translate_crime(F.col("top_crime"))
    return out.select(
        *key, "lat", "lon",
        F.col("n_incidents").alias("count"),
        label.alias("crime_type"),
        F.lit(1).alias("intensity"),
    )
