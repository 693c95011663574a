"""Route-risk analytics over trip and route tables.

R1 grid expansion, R2 dangerous zones, R3/J5 threat score, R4 detour
waypoints, U1 route union, R5 de-duplication, R7 path sampling, R8 scored
route risk, R9 ranking, R10 danger level, R11 safety rating, R12 route facts,
R13 danger percent.

Scoring is pluggable: a *scorer* is a function ``DataFrame -> DataFrame`` that
receives rows with ``lat, lon, year, month, day_of_week, hour, age, sex`` and
adds ``prediction, confidence, severity, severity_confidence`` - the trained
classifiers (:func:`urbanlens.operators.models.model_scorer`) in production, a
deterministic fixture for exact oracle checks. All grid points of all trips
are scored in one distributed pass, and so are all sampled route points.

Everything is keyed by ``trip_id``; per-trip groups are bounded by the
request (at most 100 grid cells, 10 detour candidates, the router's
alternatives plus 4 detours), so per-trip folds and windows never hold more
than a handful of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanlens.functions import calendar, coords, text, vocab
from urbanlens.session import spread

Scorer = Callable[[DataFrame], DataFrame]


def _sq(c):
    return c * c


def _trip_context(trips: DataFrame) -> DataFrame:
    """Request calendar (P23) and traveller profile used for every prediction of a trip."""
    return trips.select(
        "trip_id",
        F.year("travel_date").alias("year"),
        F.month("travel_date").alias("month"),
        calendar.weekday_monday0(F.col("travel_date")).alias("day_of_week"),
        F.col("travel_hour").alias("hour"),
        "age",
        "sex",
    )


# ---------------------------------------------------------------- R1
def trip_grid(trips: DataFrame) -> DataFrame:
    """Scan grid per trip (10/8/6 cells a side by straight-line distance) over the trip box
    widened by 20 % and clamped to the city; trips with an end outside the city get none."""
    lat1, lon1, lat2, lon2 = (F.col(c) for c in ("lat1", "lon1", "lat2", "lon2"))
    ok = coords.in_city_box(lat1, lon1) & coords.in_city_box(lat2, lon2)
    dist = F.sqrt(_sq(lat2 - lat1) + _sq(lon2 - lon1))
    grid = (
        F.when(dist > vocab.GRID_LONG_DIST, vocab.GRID_LONG)
        .when(dist > vocab.GRID_MEDIUM_DIST, vocab.GRID_MEDIUM)
        .otherwise(vocab.GRID_SHORT)
    )
    m = F.lit(vocab.GRID_MARGIN)
    box = trips.filter(ok).select(
        "trip_id",
        grid.alias("grid"),
        F.greatest(F.lit(vocab.CITY_LAT_MIN), F.least(lat1, lat2) - F.abs(lat2 - lat1) * m).alias("min_lat"),
        F.least(F.lit(vocab.CITY_LAT_MAX), F.greatest(lat1, lat2) + F.abs(lat2 - lat1) * m).alias("max_lat"),
        F.greatest(F.lit(vocab.CITY_LON_MIN), F.least(lon1, lon2) - F.abs(lon2 - lon1) * m).alias("min_lon"),
        F.least(F.lit(vocab.CITY_LON_MAX), F.greatest(lon1, lon2) + F.abs(lon2 - lon1) * m).alias("max_lon"),
    )
    cells = F.sequence(F.lit(0), F.col("grid") - 1)
    g = box.withColumn("i", F.explode(cells)).withColumn("j", F.explode(cells))
    return g.select(
        "trip_id",
        F.col("i").cast("int").alias("i"),
        F.col("j").cast("int").alias("j"),
        (F.col("min_lat") + F.col("i") * ((F.col("max_lat") - F.col("min_lat")) / F.col("grid"))).alias("lat"),
        (F.col("min_lon") + F.col("j") * ((F.col("max_lon") - F.col("min_lon")) / F.col("grid"))).alias("lon"),
    )


# ---------------------------------------------------------------- R2
def danger_zones(trips: DataFrame, scorer: Scorer) -> DataFrame:
    """R2: grid points predicted PELIGROSO with severity confidence > 0.55; type label cut to 40 chars."""
    dealt = spread(trips, "trip_id")  # a trip is one small row and up to 100 points to score
    pts = trip_grid(dealt).join(_trip_context(trips).hint("merge"), "trip_id")
    scored = scorer(pts)
    return scored.filter(
        (F.col("severity") == vocab.SEVERITY_DANGEROUS) & (F.col("severity_confidence") > vocab.DANGER_CONF_MIN)
    ).select(
        "trip_id", "i", "j", "lat", "lon",
        F.col("severity_confidence").alias("severity_conf"),
        text.cut_text(text.translate_crime(F.col("prediction")), 40, ellipsis=False).alias("crime_type"),
    )


# ---------------------------------------------------------------- R3 / J5
def zone_lists(zones: DataFrame) -> DataFrame:
    """Zones of each trip as one array in scan order (i, j) - at most 100 per trip."""
    return spread(zones, "trip_id").groupBy("trip_id").agg(
        F.sort_array(F.collect_list(F.struct("i", "j", F.col("lat").alias("zlat"), F.col("lon").alias("zlon"),
                                             F.col("severity_conf").alias("conf")))).alias("zones")
    )


def threat_expr(wlat: F.Column, wlon: F.Column, zones: F.Column) -> F.Column:
    """Sum over zones of ((conf - 0.65) / 0.35 * 10) / max(d, 1e-4)^1.5, d Euclidean in degrees; 0 without zones.

    Summed in scan order, like the sequential loop. Values below zero are kept.
    """
    def term(z):
        d = F.sqrt(_sq(wlat - z["zlat"]) + _sq(wlon - z["zlon"]))
        d = F.when(d < F.lit(vocab.THREAT_MIN_DIST), F.lit(vocab.THREAT_MIN_DIST)).otherwise(d)
        sev = (z["conf"] - F.lit(vocab.THREAT_CONF_CENTER)) / F.lit(vocab.THREAT_CONF_SPAN)
        return (sev * 10) / F.pow(d, F.lit(1.5))

    return F.coalesce(F.aggregate(zones, F.lit(0.0), lambda acc, z: acc + term(z)), F.lit(0.0))


def threat_score(points: DataFrame, zones: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """J5 + R3: threat of arbitrary points of a trip against that trip's zones (equi-join on trip_id)."""
    zl = zone_lists(zones)
    j = points.join(zl, "trip_id", "left")
    return j.withColumn("threat", threat_expr(F.col(lat), F.col(lon), F.col("zones"))).drop("zones")


# ---------------------------------------------------------------- R4
def _candidate_array(lat1, lon1, lat2, lon2) -> F.Column:
    """The ten detour candidates of a trip as an array of (cand_idx, wp_lat, wp_lon)."""
    dist = F.sqrt(_sq(lat2 - lat1) + _sq(lon2 - lon1))
    mid_lat, mid_lon = (lat1 + lat2) / 2, (lon1 + lon2) / 2
    perp_dx, perp_dy = -((lon2 - lon1) / dist), (lat2 - lat1) / dist
    out = []
    for si, side in enumerate(vocab.DETOUR_SIDES):
        for di, dev in enumerate(vocab.DETOUR_DEVIATIONS):
            offset = dist * F.lit(dev)
            out.append(F.struct(
                F.lit(si * len(vocab.DETOUR_DEVIATIONS) + di).alias("cand_idx"),
                (mid_lat + perp_dx * offset * F.lit(side)).alias("wp_lat"),
                (mid_lon + perp_dy * offset * F.lit(side)).alias("wp_lon"),
            ))
    return F.when(dist > 0, F.array(*out))


def detour_candidates(trips: DataFrame) -> DataFrame:
    """Ten candidate waypoints per trip: both sides of the midpoint, 10 % .. 30 % of the trip length
    along the perpendicular. ``cand_idx`` = side index * 5 + deviation index. None for zero-length trips."""
    arr = _candidate_array(*(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")))
    return trips.select("trip_id", F.explode(arr).alias("c")).select("trip_id", "c.cand_idx", "c.wp_lat", "c.wp_lon")


def detour_waypoints(trips: DataFrame, routes: DataFrame, zones: DataFrame, keep: int = vocab.DETOUR_KEEP) -> DataFrame:
    """The ``keep`` least threatening candidates (ties keep candidate order), only for trips with
    zones, fewer than 6 direct routes and a non-zero length.

    Candidates are scored and ranked inside each trip's row (array sort), so
    ranking needs no window and no shuffle beyond the per-trip zone lists.
    """
    n_direct = routes.filter(F.col("kind") == "direct").groupBy("trip_id").agg(F.count(F.lit(1)).alias("n_direct"))
    eligible = trips.join(zone_lists(zones), "trip_id").join(n_direct, "trip_id", "left").filter(
        F.coalesce(F.col("n_direct"), F.lit(0)) < vocab.MAX_ROUTES
    )
    cands = _candidate_array(*(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")))
    scored = F.transform(cands, lambda c: F.struct(
        threat_expr(c["wp_lat"], c["wp_lon"], F.col("zones")).alias("threat"),
        c["cand_idx"].alias("cand_idx"), c["wp_lat"].alias("wp_lat"), c["wp_lon"].alias("wp_lon"),
    ))
    best = F.slice(F.array_sort(scored), 1, keep)
    return eligible.select("trip_id", F.posexplode(best).alias("pos", "w")).select(
        "trip_id", F.col("w.cand_idx").alias("cand_idx"), F.col("w.wp_lat").alias("wp_lat"), F.col("w.wp_lon").alias("wp_lon"),
        F.col("w.threat").alias("threat"), (F.col("pos") + 1).cast("int").alias("rank"),
    )


# ---------------------------------------------------------------- U1 / R5
def route_candidates(routes: DataFrame, best: DataFrame) -> DataFrame:
    """Direct routes and the first route of each chosen detour, with order keys (o1, o2):
    direct routes in router order first, then detours in threat order."""
    direct = routes.filter(F.col("kind") == "direct").select(
        "trip_id", "route_seq", "kind", "distance", "duration", F.lit(0).alias("o1"), F.col("route_seq").alias("o2")
    )
    first = F.row_number().over(Window.partitionBy("trip_id", "cand_idx").orderBy("route_seq"))
    detours = routes.filter(F.col("kind") == "waypoint").withColumn("_first", first).filter("_first = 1").drop("_first")
    det = detours.join(best.select("trip_id", "cand_idx", "rank"), ["trip_id", "cand_idx"]).select(
        "trip_id", "route_seq", "kind", "distance", "duration", F.lit(1).alias("o1"), F.col("rank").alias("o2")
    )
    return direct.unionByName(det)


def route_union(routes: DataFrame, best: DataFrame) -> DataFrame:
    """The candidate list with ``ord``, the position in it."""
    w = Window.partitionBy("trip_id").orderBy("o1", "o2")
    return route_candidates(routes, best).withColumn("ord", (F.row_number().over(w) - 1).cast("int")).drop("o1", "o2")


def dedup_routes(candidates: DataFrame, order_cols: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Walk each trip's candidate list in order; direct routes are always taken, a detour is
    taken only while fewer than 6 routes are accepted and no accepted route is within 100 m of its
    distance (a missing distance counts as 0). ``route_id`` is the position among accepted routes.

    One aggregation per trip (at most router alternatives + 4 rows); the route
    fields travel through the fold, so no join back is needed.
    """
    item = F.struct(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(order_cols)],
        F.col("route_seq").cast("int").alias("route_seq"), F.col("kind").cast("string").alias("kind"),
        F.coalesce(F.col("distance").cast("double"), F.lit(0.0)).alias("dist"),
        F.col("distance").cast("double").alias("distance"), F.col("duration").cast("double").alias("duration"),
    )
    per_trip = candidates.groupBy("trip_id").agg(F.sort_array(F.collect_list(item)).alias("c"))
    acc_type = "array<struct<route_seq:int,kind:string,dist:double,distance:double,duration:double>>"
    empty = F.array().cast(acc_type)

    def step(acc, r):
        dup = F.exists(acc, lambda a: F.abs(r["dist"] - a["dist"]) < F.lit(vocab.DUPLICATE_METERS))
        take = (r["kind"] == "direct") | ((F.size(acc) < vocab.MAX_ROUTES) & ~dup)
        row = F.struct(r["route_seq"].alias("route_seq"), r["kind"].alias("kind"), r["dist"].alias("dist"),
                       r["distance"].alias("distance"), r["duration"].alias("duration"))
        return F.when(take, F.concat(acc, F.array(row))).otherwise(acc)

    kept = per_trip.select("trip_id", F.aggregate("c", empty, step).alias("kept"))
    return kept.select("trip_id", F.posexplode("kept").alias("route_id", "r")).select(
        "trip_id", F.col("route_id").cast("int").alias("route_id"), F.col("r.route_seq").alias("route_seq"),
        F.col("r.kind").alias("kind"), F.col("r.distance").alias("distance"), F.col("r.duration").alias("duration"),
    )


# ---------------------------------------------------------------- R7
def sample_path(path: F.Column, every: int = vocab.PATH_EVERY, cap: int = vocab.PATH_MAX_POINTS) -> F.Column:
    """Every 20th point; if more than 15 remain, every (n // 15)-th of those, first 15.

    The kept positions are computed arithmetically (at most 15 of them) and read
    with ``element_at``, so the cost does not grow with the path length.
    """
    m = F.floor((F.size(path) + (every - 1)) / every).cast("int")  # points at every 20th position
    step = F.when(m > cap, F.floor(m / cap)).otherwise(F.lit(1)).cast("int")
    count = F.when(m > cap, F.least(F.lit(cap), F.floor((m + step - 1) / step).cast("int"))).otherwise(m)
    picked = F.transform(F.sequence(F.lit(0), count - 1), lambda t: F.element_at(path, t * step * every + 1))
    return F.when(count > 0, picked).otherwise(F.slice(path, 1, 0))


def path_samples(routes: DataFrame) -> DataFrame:
    """Sampled points of each route as rows (narrow: no shuffle of the path arrays)."""
    return routes.select("trip_id", "route_seq", F.posexplode(sample_path(F.col("path"))).alias("sample_idx", "pt")).select(
        "trip_id", "route_seq", F.col("sample_idx").cast("int").alias("sample_idx"),
        F.col("pt.lat").alias("lat"), F.col("pt.lon").alias("lon"),
    )


# ---------------------------------------------------------------- R8
def route_risk_scored(accepted: DataFrame, routes: DataFrame, trips: DataFrame, scorer: Scorer) -> DataFrame:
    """Risk points of accepted routes: sampled points predicted PELIGROSO with severity
    confidence > 0.55 and type confidence > 0.20, with intensity, score and description.

    Paths are cut to their samples where they are read (at most 15 points a route), joined as arrays to the few accepted
    routes, and only those become rows.
    """
    sampled = routes.select("trip_id", "route_seq", sample_path(F.col("path")).alias("points"))
    kept = accepted.select("trip_id", "route_seq", "route_id").join(sampled, ["trip_id", "route_seq"])
    pts = kept.join(_trip_context(trips), "trip_id").select("*", F.posexplode("points").alias("sample_idx", "pt")).select(
        "*", F.col("pt.lat").alias("lat"), F.col("pt.lon").alias("lon")).drop("points", "pt")
    sc = scorer(pts)
    risky = sc.filter(
        (F.col("severity") == vocab.SEVERITY_DANGEROUS)
        & (F.col("severity_confidence") > vocab.DANGER_CONF_MIN)
        & (F.col("confidence") > vocab.RISK_CONF_MIN)
    )
    label = text.translate_crime(F.col("prediction"))
    pct = text.fixed(F.col("confidence") * 100, 0)
    return risky.select(
        "trip_id", "route_id", "route_seq", "sample_idx", "lat", "lon",
        (F.col("confidence") * 100).cast("int").alias("count"),
        F.when(F.col("severity_confidence") > vocab.INTENSITY_HIGH, 2)
        .when(F.col("severity_confidence") > vocab.INTENSITY_MID, 1)
        .otherwise(0).alias("intensity"),
        F.col("severity_confidence").alias("severity_conf"),
        text.fill(vocab.RISK_DESCRIPTION, crime=label, pct=pct).alias("description"),
        text.cut_text(label, 40, ellipsis=False).alias("crime_type"),
    )


# ---------------------------------------------------------------- R9-R13
def route_risk_counts(accepted: DataFrame, risks: DataFrame) -> DataFrame:
    """Risk points per accepted route (0 when none)."""
    n = risks.groupBy("trip_id", "route_id").agg(F.count(F.lit(1)).alias("n_risks"))
    return accepted.join(n, ["trip_id", "route_id"], "left").withColumn("n_risks", F.coalesce("n_risks", F.lit(0)).cast("bigint"))


def rank_routes(counted: DataFrame) -> DataFrame:
    """Order within a trip: fewest risk points, then shortest duration (missing = infinite), then route id."""
    w = Window.partitionBy("trip_id").orderBy(
        F.col("n_risks").asc(), F.coalesce(F.col("duration"), F.lit(float("inf"))).asc(), F.col("route_id").asc()
    )
    return counted.withColumn("rank", F.row_number().over(w).cast("int"))


def best_route(counted: DataFrame) -> DataFrame:
    """The recommended route of each trip (fewest risk points, then shortest duration with
    missing = infinite, then route id) and the number of routes analysed - one aggregation."""
    key = F.struct(
        F.col("n_risks").alias("n"), F.coalesce(F.col("duration"), F.lit(float("inf"))).alias("d"), F.col("route_id").alias("r")
    )
    agg = counted.groupBy("trip_id").agg(F.min(key).alias("b"), F.count(F.lit(1)).alias("n_routes"))
    return agg.select("trip_id", F.col("b.r").alias("best_route_id"), F.col("b.n").alias("best_n_risks"), "n_routes")


def route_danger_level(ranked: DataFrame) -> DataFrame:
    """(risks - min) / range per trip (range 1 when flat) and its colour class; the best route has its own."""
    w = Window.partitionBy("trip_id")
    mn, mx = F.min("n_risks").over(w), F.max("n_risks").over(w)
    rng = F.when(mx > mn, mx - mn).otherwise(F.lit(1))
    lvl = (F.col("n_risks") - mn) / rng
    cls = (
        F.when(F.col("rank") == 1, F.lit("best"))
        .when(lvl < 0.33, F.lit("low"))
        .when(lvl < 0.66, F.lit("medium"))
        .otherwise(F.lit("high"))
    )
    return ranked.select("trip_id", "route_id", "n_risks", F.round(lvl, 6).alias("danger_level"), cls.alias("danger_class"))


def safety_rating(best: DataFrame) -> DataFrame:
    """Wording for the recommended route by its number of risk points."""
    c = F.col("best_n_risks")
    expr = None
    for limit, label in vocab.SAFETY_RATINGS:
        expr = F.when(c <= limit, F.lit(label)) if expr is None else expr.when(c <= limit, F.lit(label))
    return best.select("trip_id", "best_route_id", "best_n_risks", expr.otherwise(F.lit(vocab.SAFETY_WORST)).alias("rating"))


def route_facts(accepted: DataFrame) -> DataFrame:
    """Kilometres, whole minutes (missing duration = 0), duration text and routes per trip."""
    minutes = F.floor(F.coalesce(F.col("duration"), F.lit(0.0)) / 60).cast("int")
    return accepted.select(
        "trip_id", "route_id",
        F.round(F.coalesce(F.col("distance"), F.lit(0.0)) / 1000, 6).alias("distance_km"),
        minutes.alias("duration_min"),
        text.duration_text(minutes).alias("time_text"),
        F.count(F.lit(1)).over(Window.partitionBy("trip_id")).alias("n_routes"),
    )


def route_danger_percent(counted: DataFrame) -> DataFrame:
    """Risk points as a percentage of the trip's worst route (0 when all are clean)."""
    mx = F.max("n_risks").over(Window.partitionBy("trip_id"))
    pct = F.when(mx > 0, F.col("n_risks") / mx * 100).otherwise(F.lit(0.0))
    return counted.select("trip_id", "route_id", "n_risks", F.round(pct, 6).alias("danger_pct"))


# ---------------------------------------------------------------- whole job
def _cut(df: DataFrame, materialize: bool) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder: later steps read the small result
    instead of re-deriving it, and a lost executor does not send them back to the inputs."""
    if not materialize:
        return df
    from urbanlens.session import shared_dir

    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def analyze_routes(trips: DataFrame, routes: DataFrame, scorer: Scorer, materialize: bool = True) -> dict[str, DataFrame]:
    """Safe-route job for a table of trips: zones, detours, accepted routes, risk points and ranking.

    Zones (at most 100 per trip) and accepted routes (at most 10 per trip) are
    each used by several later steps; they are checkpointed once.
    """
    zones = _cut(danger_zones(trips, scorer), materialize)
    best_wp = detour_waypoints(trips, routes, zones)
    accepted = _cut(dedup_routes(route_candidates(routes, best_wp), ("o1", "o2")), materialize)
    risks = route_risk_scored(accepted, routes, trips, scorer)
    counted = route_risk_counts(accepted, risks)
    return {
        "zones": zones,
        "waypoints": best_wp,
        "accepted": accepted,
        "risks": risks,
        "ranked": rank_routes(counted),
        "best": best_route(counted),
    }
