"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each entry builds its stand-in inputs from the test tables with
:mod:`urbanlens.sources.fixtures` and runs the library operator on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanlens.functions import calendar, coords, text
from urbanlens.operators import clean as C
from urbanlens.operators import dashboard as D
from urbanlens.operators import features as FE
from urbanlens.operators import history as H
from urbanlens.operators import models as M
from urbanlens.operators import explore as E
from urbanlens.operators import geo as G
from urbanlens.operators import questions as Q
from urbanlens.operators import routes as R
from urbanlens.session import fresh_dir
from urbanlens.sources import fixtures as X
from urbanlens.sources import history as HS
from urbanlens.sources import incidents as I
from urbanlens.sources import places as P
from urbanlens.sources import routes as RS
from urbanlens.streaming import predictions as ST
from urbanlens.streaming import questions as SQ

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


_INPUTS: dict = {}


def stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A stand-in input table written once per application and scale directory to the shared
    folder, then read back like any stored input (so jobs never re-derive their inputs)."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _INPUTS:
        path = fresh_dir(spark, f"input-{name}")
        build(spark, sf).write.mode("overwrite").parquet(path)
        _INPUTS[key] = path
    return spark.read.parquet(_INPUTS[key])


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "incidents_raw", X.incidents_raw)


def trips(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "trips", X.trips)


def routes(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "routes", X.routes)


def points(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "points", X.points)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "questions", X.questions)


_CURATED: dict = {}


def clean(spark: SparkSession, sf: str) -> DataFrame:
    """The curated incident table: cleaned once per application and scale directory, written
    year-partitioned to the shared folder (S4), then read back (S2) with pruning and pushdown."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CURATED:
        path = fresh_dir(spark, "curated-incidents")
        I.write_curated(C.clean_incidents(raw(spark, sf)), path)
        _CURATED[key] = path
    return I.load_incidents(spark, curated_path=_CURATED[key])


# ---------------------------------------------------------------- S1-S4
@query("scan_incidents")
def q_scan_incidents(spark, sf):
    """Raw rows written as a header CSV (published header names), scanned back without inference."""
    path = fresh_dir(spark, "incidents-csv")
    I.write_incident_csv(raw(spark, sf), path)
    return I.read_incident_csv(spark, path)


@query("rename_aliases")
def q_rename_aliases(spark, sf):
    """S3: columns presented under the CSV header names are renamed to canonical names."""
    r = raw(spark, sf)
    shown = r.select(*[F.col(c).alias(I.CSV_HEADERS[c]) for c in r.columns])
    return I.conform_raw(shown)


@query("drop_columns")
def q_drop_columns(spark, sf):
    """Unused published columns present in the input are dropped."""
    r = raw(spark, sf).withColumns({"Status": F.lit("IC"), "Cross Street": F.lit(None).cast("string"), "Mocodes": F.lit("0416")})
    return C.drop_columns(r)


@query("load_incidents")
def q_load_incidents(spark, sf):
    """No curated table at the given path -> raw rows are cleaned."""
    return I.load_incidents(spark, curated_path=fresh_dir(spark, "absent"), raw=raw(spark, sf))


@query("load_incidents_light")
def q_load_incidents_light(spark, sf):
    """S2 fallback without a curated table: light preprocessing of the raw rows (bad dates kept as null)."""
    return I.load_incidents(spark, curated_path=fresh_dir(spark, "absent"), raw=raw(spark, sf), level="light")


@query("answer_questions_light")
def q_answer_questions_light(spark, sf):
    """Q1-Q3 answered from the light fallback table, as the question service does without a curated table."""
    return Q.answer_questions(questions(spark, sf), I.load_incidents(spark, raw=raw(spark, sf), level="light"))


@query("clean_incidents")
def q_clean_incidents(spark, sf):
    """Full cleaning job (P1-P8) from the raw rows."""
    return C.clean_incidents(raw(spark, sf))


@query("curated_roundtrip")
def q_curated_roundtrip(spark, sf):
    """S4 + S2: the cleaned table written partitioned by year and loaded back as the curated source."""
    path = fresh_dir(spark, "curated")
    I.write_curated(C.clean_incidents(raw(spark, sf)), path)
    return I.load_incidents(spark, curated_path=path)


# ---------------------------------------------------------------- P2-P13
@query("parse_dates")
def q_parse_dates(spark, sf):
    return C.parse_dates(raw(spark, sf)).select("dr_no", "date_occ")


@query("calendar_fields")
def q_calendar_fields(spark, sf):
    return C.calendar_fields(C.parse_dates(raw(spark, sf))).select("dr_no", "year", "month", "month_num", "day_of_week")


@query("hour_clipped")
def q_hour_clipped(spark, sf):
    return raw(spark, sf).select("dr_no", calendar.hour_clipped(F.col("time_occ")).alias("hour"))


@query("hour_modular")
def q_hour_modular(spark, sf):
    return raw(spark, sf).select("dr_no", calendar.hour_modular(F.col("time_occ")).alias("hour"))


@query("fill_codes")
def q_fill_codes(spark, sf):
    return C.fill_codes(raw(spark, sf)).select("dr_no", "premis_cd", "weapon_used_cd")


@query("coerce_numeric")
def q_coerce_numeric(spark, sf):
    return C.coerce_coordinates(raw(spark, sf)).select("dr_no", "lat", "lon")


@query("rescale_coords")
def q_rescale_coords(spark, sf):
    return C.rescale_coordinates(C.coerce_coordinates(raw(spark, sf))).select("dr_no", "lat", "lon")


@query("valid_coords")
def q_valid_coords(spark, sf):
    return C.valid_coordinates(C.rescale_coordinates(C.coerce_coordinates(raw(spark, sf)))).select("dr_no", "lat", "lon")


@query("nonnull_coords")
def q_nonnull_coords(spark, sf):
    return C.nonnull_coordinates(C.coerce_coordinates(raw(spark, sf))).select("dr_no", "lat", "lon")


@query("encode_sex")
def q_encode_sex(spark, sf):
    return raw(spark, sf).select("dr_no", "vict_sex", text.encode_sex(F.col("vict_sex")).alias("sex_code"))


@query("classify_severity")
def q_classify_severity(spark, sf):
    return raw(spark, sf).select("dr_no", "crm_cd_desc", text.classify_severity(F.col("crm_cd_desc")).alias("severity"))


@query("translate_crime")
def q_translate_crime(spark, sf):
    return raw(spark, sf).select(
        "dr_no",
        text.translate_crime(F.col("crm_cd_desc")).alias("crime_es"),
        text.translate_crime(F.lower("crm_cd_desc")).alias("crime_es_lower"),
        text.translate_crime(F.col("weapon_desc")).alias("weapon_es"),
    )


@query("clean_audit")
def q_clean_audit(spark, sf):
    return C.clean_audit(raw(spark, sf))


# ---------------------------------------------------------------- A1-A11, J1
@query("top_crimes")
def q_top_crimes(spark, sf):
    return E.top_crimes(clean(spark, sf))


@query("monthly_counts")
def q_monthly_counts(spark, sf):
    return E.monthly_counts(clean(spark, sf))


@query("year_month_counts")
def q_year_month_counts(spark, sf):
    return E.year_month_counts(clean(spark, sf))


@query("year_month_pivot")
def q_year_month_pivot(spark, sf):
    return E.year_month_pivot(clean(spark, sf))


@query("top_areas")
def q_top_areas(spark, sf):
    return E.top_areas(clean(spark, sf))


@query("hour_counts")
def q_hour_counts(spark, sf):
    return E.hour_counts(clean(spark, sf))


@query("age_histogram")
def q_age_histogram(spark, sf):
    return E.age_histogram(clean(spark, sf))


@query("age_density")
def q_age_density(spark, sf):
    return E.age_density(clean(spark, sf))


@query("sex_counts")
def q_sex_counts(spark, sf):
    return E.sex_counts(clean(spark, sf))


@query("top_weapons")
def q_top_weapons(spark, sf):
    return E.top_weapons(clean(spark, sf))


@query("area_sex_crosstab")
def q_area_sex_crosstab(spark, sf):
    return E.area_sex_crosstab(clean(spark, sf))


@query("class_imbalance")
def q_class_imbalance(spark, sf):
    return E.class_imbalance(clean(spark, sf))


@query("topn_semi_join")
def q_topn_semi_join(spark, sf):
    return E.topn_semi_join(clean(spark, sf), "crm_cd_desc", 10).select("dr_no", "crm_cd_desc")


# ---------------------------------------------------------------- dashboard P15, A13-A17, L1-L3
# Fixed selection used by the registered dashboard queries.
DASH_YEARS = [1996, 1999, 2001]
DASH_AREAS = ["NATION_1", "NATION_4", "NATION_12", "NATION_20", "NATION_24"]
DASH_LABELS = ["VEHÍCULO ROBADO", "ROBO DE IDENTIDAD", "HURTO MENOR", "ROBO CON VIOLENCIA"]


def dash_selection(spark, sf):
    return D.filter_by_labels(clean(spark, sf), DASH_YEARS, DASH_AREAS, DASH_LABELS)


@query("dashboard_filter")
def q_dashboard_filter(spark, sf):
    return dash_selection(spark, sf).select("dr_no", "year", "area_name", "crm_cd_desc")


@query("dashboard_metrics")
def q_dashboard_metrics(spark, sf):
    return D.dashboard_metrics(dash_selection(spark, sf))


@query("dashboard_metrics_all")
def q_dashboard_metrics_all(spark, sf):
    return D.dashboard_metrics(clean(spark, sf))


@query("dashboard_metrics_light")
def q_dashboard_metrics_light(spark, sf):
    """A13 on the dashboard's fallback table without a curated file: light preprocessing, rows
    without coordinates dropped (zeros and unscaled values stay)."""
    return D.dashboard_metrics(C.light_incidents(raw(spark, sf), drop_missing_coords=True))


@query("distinct_areas")
def q_distinct_areas(spark, sf):
    return D.distinct_values(clean(spark, sf), "area_name")


@query("distinct_years")
def q_distinct_years(spark, sf):
    return D.distinct_values(clean(spark, sf), "year")


@query("crime_options")
def q_crime_options(spark, sf):
    return D.crime_options(clean(spark, sf))


@query("area_centroids")
def q_area_centroids(spark, sf):
    c = D.area_centroids(clean(spark, sf))
    return c.select("area_name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("area_point")
def q_area_point(spark, sf):
    """A17 for every nation name (all have records) and every region name (none has: default point)."""
    req = X.table(spark, sf, "nation").select(F.col("n_name").alias("area")).unionByName(
        X.table(spark, sf, "region").select(F.col("r_name").alias("area"))
    )
    return D.area_point(clean(spark, sf), req)


@query("sample_n")
def q_sample_n(spark, sf):
    return D.sample_n(clean(spark, sf), 1000, "42").select("dr_no", "crm_cd_desc")


@query("heat_points")
def q_heat_points(spark, sf):
    return D.heat_points(dash_selection(spark, sf), 2000, "42")


@query("context_heat_points")
def q_context_heat_points(spark, sf):
    return D.context_heat_points(clean(spark, sf), 1000)


@query("in_city_box")
def q_in_city_box(spark, sf):
    p = points(spark, sf)
    return p.select("point_id", coords.in_city_box(F.col("lat"), F.col("lon")).alias("in_box"))


# ---------------------------------------------------------------- geo J2-J4, A22, R6
@query("nearest_area")
def q_nearest_area(spark, sf):
    cents = D.area_centroids(clean(spark, sf))
    return G.nearest_area(points(spark, sf), cents).select("point_id", "nearest_area")


@query("incidents_near_point")
def q_incidents_near_point(spark, sf):
    return G.incidents_near_point(points(spark, sf), clean(spark, sf))


@query("mode_near_point")
def q_mode_near_point(spark, sf):
    return G.mode_near_point(points(spark, sf), clean(spark, sf))


@query("recent_years")
def q_recent_years(spark, sf):
    return G.recent_years(clean(spark, sf)).select("dr_no", "year")


@query("route_risk_historical")
def q_route_risk_historical(spark, sf):
    return G.route_risk_historical(routes(spark, sf), clean(spark, sf))


# ---------------------------------------------------------------- questions A18-A20, J6, Q1-Q3, P14
def qfeat(spark, sf):
    return Q.question_features(questions(spark, sf))


@query("question_crime")
def q_question_crime(spark, sf):
    return questions(spark, sf).select("question_id", text.question_crime(F.col("text")).alias("crime"))


@query("question_hours")
def q_question_hours(spark, sf):
    return qfeat(spark, sf).filter("has_interval").select("question_id", "start_h", "end_h")


@query("hour_window_count")
def q_hour_window_count(spark, sf):
    return Q.hour_window_count(qfeat(spark, sf), clean(spark, sf))


@query("question_areas")
def q_question_areas(spark, sf):
    f = Q.areas_found(qfeat(spark, sf), clean(spark, sf))
    return f.select("question_id", F.posexplode("found").alias("pos", "a")).select(
        "question_id", F.col("pos").cast("int").alias("pos"), F.col("a.area").alias("area_name"))


@query("compare_areas")
def q_compare_areas(spark, sf):
    f = Q.areas_found(qfeat(spark, sf).filter("is_compare"), clean(spark, sf))
    return Q.compare_areas(f)


@query("yearly_trend")
def q_yearly_trend(spark, sf):
    return Q.yearly_trend(clean(spark, sf)).drop("change_text")


@query("question_intent")
def q_question_intent(spark, sf):
    return Q.answer_questions(questions(spark, sf), clean(spark, sf)).select("question_id", "intent")


@query("answer_questions")
def q_answer_questions(spark, sf):
    return Q.answer_questions(questions(spark, sf), clean(spark, sf))


# ---------------------------------------------------------------- routes R1-R13, U1, J5, P20, P23, S7, L6
def route_job(spark, sf, scorer=None):
    return R.analyze_routes(trips(spark, sf), routes(spark, sf), scorer or X.fixture_scorer)


@query("request_calendar")
def q_request_calendar(spark, sf):
    """Travel date -> year, month, weekday (Monday = 0)."""
    t = trips(spark, sf)
    return t.select("trip_id", F.year("travel_date").alias("year"), F.month("travel_date").alias("month"),
                    calendar.weekday_monday0(F.col("travel_date")).alias("day_of_week"))


@query("scan_routes")
def q_scan_routes(spark, sf):
    """Candidate routes written as JSON lines and read back with an explicit schema."""
    path = fresh_dir(spark, "routes-json")
    RS.write_routes(routes(spark, sf), path)
    r = RS.read_routes(spark, path)
    return r.select("trip_id", "route_seq", "kind", "cand_idx", "distance", "duration",
                    F.size("path").alias("n_points"),
                    F.col("path")[0]["lon"].alias("first_lon"), F.col("path")[0]["lat"].alias("first_lat"),
                    F.element_at("path", -1)["lon"].alias("last_lon"), F.element_at("path", -1)["lat"].alias("last_lat"))


@query("trip_grid")
def q_trip_grid(spark, sf):
    return R.trip_grid(trips(spark, sf))


@query("danger_zones")
def q_danger_zones(spark, sf):
    return route_job(spark, sf)["zones"]


@query("threat_score")
def q_threat_score(spark, sf):
    """J5 + R3: threat of every detour candidate of every trip against the trip's zones (0 without zones)."""
    tr = trips(spark, sf)
    zones = route_job(spark, sf)["zones"]
    cands = R.detour_candidates(tr)
    t = R.threat_score(cands, zones, "wp_lat", "wp_lon")
    return t.select("trip_id", "cand_idx", F.round("wp_lat", 9).alias("wp_lat"), F.round("wp_lon", 9).alias("wp_lon"),
                    F.round("threat", 4).alias("threat"))


@query("detour_waypoints")
def q_detour_waypoints(spark, sf):
    w = route_job(spark, sf)["waypoints"]
    return w.select("trip_id", "cand_idx", F.col("rank").cast("int").alias("rank"), F.round("wp_lat", 9).alias("wp_lat"),
                    F.round("wp_lon", 9).alias("wp_lon"), F.round("threat", 4).alias("threat"))


@query("route_union")
def q_route_union(spark, sf):
    j = route_job(spark, sf)
    return R.route_union(routes(spark, sf), j["waypoints"]).select("trip_id", "ord", "route_seq", "kind")


@query("dedup_routes")
def q_dedup_routes(spark, sf):
    return route_job(spark, sf)["accepted"]


@query("path_sample")
def q_path_sample(spark, sf):
    return R.path_samples(routes(spark, sf))


@query("route_risk_scored")
def q_route_risk_scored(spark, sf):
    return route_job(spark, sf)["risks"]


@query("best_route")
def q_best_route(spark, sf):
    return route_job(spark, sf)["best"]


@query("route_danger_level")
def q_route_danger_level(spark, sf):
    return R.route_danger_level(route_job(spark, sf)["ranked"])


@query("safety_rating")
def q_safety_rating(spark, sf):
    return R.safety_rating(route_job(spark, sf)["best"])


@query("route_facts")
def q_route_facts(spark, sf):
    return R.route_facts(route_job(spark, sf)["accepted"])


@query("route_danger_percent")
def q_route_danger_percent(spark, sf):
    return R.route_danger_percent(route_job(spark, sf)["ranked"])


@query("routes_by_risk")
def q_routes_by_risk(spark, sf):
    """Routes of each trip in ascending risk order (position = rank)."""
    return route_job(spark, sf)["ranked"].select("trip_id", "route_id", "n_risks", "rank")


@query("duration_text")
def q_duration_text(spark, sf):
    """P20 over every candidate route's duration in whole minutes (missing -> 0)."""
    r = routes(spark, sf)
    m = F.floor(F.coalesce(F.col("duration"), F.lit(0.0)) / 60).cast("int")
    return r.select("trip_id", "route_seq", m.alias("minutes"), text.duration_text(m).alias("duration_text"))


# ---------------------------------------------------------------- ML M1-M11, S5, A12, P17, P18
def training(spark, sf):
    return FE.training_frame(clean(spark, sf))


def split_frame(spark, sf):
    return FE.validation_split(FE.stratified_split(training(spark, sf)))


_MODELS: dict = {}


def reset_models() -> None:
    """Forget fitted classifiers."""
    _MODELS.clear()


def fitted(spark, sf) -> M.IncidentModels:
    """The two-headed classifier, fitted once per (application, scale dir) and reused by the scoring queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = M.fit_models(split_frame(spark, sf))
    return _MODELS[key]


def point_requests(spark, sf):
    """One request a point; every 97th lacks the age."""
    p = points(spark, sf)
    return p.select("point_id", "lat", "lon", F.col("date_year").alias("year"), F.col("date_month").alias("month"),
                    "day_of_week", F.col("hour_of_day").alias("hour"),
                    F.when(F.col("point_id") % 97 != 0, F.col("victim_age")).alias("age"), F.col("victim_sex").alias("sex"))


@query("complete_cases")
def q_complete_cases(spark, sf):
    """Rows of the cleaned table with every feature and the target present."""
    c = clean(spark, sf)
    feats = FE.select_features(c)
    return C.complete_cases(c, feats + [FE.TARGET]).select("dr_no")


@query("training_frame")
def q_training_frame(spark, sf):
    """M1 (with P18 feature order, P11 sex code, J1 top-10 filter, P12 severity)."""
    return training(spark, sf)


@query("severity_balance")
def q_severity_balance(spark, sf):
    return E.severity_balance(training(spark, sf))


@query("label_index")
def q_label_index(spark, sf):
    return FE.label_index(training(spark, sf)).select("dr_no", "type_label", "severity_label")


@query("scaled_features")
def q_scaled_features(spark, sf):
    z = FE.scaled_features(training(spark, sf))
    return z.select("dr_no", *[F.round(c, 6).alias(c) for c in z.columns if c != "dr_no"])


@query("stratified_split")
def q_stratified_split(spark, sf):
    return FE.stratified_split(training(spark, sf)).select("dr_no", "split")


@query("stratified_split_exact")
def q_stratified_split_exact(spark, sf):
    """M4 exact: per class the round(20 %) rows with the smallest key hash form the test part. Every seventh row has no key."""
    t = training(spark, sf)
    t = t.withColumn("dr_no", F.when(F.col("dr_no") % 7 != 0, F.col("dr_no")))
    return FE.stratified_split_exact(t).select("dr_no", FE.TARGET, "split")


@query("validation_split")
def q_validation_split(spark, sf):
    return split_frame(spark, sf).select("dr_no", "role")


@query("class_weights")
def q_class_weights(spark, sf):
    return FE.class_weights(FE.stratified_split(training(spark, sf)))


@query("top_k_classes")
def q_top_k_classes(spark, sf):
    """M11 on per-point probability vectors: the three most likely classes (probability desc, index asc)."""
    pr = X.class_probabilities(spark, sf)
    tk = M.top_k(F.col("probability"), X.class_labels())
    e = pr.select("point_id", F.posexplode(tk["top_3"]).alias("pos", "t"))
    return e.select("point_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.crim").alias("crim"),
                    F.col("t.probabilitat").alias("probabilitat"))


def model_facts(spark, m: M.IncidentModels, counts: dict[str, int], index: dict[str, int]) -> DataFrame:
    """What the fitted classifier holds of the whole frame: classes with index and rows, features with mean and deviation."""
    rows = [("class", c, index[c], n, None, None) for c, n in counts.items()]
    rows += [("feature", c, i, None, round(m.stats[c][0], 6), round(m.stats[c][1], 6)) for i, c in enumerate(m.feature_cols)]
    return spark.createDataFrame(rows, "kind string, name string, pos int, n long, mean double, std double")


@query("fit_type_model")
def q_fit_type_model(spark, sf):
    """M7: the fitted classifier's types with their rows, and its scaler, both of the whole training frame."""
    m = fitted(spark, sf)
    return model_facts(spark, m, m.type_counts, {c: i for i, c in enumerate(m.type_labels)})


@query("fit_severity_model")
def q_fit_severity_model(spark, sf):
    """M8: the same of the severity head."""
    m = fitted(spark, sf)
    return model_facts(spark, m, m.severity_counts, {c: i for i, c in enumerate(m.severity_labels)})


@query("model_accuracy")
def q_model_accuracy(spark, sf):
    """M9: accuracy of both heads on the held-out test rows, from the confusion matrix; whether each row's own decoding
    (M11) gives the same."""
    m = fitted(spark, sf)
    test = split_frame(spark, sf).filter(F.col("split") == "test")
    x = test.select(*[F.col(c).cast("double").alias(c) for c in m.feature_cols], FE.TARGET, F.col("severity").alias("actual"))
    scored = M.probabilities(m, x.select(*m.feature_cols).distinct())
    said = {"type": M.top_k(F.col("type_prob"), m.type_labels)["prediction"], "severity": M.top_k(F.col("severity_prob"), m.severity_labels)["prediction"]}
    rows = x.join(scored, m.feature_cols).select((said["type"] == F.col(FE.TARGET)).alias("type"), (said["severity"] == F.col("actual")).alias("severity"))
    right = rows.agg(*[F.avg(F.col(t).cast("double")).alias(t) for t in said]).select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("rows_accuracy")) for t in said])).alias("r")).select("r.*")
    a = M.accuracy(m, test).join(right, "target")
    return a.select("target", "n_test", (F.abs(F.col("accuracy") - F.col("rows_accuracy")) < 1e-12).alias("matches_rows"), F.col("accuracy").between(0, 1).alias("is_share"))


def _judged(scored: DataFrame, m: M.IncidentModels, key: str) -> DataFrame:
    """Whether a request was scored; whether its classes are known; whether its three best are in order and their
    probabilities fit."""
    top, types, levels = F.col("top_3"), F.array(*[F.lit(x) for x in m.type_labels]), F.array(*[F.lit(x) for x in m.severity_labels])
    p = F.transform(top, lambda t: t["probabilitat"])
    known = F.array_contains(types, F.col("prediction")) & F.array_contains(levels, F.col("severity"))
    ordered = (F.reverse(F.array_sort(p)) == p) & (p[0] == F.col("confidence")) & (top[0]["crim"] == F.col("prediction")) & (F.aggregate(p, F.lit(0.0), lambda a, b: a + b) <= 1 + 1e-9)
    return scored.select(key, F.col("prediction").isNotNull().alias("scored"), known.alias("known"), ordered.alias("ordered"))


@query("score_points")
def q_score_points(spark, sf):
    """Every point request scored by both heads in one inference stage; those with a missing field come back null."""
    m = fitted(spark, sf)
    return _judged(M.score(m, point_requests(spark, sf)), m, "point_id")


@query("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """The classifier saved, loaded back, and both scoring every request: whether they agree."""
    path = fresh_dir(spark, "models")
    M.save_models(fitted(spark, sf), path, spark)
    r = point_requests(spark, sf)
    results = ["prediction", "confidence", "top_3", "severity", "severity_confidence"]
    a = M.score(fitted(spark, sf), r).select("point_id", F.struct(*results).alias("a"))
    b = M.score(M.load_models(spark, path), r).select("point_id", F.struct(*results).alias("b"))
    return a.join(b, "point_id").select("point_id", *[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")).alias(f"same_{c}") for c in results])


@query("route_risk_model")
def q_route_risk_model(spark, sf):
    """R2-R9 with the trained classifier as scorer: per trip whether the recommended route is one of those analysed, has
    the fewest risk points of them, and none of the direct routes is missing."""
    job = route_job(spark, sf, M.model_scorer(fitted(spark, sf)))
    direct = routes(spark, sf).filter("kind = 'direct'").groupBy("trip_id").agg(F.count(F.lit(1)).alias("n_direct"))
    least = job["ranked"].groupBy("trip_id").agg(F.min("n_risks").alias("least"), F.count(F.lit(1)).alias("n"))
    b = job["best"].join(least, "trip_id").join(direct, "trip_id")
    return b.select("trip_id", F.col("best_route_id").between(0, F.col("n") - 1).alias("is_route"), (F.col("best_n_risks") == F.col("least")).alias("is_least"),
                    ((F.col("n_routes") == F.col("n")) & (F.col("n") >= F.col("n_direct"))).alias("is_whole"))


# ---------------------------------------------------------------- history S6, L4, L5, P21, P22; places S8, P19
def logged(spark, sf):
    """All requests with a type result from their probabilities (M11) and a severity from the fixture scorer, logged in two
    batches (first half of the month, then the rest)."""
    path = fresh_dir(spark, "prediction-log")
    req = X.logged_requests(spark, sf)
    sc = X.fixture_scorer(req).withColumns(M.top_k(F.col("probability"), X.class_labels()))
    log = HS.entries(sc, F.col("asked_at"))
    HS.append_log(log.filter(F.col("timestamp") < "2024-01-15"), path, "first")
    HS.append_log(log.filter(F.col("timestamp") >= "2024-01-15"), path, "rest")
    return HS.read_log(spark, path)


@query("prediction_log")
def q_prediction_log(spark, sf):
    """Entries appended in two batches and read back with the log schema."""
    g = logged(spark, sf)
    return g.select("log_id", "timestamp", "user_name", "area", F.col("input.lat").alias("in_lat"),
                    F.col("input.hour").alias("in_hour"), F.col("result.prediction").alias("prediction"),
                    F.col("result.confidence").alias("confidence"), F.col("result.severity").alias("severity"),
                    F.col("result.severity_confidence").alias("severity_confidence"), F.size("result.top_3").alias("n_top"))


@query("user_history")
def q_user_history(spark, sf):
    return H.user_history(logged(spark, sf), "user_3")


@query("log_top3")
def q_log_top3(spark, sf):
    return H.log_top3(logged(spark, sf))


@query("cut_text")
def q_cut_text(spark, sf):
    """Answer text cut to 50 characters (+ '...'), predicted label cut to 40."""
    a = Q.answer_questions(questions(spark, sf), clean(spark, sf))
    return a.select("question_id", text.cut_text(F.col("answer"), 50).alias("answer_cut"),
                    text.cut_text(F.col("answer"), 40, ellipsis=False).alias("answer_40"))


@query("latest_routes")
def q_latest_routes(spark, sf):
    """The ten newest route analyses of each user, with their recommended route and zone count."""
    job = route_job(spark, sf)
    zc = job["zones"].groupBy("trip_id").agg(F.count(F.lit(1)).alias("n_zones"))
    t = trips(spark, sf).select("trip_id", "user_name", "requested_at")
    a = t.join(job["best"], "trip_id").join(zc, "trip_id", "left").withColumn("n_zones", F.coalesce("n_zones", F.lit(0)).cast("bigint"))
    return H.latest_routes(a).select("user_name", "trip_id", "best_route_id", "n_zones", F.col("pos").cast("int").alias("pos"))


@query("place_lookup")
def q_place_lookup(spark, sf):
    return P.place_lookup(X.address_requests(spark, sf), X.gazetteer(spark, sf))


@query("address_key")
def q_address_key(spark, sf):
    r = X.address_requests(spark, sf)
    return r.select("request_id", text.address_key(F.col("address")).alias("address_key"),
                    text.search_text(F.col("address")).alias("search_text"))


# ---------------------------------------------------------------- P18, streaming
@query("select_features")
def q_select_features(spark, sf):
    """The model's feature columns, in the saved order, from the curated table."""
    c = clean(spark, sf)
    return c.select("dr_no", *FE.select_features(c))


def _request_files(spark, sf):
    """Point requests written as several parquet files into a fresh drop folder."""
    p = points(spark, sf)
    req = p.select(F.col("point_id").alias("request_id"),
                   F.concat(F.lit("user_"), (F.col("point_id") % 10).cast("string")).alias("user_name"),
                   "area", "lat", "lon", F.col("date_year").cast("int").alias("year"), F.col("date_month").alias("month"),
                   "day_of_week", F.col("hour_of_day").alias("hour"), F.col("victim_age").alias("age"),
                   F.col("victim_sex").alias("sex"))
    src = fresh_dir(spark, "request-drop")
    req.repartition(4).write.parquet(src)
    return src


def _streamed(spark, sf, scorer) -> DataFrame:
    log = fresh_dir(spark, "stream-log")
    ST.run_to_log(ST.request_stream(spark, _request_files(spark, sf), 1), scorer, log)
    return HS.read_log(spark, log)


@query("stream_predictions")
def q_stream_predictions(spark, sf):
    """Streamed requests (one file per micro-batch) scored and added to the prediction log, read back."""
    r = F.col("result")
    return _streamed(spark, sf, X.fixture_scorer).select(
        F.col("log_id").alias("request_id"), "user_name", "area", F.col("input.lat").alias("lat"), F.col("input.lon").alias("lon"), F.col("input.hour").alias("hour"),
        r["prediction"].alias("prediction"), r["confidence"].alias("confidence"), r["severity"].alias("severity"), r["severity_confidence"].alias("severity_confidence"))


@query("stream_predictions_model")
def q_stream_predictions_model(spark, sf):
    """The same stream scored by the trained classifier: whether its log entries are what a batch job gives."""
    m = fitted(spark, sf)
    streamed = _streamed(spark, sf, M.model_scorer(m)).select("log_id", F.struct("input", "result", "user_name", "area").alias("s"))
    batch = HS.entries(M.model_scorer(m)(spark.read.parquet(_request_files(spark, sf)))).select("log_id", F.struct("input", "result", "user_name", "area").alias("b"))
    return streamed.join(batch, "log_id", "full").select(F.col("log_id").alias("request_id"), F.col("s").eqNullSafe(F.col("b")).alias("as_batch"))


@query("stream_answers")
def q_stream_answers(spark, sf):
    """Questions streamed one file per micro-batch and answered from statistics prepared once."""
    src = fresh_dir(spark, "question-drop")
    questions(spark, sf).repartition(4).write.parquet(src)
    sink = fresh_dir(spark, "answers")
    SQ.run_answers(SQ.question_stream(spark, src, 1), Q.Answerer(clean(spark, sf)), sink)
    return spark.read.parquet(sink).select("question_id", "intent", "answer")
