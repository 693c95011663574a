"""DuckDB SQL for every oracle-checkable query.

Each statement rebuilds the stand-in inputs from the pre-registered test
tables (same integer arithmetic as :mod:`urbanlens.sources.fixtures`) and then
computes the query with plain SQL, independently of the Spark code.
"""

from __future__ import annotations

from urbanlens.functions import vocab
from urbanlens.sources.fixtures import FIXTURE_CRIMES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


CRIMES = _list(FIXTURE_CRIMES)


def _coord(k: str, i: str) -> str:
    return (
        f"CASE WHEN {k} % 131 = 0 THEN 'n/a' WHEN {k} % 71 = 0 THEN '0' "
        f"WHEN {k} % 53 = 0 THEN CAST({i} AS VARCHAR) ELSE CAST(CAST({i} AS DOUBLE) / CAST(10000 AS DOUBLE) AS VARCHAR) END"
    )


def _rescale(v: str, limit: int) -> str:
    return (
        f"list_reduce([{v}, 10.0::DOUBLE, 10.0::DOUBLE, 10.0::DOUBLE, 10.0::DOUBLE, 10.0::DOUBLE, 10.0::DOUBLE, 10.0::DOUBLE], "
        f"lambda acc, x: CASE WHEN abs(acc) > {limit} THEN acc / x ELSE acc END)"
    )


def _coerce(v: str) -> str:
    return f"(CASE WHEN isnan(TRY_CAST({v} AS DOUBLE)) OR isinf(TRY_CAST({v} AS DOUBLE)) THEN NULL ELSE TRY_CAST({v} AS DOUBLE) END)"


CTE = {}

CTE["raw"] = f"""raw AS (
  SELECT k AS dr_no,
    CASE WHEN k % 97 = 0 THEN 'not-a-date' WHEN k % 29 = 1 THEN strftime(day, '%Y-%m-%d 00:00') WHEN k % 29 = 2 THEN strftime(day, '%Y-%m-%dT00:00')
      WHEN k % 29 = 3 THEN strftime(day, '%Y%m%d') WHEN k % 29 = 4 THEN month(day) || '/' || day(day) || strftime(day, '/%Y 12:00 AM')
      WHEN k % 29 = 5 THEN strftime(day, '%b ') || day(day) || strftime(day, ', %Y') WHEN k % 29 = 6 THEN strftime(day, '%m/%d/%Y 12:00:00 AM')
      ELSE CAST(day AS VARCHAR) END AS date_occ,
    CASE WHEN k % 97 <> 0 THEN day END AS true_day,
    CAST(CASE WHEN k % 211 = 0 THEN 2400 ELSE ((k * 37) % 24) * 100 + (k * 13) % 60 END AS INTEGER) AS time_occ,
    CASE WHEN k % 101 = 0 THEN NULL ELSE n_name END AS area_name,
    CASE WHEN k % 307 = 0 THEN NULL WHEN k % 401 = 0 THEN '*' ELSE ({CRIMES})[LEAST(k % 15, (k // 15) % 15) + 1] END AS crm_cd_desc,
    CAST((k * 7) % 103 - 3 AS INTEGER) AS vict_age,
    CASE WHEN k % 203 = 0 THEN 'H' WHEN k % 11 <= 4 THEN 'M' WHEN k % 11 <= 8 THEN 'F' WHEN k % 11 = 9 THEN 'X' ELSE NULL END AS vict_sex,
    CASE WHEN k % 19 = 0 THEN NULL ELSE CAST(101 + k % 37 AS DOUBLE) END AS premis_cd,
    CASE WHEN k % 3 <> 0 THEN NULL ELSE CAST(400 + LEAST(k % 17, (k // 17) % 17) AS DOUBLE) END AS weapon_used_cd,
    CASE WHEN k % 3 <> 0 THEN NULL ELSE 'WEAPON ' || CAST(400 + LEAST(k % 17, (k // 17) % 17) AS VARCHAR) END AS weapon_desc,
    {_coord('k', '(337500 + 200 * nk + 2 * (k % 97))')} AS lat,
    {_coord('k', '(-1186500 + 200 * nk + 2 * (k % 89))')} AS lon
  FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, CAST(n_nationkey AS BIGINT) AS nk, n_name
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) src
)"""

CTE["parsed"] = f"""parsed AS (
  SELECT *, true_day AS d,
    {_coerce('lat')} AS lat_num, {_coerce('lon')} AS lon_num
  FROM raw
)"""

CTE["clean"] = f"""clean AS (
  SELECT dr_no, d AS date_occ, time_occ, area_name, crm_cd_desc, vict_age, vict_sex,
    COALESCE(premis_cd, 0) AS premis_cd, COALESCE(weapon_used_cd, 0) AS weapon_used_cd, weapon_desc,
    lat_r AS lat, lon_r AS lon,
    CAST(year(d) AS INTEGER) AS year, strftime(d, '%Y-%m') AS month,
    CAST(month(d) AS INTEGER) AS month_num, CAST(isodow(d) - 1 AS INTEGER) AS day_of_week
  FROM (SELECT *, {_rescale('lat_num', 90)} AS lat_r, {_rescale('lon_num', 180)} AS lon_r FROM parsed) s
  WHERE d IS NOT NULL AND lat_r IS NOT NULL AND lon_r IS NOT NULL AND lat_r <> 0 AND lon_r <> 0
)"""

DEPS = {"raw": [], "parsed": ["raw"], "clean": ["parsed"]}


def register_cte(name: str, body: str, deps: list[str]) -> None:
    CTE[name] = body
    DEPS[name] = deps


def with_(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(CTE[n] for n in order) + "\n"


def top_sql(table: str, key: str, n: int | None, alias: str = "n_incidents", where: str = "") -> str:
    cond = f"WHERE {key} IS NOT NULL" + (f" AND {where}" if where else "")
    lim = f" LIMIT {n}" if n is not None else ""
    return f"SELECT {key}, COUNT(*) AS {alias} FROM {table} {cond} GROUP BY {key} ORDER BY {alias} DESC, {key} ASC{lim}"


SEVERITY_SQL = (
    "CASE WHEN {c} IS NULL THEN 'PELIGROSO' WHEN "
    + " OR ".join(f"contains(upper({{c}}), {_q(w)})" for w in vocab.DANGEROUS_KEYWORDS)
    + " THEN 'PELIGROSO' ELSE 'SEGURO' END"
)


def severity_sql(c: str) -> str:
    return SEVERITY_SQL.replace("{c}", c)


def translate_sql(c: str) -> str:
    exact = " ".join(f"WHEN upper({c}) = {_q(k)} THEN {_q(v)}" for k, v in vocab.CRIME_TRANSLATIONS)
    part = " ".join(f"WHEN contains(upper({c}), {_q(k)}) THEN {_q(v)}" for k, v in vocab.CRIME_TRANSLATIONS)
    return f"(CASE WHEN {c} IS NULL OR {c} = '' THEN {_q(vocab.UNKNOWN_LABEL)} {exact} {part} ELSE {c} END)"


def question_crime_sql(c: str) -> str:
    part = " ".join(f"WHEN contains(lower({c}), {_q(k)}) THEN {_q(v)}" for k, v in vocab.QUESTION_TERMS)
    return f"(CASE {part} ELSE NULL END)"


SQL: dict[str, str] = {}

# ---------------------------------------------------------------- sources / cleaning
RAW_COLS = "dr_no, date_occ, time_occ, area_name, crm_cd_desc, vict_age, vict_sex, premis_cd, weapon_used_cd, weapon_desc, lat, lon"
CLEAN_COLS = RAW_COLS + ", year, month, month_num, day_of_week"

SQL["scan_incidents"] = with_("raw") + f"SELECT {RAW_COLS} FROM raw"
SQL["rename_aliases"] = SQL["scan_incidents"]
SQL["drop_columns"] = SQL["scan_incidents"]
SQL["load_incidents"] = with_("clean") + f"SELECT {CLEAN_COLS} FROM clean"
SQL["curated_roundtrip"] = SQL["load_incidents"]
SQL["clean_incidents"] = SQL["load_incidents"]
SQL["parse_dates"] = with_("parsed") + "SELECT dr_no, d AS date_occ FROM parsed WHERE d IS NOT NULL"
SQL["calendar_fields"] = with_("parsed") + (
    "SELECT dr_no, CAST(year(d) AS INTEGER) AS year, strftime(d, '%Y-%m') AS month, CAST(month(d) AS INTEGER) AS month_num, "
    "CAST(isodow(d) - 1 AS INTEGER) AS day_of_week FROM parsed WHERE d IS NOT NULL"
)
SQL["hour_clipped"] = with_("raw") + (
    "SELECT dr_no, CAST(LEAST(GREATEST(FLOOR(time_occ / 100.0), 0), 23) AS INTEGER) AS hour FROM raw"
)
SQL["hour_modular"] = with_("raw") + (
    "SELECT dr_no, CAST(((FLOOR(time_occ / 100.0) % 24) + 24) % 24 AS INTEGER) AS hour FROM raw"
)
SQL["fill_codes"] = with_("raw") + (
    "SELECT dr_no, COALESCE(premis_cd, 0) AS premis_cd, COALESCE(weapon_used_cd, 0) AS weapon_used_cd FROM raw"
)
SQL["coerce_numeric"] = with_("parsed") + "SELECT dr_no, lat_num AS lat, lon_num AS lon FROM parsed"
SQL["rescale_coords"] = with_("parsed") + (
    f"SELECT dr_no, {_rescale('lat_num', 90)} AS lat, {_rescale('lon_num', 180)} AS lon FROM parsed"
)
SQL["valid_coords"] = with_("parsed") + (
    f"SELECT * FROM (SELECT dr_no, {_rescale('lat_num', 90)} AS lat, {_rescale('lon_num', 180)} AS lon FROM parsed) s "
    "WHERE lat IS NOT NULL AND lon IS NOT NULL AND lat <> 0 AND lon <> 0"
)
SQL["nonnull_coords"] = with_("parsed") + (
    "SELECT dr_no, lat_num AS lat, lon_num AS lon FROM parsed WHERE lat_num IS NOT NULL AND lon_num IS NOT NULL"
)
SQL["encode_sex"] = with_("raw") + (
    "SELECT dr_no, vict_sex, CAST(CASE WHEN vict_sex = 'F' THEN 0 WHEN vict_sex = 'M' THEN 1 ELSE 2 END AS INTEGER) AS sex_code FROM raw"
)
SQL["classify_severity"] = with_("raw") + f"SELECT dr_no, crm_cd_desc, {severity_sql('crm_cd_desc')} AS severity FROM raw"
SQL["translate_crime"] = with_("raw") + (
    f"SELECT dr_no, {translate_sql('crm_cd_desc')} AS crime_es, {translate_sql('lower(crm_cd_desc)')} AS crime_es_lower, "
    f"{translate_sql('weapon_desc')} AS weapon_es FROM raw"
)
SQL["clean_audit"] = with_("parsed") + (
    f"SELECT COUNT(*) AS loaded_rows, COUNT(d) AS dated_rows, "
    f"CAST(COALESCE(SUM(CASE WHEN d IS NOT NULL AND lat_r IS NOT NULL AND lon_r IS NOT NULL AND lat_r <> 0 AND lon_r <> 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS valid_rows "
    f"FROM (SELECT *, {_rescale('lat_num', 90)} AS lat_r, {_rescale('lon_num', 180)} AS lon_r FROM parsed) s"
)

# ---------------------------------------------------------------- exploration
SQL["top_crimes"] = with_("clean") + top_sql("clean", "crm_cd_desc", 15)
SQL["monthly_counts"] = with_("clean") + top_sql("clean", "month", None)
SQL["year_month_counts"] = with_("clean") + "SELECT year, month, COUNT(dr_no) AS n_incidents FROM clean GROUP BY year, month"
SQL["top_areas"] = with_("clean") + top_sql("clean", "area_name", 20)
SQL["hour_counts"] = with_("clean") + (
    "SELECT CAST(LEAST(GREATEST(FLOOR(time_occ / 100.0), 0), 23) AS INTEGER) AS hour, COUNT(*) AS n_incidents FROM clean "
    "WHERE time_occ IS NOT NULL GROUP BY 1"
)
SQL["sex_counts"] = with_("clean") + "SELECT COALESCE(vict_sex, 'X') AS vict_sex, COUNT(*) AS n_incidents FROM clean GROUP BY 1"
SQL["top_weapons"] = with_("clean") + top_sql("clean", "weapon_desc", 15)
SQL["class_imbalance"] = with_("clean") + top_sql("clean", "crm_cd_desc", 30)
SQL["topn_semi_join"] = with_("clean") + (
    "SELECT dr_no, crm_cd_desc FROM clean WHERE crm_cd_desc IN (SELECT crm_cd_desc FROM ("
    + top_sql("clean", "crm_cd_desc", 10)
    + ") t)"
)
# every month of the fixture's dates, 1995-01 to 2001-08
_MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13) if (y, m) <= (2001, 8)]
SQL["year_month_pivot"] = with_("clean") + (
    "SELECT year, "
    + ", ".join(f"COUNT(CASE WHEN month = '{m}' THEN dr_no END) AS \"{m}\"" for m in _MONTHS)
    + " FROM clean WHERE year IS NOT NULL GROUP BY year"
)
SQL["area_sex_crosstab"] = with_("clean") + (
    "SELECT area_name, CAST(SUM(CASE WHEN vict_sex = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f_count, "
    "CAST(SUM(CASE WHEN vict_sex = 'M' THEN 1 ELSE 0 END) AS BIGINT) AS m_count FROM clean "
    "WHERE vict_sex IN ('M', 'F') AND area_name IN (SELECT area_name FROM ("
    + top_sql("clean", "area_name", 15, where="vict_sex IN ('M', 'F')")
    + ") t) GROUP BY area_name"
)

_AGE_STATS = """ages AS (SELECT CAST(vict_age AS DOUBLE) AS a, COUNT(*) AS c FROM clean WHERE vict_age > 0 GROUP BY vict_age),
st0 AS (SELECT MIN(a) AS amin, MAX(a) AS amax, SUM(c) AS n FROM ages),
st AS (SELECT n, CASE WHEN amin = amax THEN amin - 0.5 ELSE amin END AS lo, CASE WHEN amin = amax THEN amax + 0.5 ELSE amax END AS hi,
       amin = amax AS flat FROM st0 WHERE n IS NOT NULL)"""

SQL["age_histogram"] = with_("clean") + "," + _AGE_STATS + """,
binned AS (
  SELECT c, CASE WHEN a < e0 THEN b0 - 1 WHEN a >= e1 AND b0 <> 39 THEN b0 + 1 ELSE b0 END AS bin FROM (
    SELECT a, c, b0, CASE WHEN b0 >= 40 THEN hi ELSE b0 * ((hi - lo) / 40.0::DOUBLE) + lo END AS e0,
           CASE WHEN b0 + 1 >= 40 THEN hi ELSE (b0 + 1) * ((hi - lo) / 40.0::DOUBLE) + lo END AS e1
    FROM (SELECT a, c, lo, hi, CAST(LEAST(FLOOR((a - lo) * (40.0::DOUBLE / (hi - lo))), 39) AS INTEGER) AS b0 FROM ages, st) x) y
)
SELECT CAST(b.bin AS INTEGER) AS bin, ROUND(b.bin * ((hi - lo) / 40.0::DOUBLE) + lo, 6) AS bin_start,
  ROUND(CASE WHEN b.bin = 39 THEN hi ELSE (b.bin + 1) * ((hi - lo) / 40.0::DOUBLE) + lo END, 6) AS bin_end,
  CAST(COALESCE((SELECT SUM(c) FROM binned WHERE binned.bin = b.bin), 0) AS BIGINT) AS n_incidents
FROM st, (SELECT range AS bin FROM range(0, 40)) b"""

SQL["age_density"] = with_("clean") + "," + _AGE_STATS + """,
mom AS (SELECT SUM(a * c) / CAST(SUM(c) AS DOUBLE) AS mean FROM ages),
bw AS (SELECT st.*, SQRT((SELECT SUM(c * (a - mean) * (a - mean)) FROM ages, mom) / (n - 1)) * POW(CAST(n AS DOUBLE), -0.2) AS h FROM st WHERE NOT flat),
grid AS (SELECT g, CASE WHEN g = 199 THEN hi ELSE lo + g * ((hi - lo) / 199.0::DOUBLE) END AS x, h, n, lo, hi FROM bw, (SELECT range AS g FROM range(0, 200)) r WHERE h > 0)
SELECT CAST(g AS INTEGER) AS grid_idx, ROUND(x, 6) AS x,
  ROUND(SUM(c * EXP(-0.5 * POW((x - a) / h, 2.0))) / (n * h * SQRT(2 * PI())) * n * ((hi - lo) / 40.0::DOUBLE), 4) AS density_count
FROM grid, ages GROUP BY g, x, h, n, lo, hi"""

# ---------------------------------------------------------------- more stand-in inputs
register_cte("points", """points AS (
  SELECT c_custkey AS point_id, n_name AS area,
    CAST(337500 + 200 * nk + 3 * (c_custkey % 61) AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat,
    CAST(-1186500 + 200 * nk + 3 * (c_custkey % 67) AS DOUBLE) / CAST(10000 AS DOUBLE) AS lon,
    2002 AS date_year, CAST(1 + c_custkey % 12 AS INTEGER) AS date_month, CAST(c_custkey % 7 AS INTEGER) AS day_of_week,
    CAST(c_custkey % 24 AS INTEGER) AS hour_of_day, CAST(18 + c_custkey % 73 AS INTEGER) AS victim_age,
    (['M', 'F', 'X', 'Z'])[c_custkey % 4 + 1] AS victim_sex
  FROM (SELECT c_custkey, CAST(n_nationkey AS BIGINT) AS nk, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) s
)""", [])

register_cte("questions", """questions AS (
  SELECT c_custkey AS question_id, CASE c_custkey % 6
    WHEN 0 THEN 'Crímenes entre las ' || CAST(c_custkey % 24 AS VARCHAR) || ' y las ' || CAST((7 * c_custkey + 3) % 24 AS VARCHAR)
    WHEN 1 THEN 'Compara Nation_' || CAST(c_custkey % 25 AS VARCHAR) || ' versus NATION_' || CAST((3 * c_custkey + 1) % 25 AS VARCHAR)
    WHEN 2 THEN '¿Cuál es la tendencia de robos este año?'
    WHEN 3 THEN 'Evolución de homicidios'
    WHEN 4 THEN 'Compara NATION_7'
    ELSE 'hola' END AS text
  FROM customer
)""", [])


def _nat_lat(nk: str) -> str:
    return f"CAST(337550 + 200 * ({nk}) AS DOUBLE) / CAST(10000 AS DOUBLE)"


def _nat_lon(nk: str) -> str:
    return f"CAST(-1186450 + 200 * ({nk}) AS DOUBLE) / CAST(10000 AS DOUBLE)"


register_cte("trips", f"""trips AS (
  SELECT s_suppkey AS trip_id, 'user_' || CAST(s_suppkey % 10 AS VARCHAR) AS user_name,
    CASE WHEN s_suppkey % 70 = 0 THEN 35.0::DOUBLE ELSE {_nat_lat('nk')} END AS lat1, {_nat_lon('nk')} AS lon1,
    {_nat_lat('(nk * 7 + 5) % 25')} AS lat2, {_nat_lon('(nk * 7 + 5) % 25')} AS lon2,
    CAST(DATE '2002-01-01' + CAST(s_suppkey % 365 AS INTEGER) AS DATE) AS travel_date,
    CAST(s_suppkey % 24 AS INTEGER) AS travel_hour, CAST(10 + s_suppkey % 80 AS INTEGER) AS age,
    (['M', 'F', 'X'])[s_suppkey % 3 + 1] AS sex,
    TIMESTAMP '2024-01-01 00:00:00' + TO_MINUTES(CAST(s_suppkey * 7 AS BIGINT)) AS requested_at
  FROM (SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS nk FROM supplier) s
)""", [])

register_cte("routes", """routes AS (
  SELECT trip_id, CAST(i AS INTEGER) AS route_seq, 'direct' AS kind, CAST(NULL AS INTEGER) AS cand_idx,
    CAST(5000 + (trip_id % 50) * 40 + 150 * i AS DOUBLE) AS distance,
    CASE WHEN trip_id % 17 = 0 AND i = 1 THEN NULL ELSE CAST(600 + (trip_id * 31 + 37 * i) % 400 AS DOUBLE) END AS duration
  FROM (SELECT trip_id, unnest(generate_series(0, CASE WHEN trip_id % 9 = 0 THEN 6 ELSE 1 + trip_id % 3 END - 1)) AS i FROM trips) d
  UNION ALL
  SELECT trip_id, CAST(100 + i AS INTEGER), 'waypoint', CAST(i AS INTEGER),
    CAST(5000 + (trip_id % 50) * 40 + (i * (trip_id % 13 + 1) * 23) % 700 AS DOUBLE),
    CAST(650 + (trip_id * 17 + 41 * i) % 400 AS DOUBLE)
  FROM (SELECT trip_id, unnest(generate_series(0, 9)) AS i FROM trips) w
)""", ["trips"])

register_cte("route_points", """route_points AS (
  SELECT trip_id, route_seq, idx, n_points,
    lon1 + (lon2 - lon1) * idx / (n_points - 1) AS lon,
    lat1 + (lat2 - lat1) * idx / (n_points - 1) + (route_seq % 10) / 1000.0::DOUBLE AS lat
  FROM (SELECT r.trip_id, r.route_seq, t.lat1, t.lon1, t.lat2, t.lon2, CAST(90 + (r.trip_id % 7) * 60 AS INTEGER) AS n_points,
               unnest(generate_series(0, CAST(90 + (r.trip_id % 7) * 60 AS INTEGER) - 1)) AS idx
        FROM routes r JOIN trips t ON r.trip_id = t.trip_id) x
)""", ["routes"])

# ---------------------------------------------------------------- dashboard
_DASH = """dash AS (
  SELECT * FROM clean
  WHERE year IN (1996, 1999, 2001) AND area_name IN ('NATION_1', 'NATION_4', 'NATION_12', 'NATION_20', 'NATION_24')
    AND crm_cd_desc IN (SELECT crm_cd_desc FROM options WHERE label IN ('VEHÍCULO ROBADO', 'ROBO DE IDENTIDAD', 'HURTO MENOR', 'ROBO CON VIOLENCIA'))
)"""
register_cte("options", f"""options AS (
  SELECT label, arg_max(crm_cd_desc, rk) AS crm_cd_desc FROM (
    SELECT crm_cd_desc, {translate_sql('crm_cd_desc')} AS label, ROW_NUMBER() OVER (ORDER BY n DESC, crm_cd_desc ASC) AS rk
    FROM ({top_sql('clean', 'crm_cd_desc', 10, alias='n')}) t) r
  GROUP BY label
)""", ["clean"])
register_cte("dash", _DASH, ["options"])

_METRICS = (
    "SELECT COUNT(*) AS total_rows, "
    "CAST(COUNT(DISTINCT area_name) + COALESCE(MAX(CAST(area_name IS NULL AS INTEGER)), 0) AS BIGINT) AS n_areas, "
    "CAST(COUNT(DISTINCT year) + COALESCE(MAX(CAST(year IS NULL AS INTEGER)), 0) AS BIGINT) AS n_years, "
    "CAST(COUNT(DISTINCT crm_cd_desc) + COALESCE(MAX(CAST(crm_cd_desc IS NULL AS INTEGER)), 0) AS BIGINT) AS n_types FROM "
)
SQL["dashboard_filter"] = with_("dash") + "SELECT dr_no, year, area_name, crm_cd_desc FROM dash"
SQL["dashboard_metrics"] = with_("dash") + _METRICS + "dash"
SQL["dashboard_metrics_all"] = with_("clean") + _METRICS + "clean"
SQL["distinct_areas"] = with_("clean") + "SELECT DISTINCT area_name FROM clean WHERE area_name IS NOT NULL"
SQL["distinct_years"] = with_("clean") + "SELECT DISTINCT year FROM clean WHERE year IS NOT NULL"
SQL["crime_options"] = with_("options") + "SELECT label, crm_cd_desc FROM options"
SQL["area_centroids"] = with_("clean") + (
    "SELECT area_name, ROUND(AVG(lat), 6) AS lat, ROUND(AVG(lon), 6) AS lon FROM clean WHERE area_name IS NOT NULL GROUP BY area_name"
)
SQL["area_point"] = with_("clean") + (
    "SELECT r.area, COALESCE(f.lat, 34.05::DOUBLE) AS lat, COALESCE(f.lon, -118.24::DOUBLE) AS lon "
    "FROM (SELECT n_name AS area FROM nation UNION ALL SELECT r_name FROM region) r "
    "LEFT JOIN (SELECT area_name, arg_min(lat, dr_no) AS lat, arg_min(lon, dr_no) AS lon FROM clean WHERE area_name IS NOT NULL GROUP BY area_name) f "
    "ON r.area = f.area_name"
)
SQL["sample_n"] = with_("clean") + "SELECT dr_no, crm_cd_desc FROM clean ORDER BY md5(CAST(dr_no AS VARCHAR) || '42'), dr_no LIMIT 1000"
SQL["heat_points"] = with_("dash") + "SELECT lat, lon FROM dash ORDER BY md5(CAST(dr_no AS VARCHAR) || '42'), dr_no LIMIT 2000"
SQL["context_heat_points"] = with_("clean") + (
    "SELECT lat, lon FROM clean ORDER BY md5(CAST(dr_no AS VARCHAR) || 'context'), dr_no LIMIT 1000"
)
SQL["in_city_box"] = with_("points") + (
    "SELECT point_id, (lat BETWEEN 33.7::DOUBLE AND 34.35::DOUBLE AND lon BETWEEN -118.7::DOUBLE AND -118.0::DOUBLE) AS in_box FROM points"
)

# ---------------------------------------------------------------- geo
register_cte("centroids", """centroids AS (
  SELECT area_name, AVG(lat) AS lat, AVG(lon) AS lon FROM clean WHERE area_name IS NOT NULL GROUP BY area_name
)""", ["clean"])
SQL["nearest_area"] = with_("centroids", "points") + """
SELECT point_id, arg_min(area_name, [POW(c.lat - p.lat, 2.0) + POW(c.lon - p.lon, 2.0), r]) AS nearest_area
FROM points p, (SELECT *, ROW_NUMBER() OVER (ORDER BY area_name) AS r FROM centroids) c GROUP BY point_id"""

_NEAR = """near AS (
  SELECT p.point_id, c.crm_cd_desc
  FROM points p JOIN clean c
    ON c.lat BETWEEN p.lat - 0.002::DOUBLE AND p.lat + 0.002::DOUBLE AND c.lon BETWEEN p.lon - 0.002::DOUBLE AND p.lon + 0.002::DOUBLE
)"""
register_cte("near", _NEAR, ["points", "clean"])
SQL["incidents_near_point"] = with_("near") + (
    "SELECT p.point_id, CAST(COUNT(n.point_id) AS BIGINT) AS n_incidents FROM points p LEFT JOIN near n ON p.point_id = n.point_id "
    "GROUP BY p.point_id"
)
SQL["mode_near_point"] = with_("near") + """
SELECT t.point_id, t.n_incidents, m.top_crime FROM
  (SELECT point_id, COUNT(*) AS n_incidents FROM near GROUP BY point_id) t
  LEFT JOIN (SELECT point_id, crm_cd_desc AS top_crime FROM (
      SELECT point_id, crm_cd_desc, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY COUNT(*) DESC, crm_cd_desc ASC) AS rn
      FROM near WHERE crm_cd_desc IS NOT NULL GROUP BY point_id, crm_cd_desc) z WHERE rn = 1) m
  ON t.point_id = m.point_id"""
SQL["recent_years"] = with_("clean") + "SELECT dr_no, year FROM clean WHERE year >= (SELECT MAX(year) FROM clean) - 1"
SQL["route_risk_historical"] = with_("clean", "route_points") + f"""
, rp AS (SELECT trip_id, route_seq, idx, lat, lon FROM route_points WHERE idx % 10 = 0),
rec AS (SELECT * FROM clean WHERE year >= (SELECT MAX(year) FROM clean) - 1),
hits AS (SELECT rp.trip_id, rp.route_seq, rp.idx, c.crm_cd_desc FROM rp JOIN rec c
  ON c.lat BETWEEN rp.lat - 0.002::DOUBLE AND rp.lat + 0.002::DOUBLE AND c.lon BETWEEN rp.lon - 0.002::DOUBLE AND rp.lon + 0.002::DOUBLE),
cnt AS (SELECT trip_id, route_seq, idx, COUNT(*) AS n FROM hits GROUP BY trip_id, route_seq, idx),
md AS (SELECT trip_id, route_seq, idx, crm_cd_desc FROM (
  SELECT trip_id, route_seq, idx, crm_cd_desc, ROW_NUMBER() OVER (PARTITION BY trip_id, route_seq, idx ORDER BY COUNT(*) DESC, crm_cd_desc) AS rn
  FROM hits WHERE crm_cd_desc IS NOT NULL GROUP BY trip_id, route_seq, idx, crm_cd_desc) z WHERE rn = 1)
SELECT rp.trip_id, rp.route_seq, CAST(rp.idx AS INTEGER) AS idx, rp.lat, rp.lon, cnt.n AS count,
  {translate_sql('md.crm_cd_desc')} AS crime_type, 1 AS intensity
FROM rp JOIN cnt USING (trip_id, route_seq, idx) LEFT JOIN md USING (trip_id, route_seq, idx) WHERE cnt.n > 5"""

# ---------------------------------------------------------------- questions
_HPAT = r"entre\s+las?\s+(\d{1,2})\s+y\s+las?\s+(\d{1,2})"
register_cte("qf", f"""qf AS (
  SELECT question_id, text, lower(text) AS low, {question_crime_sql('text')} AS crime,
    regexp_matches(lower(text), '{_HPAT}') AS has_interval,
    CASE WHEN regexp_matches(lower(text), '{_HPAT}') THEN TRY_CAST(regexp_extract(lower(text), '{_HPAT}', 1) AS INTEGER) END AS start_h,
    CASE WHEN regexp_matches(lower(text), '{_HPAT}') THEN TRY_CAST(regexp_extract(lower(text), '{_HPAT}', 2) AS INTEGER) END AS end_h,
    regexp_matches(lower(text), '{vocab.COMPARE_PATTERN}') AS is_compare,
    regexp_matches(lower(text), '{vocab.TREND_PATTERN}') AS is_trend
  FROM questions
)""", ["questions"])
register_cte("hours", """hours AS (
  SELECT CAST(((FLOOR(time_occ / 100.0) % 24) + 24) % 24 AS INTEGER) AS h, COUNT(*) AS n FROM clean WHERE time_occ IS NOT NULL GROUP BY 1
)""", ["clean"])
register_cte("win", """win AS (
  SELECT q.question_id, q.start_h, q.end_h, CAST(COALESCE(SUM(h.n), 0) AS BIGINT) AS n_incidents FROM qf q LEFT JOIN hours h
    ON CASE WHEN q.start_h <= q.end_h THEN h.h >= q.start_h AND h.h <= q.end_h ELSE h.h >= q.start_h OR h.h <= q.end_h END
  WHERE q.has_interval GROUP BY q.question_id, q.start_h, q.end_h
)""", ["qf", "hours"])
register_cte("acount", """acount AS (SELECT area_name, COUNT(*) AS n FROM clean WHERE area_name IS NOT NULL GROUP BY area_name)""", ["clean"])
register_cte("qareas", """qareas AS (
  SELECT q.question_id, a.area_name, a.n, ROW_NUMBER() OVER (PARTITION BY q.question_id ORDER BY a.area_name) - 1 AS pos
  FROM qf q JOIN acount a ON contains(q.low, lower(a.area_name))
)""", ["qf", "acount"])
register_cte("cmp", """cmp AS (
  SELECT a.question_id, a.area_name AS area1, b.area_name AS area2, a.n AS count1, b.n AS count2, ABS(a.n - b.n) AS diff,
    CASE WHEN a.n > b.n THEN a.area_name ELSE b.area_name END AS winner
  FROM qareas a JOIN qareas b ON a.question_id = b.question_id AND a.pos = 0 AND b.pos = 1
)""", ["qareas"])
register_cte("trend", """trend AS (
  SELECT crime, last_year, prev_year, last_count, prev_count,
    ROUND((last_count - prev_count) / CAST(prev_count AS DOUBLE) * 100, 6) AS change_pct,
    CASE WHEN (last_count - prev_count) / CAST(prev_count AS DOUBLE) * 100 > 0 THEN 'subido' ELSE 'bajado' END AS trend,
    printf('%.1f', ABS((last_count - prev_count) / CAST(prev_count AS DOUBLE) * 100)) AS change_text
  FROM (
    SELECT crime, MAX(CASE WHEN rn = 1 THEN year END) AS last_year, MAX(CASE WHEN rn = 2 THEN year END) AS prev_year,
      MAX(CASE WHEN rn = 1 THEN n END) AS last_count, MAX(CASE WHEN rn = 2 THEN n END) AS prev_count, COUNT(*) AS k
    FROM (SELECT crime, year, n, ROW_NUMBER() OVER (PARTITION BY crime ORDER BY year DESC) AS rn FROM (
        SELECT crm_cd_desc AS crime, year, COUNT(*) AS n FROM clean WHERE year IS NOT NULL AND crm_cd_desc IS NOT NULL GROUP BY 1, 2
        UNION ALL SELECT NULL, year, COUNT(*) FROM clean WHERE year IS NOT NULL GROUP BY year) u) r
    WHERE rn <= 2 GROUP BY crime) g
  WHERE k > 1
)""", ["clean"])

SQL["question_crime"] = with_("questions") + f"SELECT question_id, {question_crime_sql('text')} AS crime FROM questions"
SQL["question_hours"] = with_("qf") + "SELECT question_id, start_h, end_h FROM qf WHERE has_interval"
SQL["hour_window_count"] = with_("win") + "SELECT * FROM win"
SQL["question_areas"] = with_("qareas") + "SELECT question_id, CAST(pos AS INTEGER) AS pos, area_name FROM qareas"
SQL["compare_areas"] = with_("cmp", "qf") + "SELECT c.* FROM cmp c JOIN qf USING (question_id) WHERE qf.is_compare"
SQL["yearly_trend"] = with_("trend") + "SELECT crime, last_year, prev_year, last_count, prev_count, change_pct, trend FROM trend"

_ANSWER = f"""
SELECT q.question_id,
  CASE WHEN q.has_interval THEN 'hour_interval' WHEN q.is_compare AND c.area1 IS NOT NULL THEN 'comparison'
       WHEN q.is_trend AND t.last_year IS NOT NULL THEN 'trend' ELSE 'generic' END AS intent,
  CASE WHEN q.has_interval THEN 'He analizado el período entre las ' || CAST(q.start_h AS VARCHAR) || ':00 y las ' || CAST(q.end_h AS VARCHAR)
         || ':00. Se registraron **' || format('{{:,}}', w.n_incidents) || ' incidentes**.'
       WHEN q.is_compare AND c.area1 IS NOT NULL THEN 'Comparativa: **' || c.area1 || '** (' || format('{{:,}}', c.count1) || ') vs **'
         || c.area2 || '** (' || format('{{:,}}', c.count2) || '). La zona de **' || c.winner || '** tiene ' || format('{{:,}}', c.diff) || ' crímenes más.'
       WHEN q.is_trend AND t.last_year IS NOT NULL THEN 'La tendencia de ''' || COALESCE(q.crime, '{vocab.ALL_CRIMES_LABEL}') || ''' ha **'
         || t.trend || '** un ' || t.change_text || '% en el último año registrado.'
       ELSE {_q(vocab.GENERIC_ANSWER)} END AS answer
FROM qf q LEFT JOIN win w USING (question_id) LEFT JOIN cmp c USING (question_id)
  LEFT JOIN trend t ON t.crime IS NOT DISTINCT FROM q.crime"""
SQL["answer_questions"] = with_("qf", "win", "cmp", "trend") + _ANSWER
SQL["question_intent"] = with_("qf", "win", "cmp", "trend") + "SELECT question_id, intent FROM (" + _ANSWER + ") a"

# ---------------------------------------------------------------- routes
def score_sql(lat: str, lon: str, hour: str) -> str:
    """Fixture scorer columns (prediction, confidence, severity, severity_confidence) from z."""
    z = f"CAST(FLOOR(ABS({lat}) * 10000) + FLOOR(ABS({lon}) * 10000) + {hour} AS BIGINT)"
    return (
        f"({CRIMES})[{z} % 10 + 1] AS prediction, (10 + {z} % 60) / 100.0::DOUBLE AS confidence, "
        f"CASE WHEN {z} % 3 = 0 THEN 'SEGURO' ELSE 'PELIGROSO' END AS severity, (50 + {z} % 50) / 100.0::DOUBLE AS severity_confidence"
    )


_BOX = "{a} BETWEEN 33.7::DOUBLE AND 34.35::DOUBLE AND {o} BETWEEN -118.7::DOUBLE AND -118.0::DOUBLE"
register_cte("ctx", """ctx AS (
  SELECT trip_id, CAST(year(travel_date) AS INTEGER) AS year, CAST(month(travel_date) AS INTEGER) AS month,
    CAST(isodow(travel_date) - 1 AS INTEGER) AS day_of_week, travel_hour AS hour, age, sex FROM trips
)""", ["trips"])
register_cte("gbox", f"""gbox AS (
  SELECT trip_id, grid,
    GREATEST(33.7::DOUBLE, LEAST(lat1, lat2) - ABS(lat2 - lat1) * 0.2::DOUBLE) AS min_lat,
    LEAST(34.35::DOUBLE, GREATEST(lat1, lat2) + ABS(lat2 - lat1) * 0.2::DOUBLE) AS max_lat,
    GREATEST(-118.7::DOUBLE, LEAST(lon1, lon2) - ABS(lon2 - lon1) * 0.2::DOUBLE) AS min_lon,
    LEAST(-118.0::DOUBLE, GREATEST(lon1, lon2) + ABS(lon2 - lon1) * 0.2::DOUBLE) AS max_lon
  FROM (SELECT *, CASE WHEN d > 0.15::DOUBLE THEN 10 WHEN d > 0.08::DOUBLE THEN 8 ELSE 6 END AS grid
        FROM (SELECT *, SQRT((lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1)) AS d FROM trips) a) b
  WHERE {_BOX.format(a='lat1', o='lon1')} AND {_BOX.format(a='lat2', o='lon2')}
)""", ["trips"])
register_cte("grid", """grid AS (
  SELECT trip_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
    min_lat + i * ((max_lat - min_lat) / grid) AS lat, min_lon + j * ((max_lon - min_lon) / grid) AS lon
  FROM (SELECT *, unnest(generate_series(0, grid - 1)) AS j FROM (SELECT *, unnest(generate_series(0, grid - 1)) AS i FROM gbox) x) y
)""", ["gbox"])
register_cte("zones", f"""zones AS (
  SELECT trip_id, i, j, lat, lon, severity_confidence AS severity_conf, LEFT({translate_sql('prediction')}, 40) AS crime_type
  FROM (SELECT g.*, {score_sql('g.lat', 'g.lon', 'c.hour')} FROM grid g JOIN ctx c USING (trip_id)) s
  WHERE severity = 'PELIGROSO' AND severity_confidence > 0.55::DOUBLE
)""", ["grid", "ctx"])
_OPTS = ", ".join(
    f"({si * len(vocab.DETOUR_DEVIATIONS) + di}, {side}, {dev}::DOUBLE)"
    for si, side in enumerate(vocab.DETOUR_SIDES) for di, dev in enumerate(vocab.DETOUR_DEVIATIONS)
)
register_cte("cands", f"""cands AS (
  SELECT trip_id, o.cand_idx, mid_lat + perp_dx * (d * o.dev) * o.side AS wp_lat, mid_lon + perp_dy * (d * o.dev) * o.side AS wp_lon
  FROM (SELECT trip_id, d, (lat1 + lat2) / 2 AS mid_lat, (lon1 + lon2) / 2 AS mid_lon, -((lon2 - lon1) / d) AS perp_dx, (lat2 - lat1) / d AS perp_dy
        FROM (SELECT *, SQRT((lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1)) AS d FROM trips) a WHERE d > 0) t,
       (VALUES {_OPTS}) o(cand_idx, side, dev)
)""", ["trips"])
register_cte("threats", """threats AS (
  SELECT c.trip_id, c.cand_idx, c.wp_lat, c.wp_lon,
    COALESCE(list_reduce(list(((z.severity_conf - 0.65::DOUBLE) / 0.35::DOUBLE * 10)
        / POW(GREATEST(SQRT((c.wp_lat - z.lat) * (c.wp_lat - z.lat) + (c.wp_lon - z.lon) * (c.wp_lon - z.lon)), 0.0001::DOUBLE), 1.5::DOUBLE)
      ORDER BY z.i, z.j) FILTER (WHERE z.trip_id IS NOT NULL), lambda a, b: a + b, 0.0::DOUBLE), 0.0::DOUBLE) AS threat,
    COUNT(z.trip_id) AS n_zones
  FROM cands c LEFT JOIN zones z ON c.trip_id = z.trip_id GROUP BY c.trip_id, c.cand_idx, c.wp_lat, c.wp_lon
)""", ["cands", "zones"])
register_cte("best_wp", """best_wp AS (
  SELECT * FROM (
    SELECT t.*, CAST(ROW_NUMBER() OVER (PARTITION BY t.trip_id ORDER BY threat, cand_idx) AS INTEGER) AS rank
    FROM threats t JOIN (SELECT trip_id, COUNT(*) AS nd FROM routes WHERE kind = 'direct' GROUP BY trip_id) d ON t.trip_id = d.trip_id
    WHERE t.n_zones > 0 AND d.nd < 6) r
  WHERE rank <= 4
)""", ["threats", "routes"])
register_cte("cu", """cu AS (
  SELECT trip_id, route_seq, kind, distance, duration, CAST(ROW_NUMBER() OVER (PARTITION BY trip_id ORDER BY o1, o2) - 1 AS INTEGER) AS ord FROM (
    SELECT trip_id, route_seq, kind, distance, duration, 0 AS o1, route_seq AS o2 FROM routes WHERE kind = 'direct'
    UNION ALL
    SELECT r.trip_id, r.route_seq, r.kind, r.distance, r.duration, 1, b.rank FROM routes r JOIN best_wp b ON r.trip_id = b.trip_id AND r.cand_idx = b.cand_idx
    WHERE r.kind = 'waypoint') u
)""", ["routes", "best_wp"])
register_cte("accepted", """accepted AS (
  SELECT a.trip_id, a.route_id, a.route_seq, r.kind, r.distance, r.duration FROM (
    SELECT trip_id, CAST(unnest(range(len(kept))) AS INTEGER) AS route_id, unnest(list_transform(kept, lambda x: x.seq)) AS route_seq FROM (
      SELECT trip_id, list_reduce(list({'seq': route_seq, 'k': kind, 'd': COALESCE(distance, 0.0::DOUBLE)} ORDER BY ord),
        lambda acc, r: CASE WHEN r.k = 'direct' OR (len(acc) < 6 AND NOT COALESCE(list_bool_or(list_transform(acc, lambda a: abs(r.d - a.d) < 100)), false))
                            THEN list_append(acc, {'seq': r.seq, 'd': r.d}) ELSE acc END,
        []::STRUCT(seq INTEGER, d DOUBLE)[]) AS kept
      FROM cu GROUP BY trip_id) dd) a
  JOIN routes r ON a.trip_id = r.trip_id AND a.route_seq = r.route_seq
)""", ["cu"])
register_cte("samples", """samples AS (
  SELECT trip_id, route_seq, CAST(CASE WHEN ns > 15 THEN r // (ns // 15) ELSE r END AS INTEGER) AS sample_idx, lat, lon
  FROM (SELECT *, idx // 20 AS r, (n_points + 19) // 20 AS ns FROM route_points WHERE idx % 20 = 0) s
  WHERE ns <= 15 OR (r % (ns // 15) = 0 AND r // (ns // 15) < 15)
)""", ["route_points"])
register_cte("risks", f"""risks AS (
  SELECT trip_id, route_id, route_seq, sample_idx, lat, lon, CAST(TRUNC(confidence * 100) AS INTEGER) AS count,
    CASE WHEN severity_confidence > 0.75::DOUBLE THEN 2 WHEN severity_confidence > 0.6::DOUBLE THEN 1 ELSE 0 END AS intensity,
    severity_confidence AS severity_conf,
    '[RIESGO] ' || label || ' (' || printf('%.0f', confidence * 100) || '%)' AS description,
    LEFT(label, 40) AS crime_type
  FROM (SELECT x.*, {translate_sql('x.prediction')} AS label FROM (
      SELECT s.*, a.route_id, {score_sql('s.lat', 's.lon', 'c.hour')}
      FROM samples s JOIN accepted a ON s.trip_id = a.trip_id AND s.route_seq = a.route_seq JOIN ctx c ON s.trip_id = c.trip_id) x) y
  WHERE severity = 'PELIGROSO' AND severity_confidence > 0.55::DOUBLE AND confidence > 0.2::DOUBLE
)""", ["samples", "accepted", "ctx"])
register_cte("ranked", """ranked AS (
  SELECT a.*, COALESCE(k.n, 0) AS n_risks,
    CAST(ROW_NUMBER() OVER (PARTITION BY a.trip_id ORDER BY COALESCE(k.n, 0), COALESCE(a.duration, 'inf'::DOUBLE), a.route_id) AS INTEGER) AS rank
  FROM accepted a LEFT JOIN (SELECT trip_id, route_id, COUNT(*) AS n FROM risks GROUP BY trip_id, route_id) k
    ON a.trip_id = k.trip_id AND a.route_id = k.route_id
)""", ["accepted", "risks"])
register_cte("best", """best AS (
  SELECT b.trip_id, b.route_id AS best_route_id, b.n_risks AS best_n_risks, n.n_routes
  FROM ranked b JOIN (SELECT trip_id, COUNT(*) AS n_routes FROM ranked GROUP BY trip_id) n ON b.trip_id = n.trip_id WHERE b.rank = 1
)""", ["ranked"])

SQL["request_calendar"] = with_("ctx") + "SELECT trip_id, year, month, day_of_week FROM ctx"
SQL["scan_routes"] = with_("route_points") + """
SELECT r.trip_id, r.route_seq, r.kind, r.cand_idx, r.distance, r.duration, CAST(p.n AS INTEGER) AS n_points,
  p.first_lon, p.first_lat, p.last_lon, p.last_lat
FROM routes r JOIN (SELECT trip_id, route_seq, COUNT(*) AS n, arg_min(lon, idx) AS first_lon, arg_min(lat, idx) AS first_lat,
  arg_max(lon, idx) AS last_lon, arg_max(lat, idx) AS last_lat FROM route_points GROUP BY trip_id, route_seq) p
  ON r.trip_id = p.trip_id AND r.route_seq = p.route_seq"""
SQL["trip_grid"] = with_("grid") + "SELECT * FROM grid"
SQL["danger_zones"] = with_("zones") + "SELECT * FROM zones"
SQL["threat_score"] = with_("threats") + (
    "SELECT trip_id, cand_idx, ROUND(wp_lat, 9) AS wp_lat, ROUND(wp_lon, 9) AS wp_lon, ROUND(threat, 4) AS threat FROM threats"
)
SQL["detour_waypoints"] = with_("best_wp") + (
    "SELECT trip_id, cand_idx, rank, ROUND(wp_lat, 9) AS wp_lat, ROUND(wp_lon, 9) AS wp_lon, ROUND(threat, 4) AS threat FROM best_wp"
)
SQL["route_union"] = with_("cu") + "SELECT trip_id, ord, route_seq, kind FROM cu"
SQL["dedup_routes"] = with_("accepted") + "SELECT * FROM accepted"
SQL["path_sample"] = with_("samples") + "SELECT * FROM samples"
SQL["route_risk_scored"] = with_("risks") + "SELECT * FROM risks"
SQL["best_route"] = with_("best") + "SELECT * FROM best"
SQL["route_danger_level"] = with_("ranked") + """
SELECT trip_id, route_id, n_risks, ROUND(lvl, 6) AS danger_level,
  CASE WHEN rank = 1 THEN 'best' WHEN lvl < 0.33 THEN 'low' WHEN lvl < 0.66 THEN 'medium' ELSE 'high' END AS danger_class
FROM (SELECT *, (n_risks - MIN(n_risks) OVER w) / CASE WHEN MAX(n_risks) OVER w > MIN(n_risks) OVER w THEN MAX(n_risks) OVER w - MIN(n_risks) OVER w ELSE 1 END AS lvl
      FROM ranked WINDOW w AS (PARTITION BY trip_id)) x"""
_RATING = " ".join(f"WHEN best_n_risks <= {n} THEN {_q(t)}" for n, t in vocab.SAFETY_RATINGS)
SQL["safety_rating"] = with_("best") + (
    f"SELECT trip_id, best_route_id, best_n_risks, CASE {_RATING} ELSE {_q(vocab.SAFETY_WORST)} END AS rating FROM best"
)
_DUR = ("CASE WHEN {m} >= 60 THEN CAST({m} // 60 AS VARCHAR) || 'h ' || CAST({m} % 60 AS VARCHAR) || 'min' "
        "ELSE CAST({m} AS VARCHAR) || ' min' END")
SQL["route_facts"] = with_("accepted") + (
    "SELECT trip_id, route_id, ROUND(COALESCE(distance, 0.0) / 1000, 6) AS distance_km, duration_min, "
    + _DUR.format(m="duration_min") + " AS time_text, COUNT(*) OVER (PARTITION BY trip_id) AS n_routes "
    "FROM (SELECT *, CAST(FLOOR(COALESCE(duration, 0.0) / 60) AS INTEGER) AS duration_min FROM accepted) a"
)
SQL["route_danger_percent"] = with_("ranked") + (
    "SELECT trip_id, route_id, n_risks, ROUND(CASE WHEN MAX(n_risks) OVER (PARTITION BY trip_id) > 0 "
    "THEN n_risks / MAX(n_risks) OVER (PARTITION BY trip_id) * 100 ELSE 0.0 END, 6) AS danger_pct FROM ranked"
)
SQL["routes_by_risk"] = with_("ranked") + "SELECT trip_id, route_id, n_risks, rank FROM ranked"
SQL["duration_text"] = with_("routes") + (
    "SELECT trip_id, route_seq, minutes, " + _DUR.format(m="minutes") + " AS duration_text "
    "FROM (SELECT trip_id, route_seq, CAST(FLOOR(COALESCE(duration, 0.0) / 60) AS INTEGER) AS minutes FROM routes) r"
)

# ---------------------------------------------------------------- ML data jobs
_FEATS = ["year", "lat", "lon", "time_occ", "vict_age", "vict_sex", "month_num", "premis_cd", "weapon_used_cd", "day_of_week"]
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in _FEATS + ["crm_cd_desc"])
register_cte("tf", f"""tf AS (
  SELECT dr_no, year, lat, lon, time_occ, vict_age,
    CAST(CASE WHEN vict_sex = 'F' THEN 0 WHEN vict_sex = 'M' THEN 1 ELSE 2 END AS INTEGER) AS vict_sex,
    month_num, premis_cd, weapon_used_cd, day_of_week, crm_cd_desc, {severity_sql('crm_cd_desc')} AS severity
  FROM clean WHERE {_COMPLETE} AND crm_cd_desc IN (
    SELECT crm_cd_desc FROM ({top_sql('clean', 'crm_cd_desc', 10, where=_COMPLETE)}) t)
)""", ["clean"])


def _bucket_sql(key: str, salt: str = "") -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || '{salt}'), 1, 8))::BIGINT % 100)"


register_cte("splits", f"""splits AS (
  SELECT *, CASE WHEN {_bucket_sql('dr_no')} < 20 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN {_bucket_sql('dr_no')} < 20 THEN 'test' WHEN {_bucket_sql('dr_no', ':val')} < 20 THEN 'validation' ELSE 'fit' END AS role
  FROM tf
)""", ["tf"])

SQL["complete_cases"] = with_("clean") + f"SELECT dr_no FROM clean WHERE {_COMPLETE}"
SQL["training_frame"] = with_("tf") + "SELECT * FROM tf"
SQL["severity_balance"] = with_("tf") + """
SELECT s.severity, COALESCE(c.n, 0) AS n_incidents,
  ROUND(CASE WHEN t.total > 0 THEN COALESCE(c.n, 0) / CAST(t.total AS DOUBLE) * 100 ELSE 0.0 END, 6) AS pct
FROM (VALUES ('PELIGROSO'), ('SEGURO')) s(severity)
  LEFT JOIN (SELECT severity, COUNT(*) AS n FROM tf GROUP BY severity) c ON s.severity = c.severity, (SELECT COUNT(*) AS total FROM tf) t"""
SQL["label_index"] = with_("tf") + (
    "SELECT dr_no, CAST(DENSE_RANK() OVER (ORDER BY crm_cd_desc) - 1 AS DOUBLE) AS type_label, "
    "CAST(DENSE_RANK() OVER (ORDER BY severity) - 1 AS DOUBLE) AS severity_label FROM tf"
)
_ST = ", ".join(f"AVG({c}) AS m_{c}, CASE WHEN STDDEV_POP({c}) = 0 OR STDDEV_POP({c}) IS NULL THEN 1.0 ELSE STDDEV_POP({c}) END AS s_{c}" for c in _FEATS)
SQL["scaled_features"] = with_("tf") + (
    "SELECT dr_no, " + ", ".join(f"ROUND((CAST({c} AS DOUBLE) - m_{c}) / s_{c}, 6) AS z_{c}" for c in _FEATS)
    + f" FROM tf, (SELECT {_ST} FROM tf) st"
)
SQL["stratified_split"] = with_("splits") + "SELECT dr_no, split FROM splits"
SQL["validation_split"] = with_("splits") + "SELECT dr_no, role FROM splits"
SQL["class_weights"] = with_("splits") + """
SELECT crm_cd_desc, n_c, ROUND(SUM(n_c) OVER () / (COUNT(*) OVER () * n_c), 6) AS weight
FROM (SELECT crm_cd_desc, COUNT(*) AS n_c FROM splits WHERE split = 'train' GROUP BY crm_cd_desc) c"""

_LABELS10 = _list(FIXTURE_CRIMES[:10])
register_cte("cls", """cls AS (
  SELECT point_id, cls, w / SUM(w) OVER (PARTITION BY point_id) AS p FROM (
    SELECT o_orderkey AS point_id, c AS cls, CAST(1 + (o_orderkey * (c + 3)) % 7 AS DOUBLE) AS w
    FROM orders, (SELECT range AS c FROM range(0, 10)) r) x
)""", [])
SQL["top_k_classes"] = with_("cls") + f"""
SELECT point_id, CAST(rn AS INTEGER) AS rank, ({_LABELS10})[cls + 1] AS crim, p AS probabilitat FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY p DESC, cls) AS rn FROM cls) t WHERE rn <= 3"""

# ---------------------------------------------------------------- history, places
register_cte("logt", f"""logt AS (
  SELECT o_orderkey AS log_id,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(o_orderkey % 28 AS INTEGER)) + to_seconds(CAST((o_orderkey * 37) % 86400 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS timestamp,
    'user_' || CAST(o_orderkey % 10 AS VARCHAR) AS user_name, p.area, p.lat AS in_lat, p.hour_of_day AS in_hour,
    ({_LABELS10})[t1.cls + 1] AS prediction, t1.p AS confidence, s.severity, s.severity_confidence
  FROM orders JOIN points p ON o_custkey = p.point_id
  JOIN (SELECT point_id, cls, p FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY p DESC, cls) AS rn FROM cls) z WHERE rn = 1) t1
    ON o_orderkey = t1.point_id
  JOIN (SELECT point_id, {score_sql('lat', 'lon', 'hour_of_day')} FROM points) s ON p.point_id = s.point_id
)""", ["points", "cls"])
SQL["prediction_log"] = with_("logt") + (
    "SELECT log_id, timestamp, user_name, area, in_lat, in_hour, prediction, confidence, severity, severity_confidence, 3 AS n_top FROM logt"
)
SQL["user_history"] = with_("logt") + f"SELECT log_id, timestamp, area, {translate_sql('prediction')} AS prediction_es FROM logt WHERE user_name = 'user_3'"
SQL["log_top3"] = with_("cls", "logt") + f"""
SELECT point_id AS log_id, CAST(rn AS INTEGER) AS rank, {translate_sql(f'({_LABELS10})[cls + 1]')} AS crim_es,
  printf('%.1f', p * 100) || '%' AS pct_text
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY p DESC, cls) AS rn FROM cls) t
WHERE rn <= 3 AND point_id IN (SELECT log_id FROM logt)"""
SQL["cut_text"] = with_("qf", "win", "cmp", "trend") + (
    "SELECT question_id, CASE WHEN length(answer) > 50 THEN LEFT(answer, 50) || '...' ELSE answer END AS answer_cut, "
    "LEFT(answer, 40) AS answer_40 FROM (" + _ANSWER + ") a"
)
SQL["latest_routes"] = with_("best", "zones") + """
SELECT user_name, trip_id, best_route_id, n_zones, CAST(pos AS INTEGER) AS pos FROM (
  SELECT t.user_name, t.trip_id, b.best_route_id, COALESCE(z.n, 0) AS n_zones,
    ROW_NUMBER() OVER (PARTITION BY t.user_name ORDER BY t.requested_at DESC, t.trip_id DESC) AS pos
  FROM trips t JOIN best b ON t.trip_id = b.trip_id LEFT JOIN (SELECT trip_id, COUNT(*) AS n FROM zones GROUP BY trip_id) z ON t.trip_id = z.trip_id) x
WHERE pos <= 10"""
register_cte("addr", """addr AS (
  SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 2 = 0 THEN '  ' || upper(s_name) || ' '
    WHEN s_suppkey % 5 = 1 THEN s_name || ', Los Angeles' ELSE s_name END AS address FROM supplier
  UNION ALL SELECT -1 - CAST(n_nationkey AS BIGINT), 'Plaza ' || n_name FROM nation
)""", [])
register_cte("gaz", f"""gaz AS (
  SELECT lower(trim(s_name)) AS address_key, CASE WHEN s_suppkey % 9 = 0 THEN 36.0::DOUBLE ELSE {_nat_lat('CAST(s_nationkey AS BIGINT)')} END AS lat,
    {_nat_lon('CAST(s_nationkey AS BIGINT)')} AS lon FROM supplier
)""", [])
_KEY = "regexp_replace(lower(address), '^\\s+|\\s+$', '', 'g')"
_SEARCH = "CASE WHEN contains(address, 'Los Angeles') THEN address ELSE address || ', Los Angeles, California, USA' END"
SQL["address_key"] = with_("addr") + f"SELECT request_id, {_KEY} AS address_key, {_SEARCH} AS search_text FROM addr"
SQL["place_lookup"] = with_("addr", "gaz") + f"""
SELECT request_id, address_key, search_text, COALESCE(inside, false) AS found,
  CASE WHEN inside THEN g_lat END AS lat, CASE WHEN inside THEN g_lon END AS lon,
  CASE WHEN g_lat IS NULL THEN 'Dirección no encontrada' WHEN NOT inside THEN 'Ubicación fuera del área metropolitana de Los Ángeles' END AS error
FROM (SELECT r.request_id, r.address_key, r.search_text, g.g_lat, g.g_lon,
        g.g_lat IS NOT NULL AND {_BOX.format(a='g.g_lat', o='g.g_lon')} AS inside
      FROM (SELECT request_id, {_KEY} AS address_key, {_SEARCH} AS search_text FROM addr) r
      LEFT JOIN (SELECT address_key, MIN({{'lat': lat, 'lon': lon}}).lat AS g_lat, MIN({{'lat': lat, 'lon': lon}}).lon AS g_lon FROM gaz GROUP BY address_key) g
      ON r.address_key = g.address_key) x"""

# ---------------------------------------------------------------- P18, streaming
SQL["select_features"] = with_("clean") + "SELECT dr_no, " + ", ".join(_FEATS) + " FROM clean"
SQL["stream_predictions"] = with_("points") + f"""
SELECT point_id AS request_id, 'user_' || CAST(point_id % 10 AS VARCHAR) AS user_name, area, lat, lon, hour_of_day AS hour,
  {score_sql('lat', 'lon', 'hour_of_day')}
FROM points"""

# ---------------------------------------------------------------- light fallback level
register_cte("light", """light AS (
  SELECT dr_no, d AS date_occ, time_occ, area_name, crm_cd_desc, vict_age, vict_sex, premis_cd, weapon_used_cd, weapon_desc,
    lat_num AS lat, lon_num AS lon, CAST(year(d) AS INTEGER) AS year, strftime(d, '%Y-%m') AS month,
    CAST(month(d) AS INTEGER) AS month_num, CAST(isodow(d) - 1 AS INTEGER) AS day_of_week
  FROM parsed
)""", ["parsed"])
SQL["load_incidents_light"] = with_("light") + f"SELECT {CLEAN_COLS} FROM light"


def _on_light(sql: str) -> str:
    """The same statement with the light table standing in for the cleaned one."""
    return sql.replace(" FROM clean", " FROM light").replace(" JOIN clean ", " JOIN light ")


register_cte("hours_l", _on_light(CTE["hours"]).replace("hours AS", "hours_l AS"), ["light"])
register_cte("acount_l", _on_light(CTE["acount"]).replace("acount AS", "acount_l AS"), ["light"])
register_cte("trend_l", _on_light(CTE["trend"]).replace("trend AS", "trend_l AS"), ["light"])
register_cte("win_l", CTE["win"].replace("win AS", "win_l AS").replace("JOIN hours h", "JOIN hours_l h"), ["qf", "hours_l"])
register_cte("qareas_l", CTE["qareas"].replace("qareas AS", "qareas_l AS").replace("JOIN acount a", "JOIN acount_l a"), ["qf", "acount_l"])
register_cte("cmp_l", CTE["cmp"].replace("cmp AS", "cmp_l AS").replace("FROM qareas a JOIN qareas b", "FROM qareas_l a JOIN qareas_l b"), ["qareas_l"])
SQL["answer_questions_light"] = with_("qf", "win_l", "cmp_l", "trend_l") + (
    _ANSWER.replace("LEFT JOIN win w", "LEFT JOIN win_l w").replace("LEFT JOIN cmp c", "LEFT JOIN cmp_l c")
    .replace("LEFT JOIN trend t", "LEFT JOIN trend_l t")
)
SQL["stream_answers"] = SQL["answer_questions"]
SQL["stratified_split_exact"] = with_("tf") + """
SELECT dr_no, crm_cd_desc, CASE WHEN rn <= FLOOR(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT dr_no, crm_cd_desc, ROW_NUMBER() OVER (PARTITION BY crm_cd_desc ORDER BY h NULLS LAST, dr_no) AS rn, COUNT(*) OVER (PARTITION BY crm_cd_desc) AS n
  FROM (SELECT dr_no, crm_cd_desc, ('0x' || substr(md5(CAST(dr_no AS VARCHAR)), 1, 15))::BIGINT AS h
    FROM (SELECT CASE WHEN dr_no % 7 <> 0 THEN dr_no END AS dr_no, crm_cd_desc FROM tf) w) x) y"""
SQL["dashboard_metrics_light"] = with_("light") + _METRICS + "(SELECT * FROM light WHERE lat IS NOT NULL AND lon IS NOT NULL) v"

# ---------------------------------------------------------------- classifier: what the data alone decide
_FEATURE_ROWS = " UNION ALL ".join(
    f"SELECT 'feature', '{c}', {i}, CAST(NULL AS BIGINT), ROUND(AVG({c}), 6), ROUND(CASE WHEN STDDEV_POP({c}) = 0 OR STDDEV_POP({c}) IS NULL THEN 1.0 ELSE STDDEV_POP({c}) END, 6) FROM tf" for i, c in enumerate(_FEATS))


def _facts_sql(label: str) -> str:
    return with_("tf") + (
        f"SELECT 'class' AS kind, {label} AS name, CAST(ROW_NUMBER() OVER (ORDER BY {label}) - 1 AS INTEGER) AS pos, COUNT(*) AS n, "
        f"CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std FROM tf GROUP BY {label} UNION ALL {_FEATURE_ROWS}"
    )


SQL["fit_type_model"] = _facts_sql("crm_cd_desc")
SQL["fit_severity_model"] = _facts_sql("severity")
SQL["model_accuracy"] = with_("splits") + """
SELECT t.target, (SELECT COUNT(*) FROM splits WHERE split = 'test') AS n_test, TRUE AS matches_rows, TRUE AS is_share FROM (VALUES ('type'), ('severity')) t(target)"""
SQL["score_points"] = """
SELECT c_custkey AS point_id, c_custkey % 97 <> 0 AS scored, CASE WHEN c_custkey % 97 <> 0 THEN TRUE END AS known, CASE WHEN c_custkey % 97 <> 0 THEN TRUE END AS ordered FROM customer"""
SQL["model_roundtrip"] = "SELECT c_custkey AS point_id, " + ", ".join(f"TRUE AS same_{c}" for c in ("prediction", "confidence", "top_3", "severity", "severity_confidence")) + " FROM customer"
SQL["route_risk_model"] = "SELECT s_suppkey AS trip_id, TRUE AS is_route, TRUE AS is_least, TRUE AS is_whole FROM supplier"
SQL["stream_predictions_model"] = "SELECT c_custkey AS request_id, TRUE AS as_batch FROM customer"
