"""SQL of the registered queries, for an independent engine.

The statements are composed from named common table expressions. Each string is
complete on its own and reads the whole tables.
"""

from __future__ import annotations

from dataclasses import replace

from stationwise.config import STORM_CATEGORIES, TREND_MEASURES, ClimateConfig
from stationwise.functions.stats import SQRT_TWO_PI, TAIL_DENOMINATOR, TAIL_NUMERATOR, TAIL_SWITCH
from stationwise.operators.risk import HOTSPOT_COLUMNS
from stationwise.plans.standin import NATION_RULES, REGION_RULES

EARTH = 6371.0088


def with_(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n" + select


# ---- expressions -----------------------------------------------------------


def sid(key: str) -> str:
    return f"'ST' || repeat('0', greatest(9 - length(({key})::VARCHAR), 0)) || ({key})::VARCHAR"


def lat(key: str) -> str:
    return f"(({key}) * 7919 % 12000) / 100.0::DOUBLE - 60.0::DOUBLE"


def lon(key: str) -> str:
    return f"(({key}) * 104729 % 34000) / 100.0::DOUBLE - 170.0::DOUBLE"


def km(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = EARTH) -> str:
    a = (
        f"power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * power(sin((radians({lon2}) - radians({lon1})) / 2), 2)"
    )
    return f"2 * {radius}::DOUBLE * asin(sqrt(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {a}))))"


def two_sided_p(z: str) -> str:
    x = f"abs({z})"

    def polynomial(coefficients: tuple[float, ...]) -> str:
        text = f"{coefficients[0]!r}::DOUBLE"
        for c in coefficients[1:]:
            text = f"({text} * {x} + {c!r}::DOUBLE)"
        return text

    density = f"exp(-{x} * {x} / 2)"
    fraction = f"({x} + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        fraction = f"({x} + {k} / {fraction})"
    near = f"{density} * {polynomial(TAIL_NUMERATOR)} / {polynomial(TAIL_DENOMINATOR)}"
    far = f"{density} / {fraction} / {SQRT_TWO_PI}::DOUBLE"
    return f"2 * (CASE WHEN {x} < {TAIL_SWITCH}::DOUBLE THEN {near} ELSE {far} END)"


def hotspot_class(z: str, p: str) -> str:
    side = f"(CASE WHEN {z} > 0 THEN 'Hot spot ' ELSE 'Cold spot ' END)"
    return (
        f"CASE WHEN {z} IS NULL THEN NULL WHEN {p} < 0.01 THEN {side} || '99%' WHEN {p} < 0.05 THEN {side} || '95%'"
        f" WHEN {p} < 0.10 THEN {side} || '90%' ELSE 'Not significant' END"
    )


def calendar_day(date: str) -> str:
    return f"dayofyear(make_date(2000, month({date}), day({date})))"


def year_days(year: str) -> str:
    return f"dayofyear(make_date({year}, 12, 31))"


# ---- shared tables ---------------------------------------------------------


def day_obs(grain: str) -> str:
    key, join = {
        "nation": ("s_nationkey", ""),
        "region": ("n_regionkey", "JOIN nation ON s_nationkey = n_nationkey"),
    }[grain]
    return f"""
day_obs AS (
  SELECT {sid(key)} AS station_id, l_shipdate::DATE AS date,
         max(l_extendedprice) AS tmax, min(l_extendedprice) AS tmin,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0::DOUBLE END) AS prcp
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey {join}
  GROUP BY 1, 2)"""


LONG_OBS = """
long_obs AS (
  SELECT station_id, date, 'TMAX' AS element, tmax AS value FROM day_obs
  UNION ALL SELECT station_id, date, 'TMIN', tmin FROM day_obs
  UNION ALL SELECT station_id, date, 'PRCP', prcp FROM day_obs)"""


def base(r: ClimateConfig) -> str:
    return f"""
base AS (
  SELECT *, {calendar_day('date')} AS cd FROM day_obs
  WHERE date BETWEEN DATE '{r.baseline_start}' AND DATE '{r.baseline_end}'),
offs AS (SELECT unnest(range(-{r.window_days}, {r.window_days + 1})) AS o)"""


def window(r: ClimateConfig) -> str:
    return f"""
win AS (
  SELECT station_id, ((cd - 1 + o + 366) % 366 + 1)::INTEGER AS target_calendar_day,
         quantile_disc(tmax, {r.hot_percentile}) AS tmax_threshold,
         quantile_disc(tmin, {r.cold_percentile}) AS tmin_threshold
  FROM base, offs GROUP BY 1, 2)"""


def rain(r: ClimateConfig) -> str:
    return f"""
rain AS (
  SELECT station_id, quantile_disc(prcp, {r.rain_percentile}) AS prcp_threshold
  FROM base WHERE prcp >= {r.wet_day_mm} GROUP BY 1)"""


def limits(r: ClimateConfig) -> str:
    return f"""
{window(r).strip()},
{rain(r).strip()},
cal AS (SELECT unnest(range(1, 367))::INTEGER AS target_calendar_day),
rain_cal AS (SELECT station_id, target_calendar_day, prcp_threshold FROM rain, cal),
limits AS (
  SELECT coalesce(w.station_id, c.station_id) AS station_id,
         coalesce(w.target_calendar_day, c.target_calendar_day) AS target_calendar_day,
         tmax_threshold, tmin_threshold, prcp_threshold
  FROM win w FULL JOIN rain_cal c
    ON w.station_id = c.station_id AND w.target_calendar_day = c.target_calendar_day),
means AS (
  SELECT station_id, ((cd - 1 + o + 366) % 366 + 1)::INTEGER AS target_calendar_day,
         avg(tmax) AS baseline_mean_tmax, count(*) AS n_obs
  FROM base, offs WHERE tmax IS NOT NULL GROUP BY 1, 2)"""


def flagged(r: ClimateConfig) -> str:
    return f"""
flagged AS (
  SELECT d.station_id, d.date, tmax, tmin, prcp, tmax_threshold, tmin_threshold, prcp_threshold,
         baseline_mean_tmax, l.station_id IS NOT NULL AS has_thresholds,
         CASE WHEN tmax > tmax_threshold THEN 1 ELSE 0 END AS hot_flag,
         CASE WHEN tmin < tmin_threshold THEN 1 ELSE 0 END AS cold_flag,
         CASE WHEN prcp < {r.wet_day_mm} THEN 1 ELSE 0 END AS dry_flag,
         CASE WHEN prcp > prcp_threshold THEN 1 ELSE 0 END AS rain_flag
  FROM day_obs d
  LEFT JOIN limits l ON d.station_id = l.station_id AND {calendar_day('d.date')} = l.target_calendar_day
  LEFT JOIN means m ON d.station_id = m.station_id AND {calendar_day('d.date')} = m.target_calendar_day)"""


def events(r: ClimateConfig) -> str:
    return f"""
qualifying AS (
  SELECT station_id, date, 'HEATWAVE' AS event_type, tmax - tmax_threshold AS excess FROM flagged WHERE hot_flag = 1 AND has_thresholds
  UNION ALL SELECT station_id, date, 'COLD_SNAP', tmin_threshold - tmin FROM flagged WHERE cold_flag = 1 AND has_thresholds
  UNION ALL SELECT station_id, date, 'DRY_SPELL', {r.wet_day_mm}::DOUBLE - prcp FROM flagged WHERE dry_flag = 1 AND has_thresholds),
islands AS (
  SELECT *, date - (row_number() OVER (PARTITION BY station_id, event_type ORDER BY date))::INTEGER AS island FROM qualifying),
runs AS (
  SELECT station_id, event_type, min(date) AS start_date, max(date) AS end_date, count(*) AS duration_days,
         sum(excess) AS total_excess, max(excess) AS peak_excess
  FROM islands GROUP BY station_id, event_type, island),
long_runs AS (
  SELECT * FROM runs WHERE duration_days >= CASE event_type
    WHEN 'HEATWAVE' THEN {r.heat_min_days} WHEN 'COLD_SNAP' THEN {r.cold_min_days} ELSE {r.dry_min_days} END),
heavy AS (
  SELECT station_id, 'HEAVY_RAIN' AS event_type, date AS start_date, date AS end_date, 1::BIGINT AS duration_days,
         prcp - prcp_threshold AS intensity_value, 'rainfall excess (mm)' AS intensity_measure
  FROM flagged WHERE rain_flag = 1 AND has_thresholds),
overlap_spans AS (
  SELECT h.station_id, greatest(h.start_date, d.start_date) AS start_date, least(h.end_date, d.end_date) AS end_date
  FROM long_runs h JOIN long_runs d ON h.station_id = d.station_id AND h.event_type = 'HEATWAVE'
   AND d.event_type = 'DRY_SPELL' AND h.start_date <= d.end_date AND d.start_date <= h.end_date),
compound AS (
  SELECT station_id, 'COMPOUND_HEATWAVE_DRY_SPELL' AS event_type, start_date, end_date,
         (end_date - start_date + 1)::BIGINT AS duration_days,
         (end_date - start_date + 1)::DOUBLE AS intensity_value, 'overlap duration (days)' AS intensity_measure
  FROM overlap_spans),
ev AS (
  SELECT station_id, event_type, start_date, end_date, duration_days,
         CASE WHEN event_type = 'DRY_SPELL' THEN duration_days::DOUBLE ELSE peak_excess END AS intensity_value,
         CASE event_type WHEN 'HEATWAVE' THEN 'max TMAX exceedance (degrees_C)'
           WHEN 'COLD_SNAP' THEN 'max TMIN deficit (degrees_C)' ELSE 'duration (days)' END AS intensity_measure
  FROM long_runs
  UNION ALL SELECT * FROM heavy
  UNION ALL SELECT * FROM compound)"""


STATIONS = f"""
stations AS (
  SELECT {sid('n_nationkey')} AS station_id, n_name AS station_name,
         {lat('n_nationkey')} AS lat, {lon('n_nationkey')} AS lon,
         CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE n_nationkey * 10.5::DOUBLE END AS elevation_m,
         n_name AS region_name,
         CASE WHEN r_name = 'AMERICA' THEN 'United States' ELSE r_name END AS country, r_name AS continent
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def panel(r: ClimateConfig) -> str:
    def metric(event_type: str, prefix: str) -> str:
        return (
            f"count(*) FILTER (WHERE event_type = '{event_type}') AS {prefix}_count, "
            f"(sum(duration_days) FILTER (WHERE event_type = '{event_type}'))::BIGINT AS {prefix}_days"
        )

    def known(name: str) -> str:
        return f"CASE WHEN cov.station_id IS NOT NULL THEN coalesce({name}, 0) END"

    return f"""
ev_year AS (
  SELECT station_id, year(start_date) AS year,
         {metric('HEATWAVE', 'heatwave')}, {metric('COLD_SNAP', 'coldsnap')},
         {metric('DRY_SPELL', 'dry_spell')}, {metric('COMPOUND_HEATWAVE_DRY_SPELL', 'compound')},
         max(intensity_value) FILTER (WHERE event_type = 'HEATWAVE') AS heatwave_max_intensity
  FROM ev GROUP BY 1, 2),
dry_islands AS (
  SELECT station_id, date, date - (row_number() OVER (PARTITION BY station_id ORDER BY date))::INTEGER AS island
  FROM flagged WHERE dry_flag = 1),
dry_runs AS (SELECT station_id, min(date) AS start_date, count(*) AS n FROM dry_islands GROUP BY station_id, island),
dry_year AS (SELECT station_id, year(start_date) AS year, max(n) AS longest_dry_spell FROM dry_runs GROUP BY 1, 2),
cov AS (
  SELECT station_id, count(tmax_threshold) AS tx, count(tmin_threshold) AS tn, count(prcp_threshold) AS pr
  FROM limits GROUP BY 1),
day_year AS (
  SELECT station_id, year(date) AS year,
         round(count(*) FILTER (WHERE tmax IS NOT NULL AND tmin IS NOT NULL AND prcp IS NOT NULL)
               / max({year_days('year(date)')}) * 100.0::DOUBLE, 2) AS days_present_pct,
         sum(hot_flag)::BIGINT AS hot, sum(cold_flag)::BIGINT AS cold, sum(rain_flag)::BIGINT AS wet,
         max(prcp) AS max_daily_prcp_mm, sum(prcp) AS prcp_total_mm, count(prcp) AS prcp_days,
         round(avg(tmax - baseline_mean_tmax), 3) AS tmax_anomaly_mean
  FROM flagged GROUP BY 1, 2),
table_a AS (
  SELECT y.station_id, station_name, lat, lon, elevation_m, region_name, country, continent, y.year, days_present_pct,
         CASE WHEN tx = 366 THEN hot END AS hot_days,
         {known('heatwave_count')} AS heatwave_count, {known('heatwave_days')} AS heatwave_days,
         heatwave_max_intensity, CASE WHEN tn = 366 THEN cold END AS cold_days,
         {known('coldsnap_count')} AS coldsnap_count, {known('coldsnap_days')} AS coldsnap_days,
         CASE WHEN pr = 366 THEN wet END AS heavy_rain_days, max_daily_prcp_mm, prcp_total_mm,
         {known('dry_spell_count')} AS dry_spell_count, {known('dry_spell_days')} AS dry_spell_days,
         CASE WHEN prcp_days > 0 THEN {known('longest_dry_spell')} END AS longest_dry_spell,
         {known('compound_count')} AS compound_event_count, {known('compound_days')} AS compound_days,
         tmax_anomaly_mean
  FROM day_year y
  LEFT JOIN ev_year e ON y.station_id = e.station_id AND y.year = e.year
  LEFT JOIN dry_year d ON y.station_id = d.station_id AND y.year = d.year
  LEFT JOIN cov ON y.station_id = cov.station_id
  LEFT JOIN stations s ON y.station_id = s.station_id)"""


def unpivot_a(columns: str = "*", where: str = "TRUE") -> str:
    parts = [
        f"SELECT {columns}, '{e}' AS event_type, {m}::DOUBLE AS value FROM table_a WHERE {where}"
        for e, m in TREND_MEASURES.items()
    ]
    return " UNION ALL ".join(parts)


def trend(r: ClimateConfig) -> str:
    in_window = f"year BETWEEN {r.trend_first_year} AND {r.trend_last_year} AND days_present_pct >= {r.valid_year_pct}"
    z = "(CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE (s - sign(s)) / sqrt(var) END)"
    return f"""
types AS (SELECT unnest([{', '.join(f"'{e}'" for e in TREND_MEASURES)}]) AS event_type),
vals AS (SELECT station_id, year, event_type, value FROM ({unpivot_a('station_id, year', in_window)}) WHERE value IS NOT NULL),
used AS (SELECT station_id, event_type, count(*)::INTEGER AS n, avg(value) AS level FROM vals GROUP BY 1, 2),
pairs AS (
  SELECT a.station_id, a.event_type, (b.value - a.value) / (b.year - a.year) AS slope, sign(b.value - a.value)::BIGINT AS sg
  FROM vals a JOIN vals b ON a.station_id = b.station_id AND a.event_type = b.event_type AND a.year < b.year),
tests AS (SELECT station_id, event_type, median(slope) AS slope, sum(sg)::BIGINT AS s FROM pairs GROUP BY 1, 2),
ties AS (
  SELECT station_id, event_type, sum(t * (t - 1) * (2 * t + 5)) AS tied
  FROM (SELECT station_id, event_type, value, count(*) AS t FROM vals GROUP BY 1, 2, 3) GROUP BY 1, 2),
tested AS (
  SELECT t.station_id, t.event_type, slope, s, (n * (n - 1) * (2 * n + 5) - tied) / 18.0::DOUBLE AS var
  FROM tests t JOIN used u ON t.station_id = u.station_id AND t.event_type = u.event_type
  JOIN ties i ON t.station_id = i.station_id AND t.event_type = i.event_type),
newest AS (SELECT station_id, max(year) AS year FROM table_a GROUP BY 1),
table_b AS (
  SELECT a.station_id, lat, lon, region_name, country, continent, y.event_type,
         CASE WHEN coalesce(n, 0) >= {r.min_trend_years} THEN round_even(slope * 10, 3) END AS trend_slope,
         CASE WHEN coalesce(n, 0) >= {r.min_trend_years} THEN round_even({two_sided_p(z)}, 4) END AS trend_p_value,
         coalesce(n, 0) AS years_used, coalesce(n, 0) >= {r.min_trend_years} AS trend_eligible
  FROM newest w JOIN table_a a ON w.station_id = a.station_id AND w.year = a.year CROSS JOIN types y
  LEFT JOIN used u ON a.station_id = u.station_id AND y.event_type = u.event_type
  LEFT JOIN tested t ON a.station_id = t.station_id AND y.event_type = t.event_type)"""


def risk() -> str:
    def share(column: str) -> str:
        ties = f"count(*) OVER (PARTITION BY event_type, {column})"
        low = f"rank() OVER (PARTITION BY event_type ORDER BY {column})"
        return (
            f"CASE WHEN n = 1 THEN 0.5::DOUBLE ELSE ({low} + ({ties} - 1) / 2.0::DOUBLE - 1) / (n - 1) END"
        )

    return f"""
ranked AS (
  SELECT b.station_id, b.event_type, lat, lon, trend_slope, level
  FROM table_b b JOIN used u ON b.station_id = u.station_id AND b.event_type = u.event_type WHERE trend_eligible),
profile AS (
  SELECT event_type, count(*) AS n, min(level) = max(level) AS same_level, min(trend_slope) = max(trend_slope) AS same_slope
  FROM ranked GROUP BY 1),
shares AS (
  SELECT station_id, r.event_type, {share('level')} AS lr, {share('trend_slope')} AS sr
  FROM ranked r JOIN (SELECT event_type AS et, n FROM profile WHERE NOT (same_level AND same_slope)) p ON r.event_type = p.et),
scores AS (SELECT station_id, event_type, 100.0::DOUBLE * (0.6::DOUBLE * lr + 0.4::DOUBLE * sr) AS score FROM shares),
scored AS (
  SELECT station_id, event_type, round_even(score, 1) AS risk_score,
         rank() OVER (PARTITION BY event_type ORDER BY score DESC)::INTEGER AS risk_rank FROM scores)"""


def neighbours(points: str, k: int) -> str:
    """Brute-force neighbours, Gi* and Moran's I of (event_type, station_id, lat, lon, level)."""
    distance = f"round({km('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6)"
    return f"""
pts AS ({points}),
edges AS (
  SELECT event_type, i, j, distance_km, position::INTEGER AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type, i ORDER BY distance_km, j) AS position FROM (
      SELECT a.event_type, a.station_id AS i, b.station_id AS j, {distance} AS distance_km
      FROM pts a JOIN pts b ON a.event_type = b.event_type AND a.station_id <> b.station_id)) WHERE position <= {k})"""


GI_MORAN = f"""
mom AS (
  SELECT event_type, count(*)::DOUBLE AS n, avg(level) AS mean, var_pop(level) AS variance FROM pts GROUP BY 1
  HAVING min(level) <> max(level)),
around AS (
  SELECT event_type, i, j FROM edges UNION ALL SELECT event_type, station_id, station_id FROM pts),
local AS (
  SELECT a.event_type, a.i, sum(p.level) AS total, count(*)::DOUBLE AS w
  FROM around a JOIN pts p ON a.event_type = p.event_type AND a.j = p.station_id GROUP BY 1, 2),
gi AS (
  SELECT l.event_type, i AS station_id, (total - mean * w) / sqrt(variance * (n * w - w * w) / (n - 1)) AS gi_z
  FROM local l JOIN mom m ON l.event_type = m.event_type),
dev AS (SELECT p.event_type, station_id, level - mean AS z FROM pts p JOIN mom m ON p.event_type = m.event_type),
deg AS (SELECT event_type, i, count(*) AS d FROM edges GROUP BY 1, 2),
wts AS (SELECT e.event_type, e.i, e.j, 1.0::DOUBLE / d AS w FROM edges e JOIN deg g ON e.event_type = g.event_type AND e.i = g.i),
lagged AS (
  SELECT w.event_type, sum(w * a.z * b.z) AS num, sum(w) AS s0
  FROM wts w JOIN dev a ON w.event_type = a.event_type AND w.i = a.station_id
  JOIN dev b ON w.event_type = b.event_type AND w.j = b.station_id GROUP BY 1),
sym AS (
  SELECT event_type, i, j, sum(w) AS w FROM (
    SELECT event_type, i, j, w FROM wts UNION ALL SELECT event_type, j, i, w FROM wts) GROUP BY 1, 2, 3),
ss1 AS (SELECT event_type, sum(w * w) / 2 AS s1 FROM sym GROUP BY 1),
ss2 AS (
  SELECT event_type, sum(t * t) AS s2 FROM (SELECT event_type, i, sum(w) AS t FROM sym GROUP BY 1, 2) GROUP BY 1),
mz AS (SELECT event_type, sum(z * z) AS m2, sum(z * z * z * z) AS m4 FROM dev GROUP BY 1),
mi AS (
  SELECT m.event_type, n, n / s0 * num / m2 AS i_val, -1.0::DOUBLE / (n - 1) AS e_val,
         (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0)
          - (m4 / n) / (m2 / n * (m2 / n)) * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0))
         / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - 1.0::DOUBLE / ((n - 1) * (n - 1)) AS v_val
  FROM mom m JOIN lagged l ON m.event_type = l.event_type JOIN ss1 ON m.event_type = ss1.event_type
  JOIN ss2 ON m.event_type = ss2.event_type JOIN mz ON m.event_type = mz.event_type),
moran AS (SELECT event_type, i_val AS morans_i, {two_sided_p('((i_val - e_val) / sqrt(v_val))')} AS morans_p FROM mi)"""

SUPPLIER_POINTS = (
    f"SELECT CASE WHEN s_acctbal < 3000 THEN 'low' ELSE 'high' END AS event_type, {sid('s_suppkey')} AS station_id, {lat('s_suppkey')} AS lat, "
    f"{lon('s_suppkey')} AS lon, s_acctbal AS level FROM supplier"
)

RANKED_POINTS = (
    "SELECT r.event_type, station_id, lat, lon, level FROM ranked r JOIN profile p ON r.event_type = p.event_type "
    "WHERE n >= 10 AND NOT same_level AND lat IS NOT NULL AND lon IS NOT NULL"
)

TABLE_BC = f"""
filled AS (
  SELECT b.*, risk_score, risk_rank, round_even(gi_z, 3) AS gi_z_score,
         round_even({two_sided_p('gi_z')}, 4) AS gi_p_value, {hotspot_class('gi_z', two_sided_p('gi_z'))} AS hotspot_class
  FROM table_b b
  LEFT JOIN scored s ON b.station_id = s.station_id AND b.event_type = s.event_type
  LEFT JOIN gi g ON b.station_id = g.station_id AND b.event_type = g.event_type),
table_c AS (
  SELECT t.event_type, round_even(morans_i, 4) AS morans_i, round_even(morans_p, 4) AS morans_p_value,
         coalesce(p.n, 0) AS n_stations
  FROM types t LEFT JOIN profile p ON t.event_type = p.event_type LEFT JOIN moran m ON t.event_type = m.event_type)"""

SEASON = "CASE WHEN month(start_date) IN (12, 1, 2) THEN 'DJF' WHEN month(start_date) IN (3, 4, 5) THEN 'MAM' WHEN month(start_date) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"
SHORT = "CASE event_type WHEN 'HEATWAVE' THEN 'heatwave' WHEN 'COLD_SNAP' THEN 'cold' WHEN 'HEAVY_RAIN' THEN 'heavy_rain' WHEN 'DRY_SPELL' THEN 'dry_spell' ELSE 'compound' END"
LABEL = "CASE event_type WHEN 'hot_days' THEN 'Warm days' WHEN 'heatwave' THEN 'Warm spells' WHEN 'cold' THEN 'Cold snaps' WHEN 'heavy_rain' THEN 'Heavy rain' WHEN 'dry_spell' THEN 'Dry spells' ELSE 'Compound' END"

PHASES = """
monthly AS (
  SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month,
         round((count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0::DOUBLE / count(*) - 33.0::DOUBLE) / 2.0::DOUBLE, 2) AS nino34_anomaly
  FROM orders GROUP BY 1, 2),
signed AS (
  SELECT *, ['DJF','JFM','FMA','MAM','AMJ','MJJ','JJA','JAS','ASO','SON','OND','NDJ'][month] AS season,
         CASE WHEN nino34_anomaly >= 0.5 THEN 1 WHEN nino34_anomaly <= -0.5 THEN -1 ELSE 0 END AS sg FROM monthly),
marks AS (
  SELECT *, CASE WHEN sg = lag(sg) OVER (ORDER BY year, month) THEN 0 ELSE 1 END AS ch FROM signed),
run_ids AS (SELECT *, sum(ch) OVER (ORDER BY year, month) AS run FROM marks),
phases AS (
  SELECT year, month, season, nino34_anomaly,
         CASE WHEN count(*) OVER (PARTITION BY run) >= 5 AND sg = 1 THEN 'El Nino'
              WHEN count(*) OVER (PARTITION BY run) >= 5 AND sg = -1 THEN 'La Nina' ELSE 'Neutral' END AS enso_phase,
         sg <> 0 AND count(*) OVER (PARTITION BY run) < 5 AND run = max(run) OVER () AS provisional
  FROM run_ids)"""


def farthest(picks: int) -> str:
    """Farthest-point choice unrolled: every step keeps the distance to the nearest pick."""
    parts = [
        f"pts AS (SELECT {sid('s_suppkey')} AS station_id, {lat('s_suppkey')} AS lat, {lon('s_suppkey')} AS lon FROM supplier)",
        "p1 AS (SELECT * FROM pts ORDER BY station_id LIMIT 1)",
        "n0 AS (SELECT *, 'inf'::DOUBLE AS near FROM pts)",
    ]
    for i in range(1, picks):
        away = km("n.lat", "n.lon", "p.lat", "p.lon")
        parts.append(
            f"n{i} AS (SELECT n.station_id, n.lat, n.lon, least(near, {away}) AS near FROM n{i - 1} n, p{i} p WHERE n.station_id <> p.station_id)"
        )
        parts.append(f"p{i + 1} AS (SELECT station_id, lat, lon FROM n{i} ORDER BY near DESC, station_id LIMIT 1)")
    return with_(*parts, select=" UNION ALL ".join(f"SELECT station_id, {i} AS pick_order FROM p{i}" for i in range(1, picks + 1)))


def storm_days() -> str:
    kinds = " ".join(
        f"WHEN event_type IN ({', '.join(repr(t) for t in theirs)}) THEN '{name}'"
        for name, (_, theirs) in STORM_CATEGORIES.items()
    )
    return f"""
records AS (
  SELECT upper(n_name) AS state, o_orderdate::DATE AS b, o_orderdate::DATE + (o_orderkey % 3 + CASE WHEN o_orderkey % 97 = 0 THEN 150 ELSE 0 END)::INTEGER AS e,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Heat' WHEN '2' THEN 'Flood' WHEN '3' THEN 'Drought'
           WHEN '4' THEN 'Frost/Freeze' ELSE 'Hail' END AS event_type, year(o_orderdate) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
storm_days AS (
  SELECT DISTINCT CASE {kinds} END AS category, state,
         unnest(generate_series(b, e, INTERVAL 1 DAY))::DATE AS day
  FROM records WHERE event_type <> 'Hail')"""


def _statements() -> dict[str, str]:
    n, r = NATION_RULES, REGION_RULES
    nation, region = day_obs("nation"), day_obs("region")
    to_flags = (nation, base(n), limits(n), flagged(n))
    to_events = (*to_flags, events(n))
    to_a = (*to_events, STATIONS, panel(n))
    to_b = (*to_a, trend(n))
    to_risk = (*to_b, risk())
    to_c = (*to_risk, neighbours(RANKED_POINTS, 5), GI_MORAN, TABLE_BC)
    to_supplier = (neighbours(SUPPLIER_POINTS, 5), GI_MORAN)
    complete_a = f"days_present_pct >= {n.valid_year_pct}"
    shown = f"vals_a AS ({unpivot_a('station_id, region_name, country, continent, year', complete_a)})"
    table_e = f"table_e AS (SELECT station_id, {SHORT} AS event_type, start_date, end_date, duration_days, intensity_value, intensity_measure, year(start_date) AS year FROM ev)"
    seasons = f"""
seasons AS (
  SELECT e.station_id, e.year, {SEASON} AS season, event_type, count(*) AS events, sum(duration_days)::BIGINT AS event_days,
         max(intensity_value) AS max_intensity
  FROM table_e e JOIN table_a a ON e.station_id = a.station_id AND e.year = a.year AND {complete_a} GROUP BY 1, 2, 3, 4)"""

    def profile(c: ClimateConfig, name: str = "prof") -> str:
        inside = f"date BETWEEN DATE '{c.baseline_start}' AND DATE '{c.baseline_end}'"
        counts = ", ".join(f"count({e}) FILTER (WHERE {inside}) AS d_{e}" for e in ("tmax", "tmin", "prcp"))
        return f"""
{name} AS (
  SELECT *, round(complete_days / {year_days('year')} * 100.0::DOUBLE, 2) AS pct FROM (
    SELECT station_id, year(date) AS year, count(*) FILTER (WHERE tmax IS NOT NULL AND tmin IS NOT NULL AND prcp IS NOT NULL) AS complete_days, {counts}
    FROM day_obs GROUP BY 1, 2))"""

    def eligibility(c: ClimateConfig, source: str = "prof", name: str = "elig") -> str:
        first, last = c.baseline_years
        enough = " AND ".join(f"sum(d_{e}) / {c.baseline_days} >= {c.element_completeness}" for e in ("tmax", "tmin", "prcp"))
        return f"""
{name} AS (
  SELECT *, meets_80_all_variables AND baseline_valid_years >= {c.min_baseline_valid_years} AS baseline_eligible,
         valid_years_1995_2001 >= {c.min_trend_years} AS enough_years_for_trend FROM (
    SELECT station_id, count(*) FILTER (WHERE pct >= {c.valid_year_pct} AND year BETWEEN {first} AND {last}) AS baseline_valid_years,
           count(*) FILTER (WHERE pct >= {c.valid_year_pct} AND year BETWEEN {c.trend_first_year} AND {c.trend_last_year}) AS valid_years_1995_2001,
           {enough} AS meets_80_all_variables,
           sum(d_tmax)::BIGINT AS baseline_days_tmax, sum(d_tmin)::BIGINT AS baseline_days_tmin, sum(d_prcp)::BIGINT AS baseline_days_prcp
    FROM {source} GROUP BY 1))"""

    six = "station_id, baseline_valid_years, valid_years_1995_2001, meets_80_all_variables, baseline_eligible, enough_years_for_trend"
    definition = (
        "CASE element WHEN 'TMAX' THEN '70th percentile of baseline TMAX' WHEN 'TMIN' THEN '30th percentile of baseline TMIN' "
        "ELSE '75th percentile of baseline wet-day PRCP (>= 10 mm), annual per station' END"
    )
    long_limits = """
long_limits AS (
  SELECT station_id, 'TMAX' AS element, target_calendar_day, tmax_threshold AS threshold FROM limits WHERE tmax_threshold IS NOT NULL
  UNION ALL SELECT station_id, 'TMIN', target_calendar_day, tmin_threshold FROM limits WHERE tmin_threshold IS NOT NULL
  UNION ALL SELECT station_id, 'PRCP', target_calendar_day, prcp_threshold FROM limits WHERE prcp_threshold IS NOT NULL)"""
    supplier_series = "vals AS (SELECT l_suppkey, year(l_shipdate) AS year, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
    supplier_pairs = """
pairs AS (
  SELECT a.l_suppkey, (b.value - a.value) / (b.year - a.year) AS slope, sign(b.value - a.value)::BIGINT AS sg
  FROM vals a JOIN vals b ON a.l_suppkey = b.l_suppkey AND a.year < b.year)"""
    mk_z = "(CASE WHEN mk_s = 0 THEN 0.0::DOUBLE ELSE (mk_s - sign(mk_s)) / sqrt(mk_variance) END)"
    results = f"""
results AS (
  SELECT {sid('s_suppkey')} AS station_id, {lat('s_suppkey')} AS lat, {lon('s_suppkey')} AS lon, years, busy, first_year, last_year,
         floor(({lat('s_suppkey')}) / 30.0::DOUBLE)::INTEGER AS lat_cell, floor(({lon('s_suppkey')}) / 30.0::DOUBLE)::INTEGER AS lon_cell
  FROM supplier JOIN (
    SELECT l_suppkey, count(*) AS years, count(*) FILTER (WHERE lines >= 90) AS busy, min(year)::INTEGER AS first_year, max(year)::INTEGER AS last_year
    FROM (SELECT l_suppkey, year(l_shipdate) AS year, count(*) AS lines FROM lineitem GROUP BY 1, 2) GROUP BY 1) ON s_suppkey = l_suppkey)"""
    order = "ORDER BY years DESC, busy DESC, station_id"
    picks = f"""
ok AS (SELECT * FROM results WHERE years >= 7),
first_pick AS (SELECT *, 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY lat_cell, lon_cell {order}) AS rn FROM ok) WHERE rn = 1),
far AS (
  SELECT o.* FROM ok o JOIN first_pick f ON o.lat_cell = f.lat_cell AND o.lon_cell = f.lon_cell
  WHERE o.station_id <> f.station_id AND {km('o.lat', 'o.lon', 'f.lat', 'f.lon')} >= 600),
second_pick AS (SELECT *, 2 AS place FROM (SELECT *, row_number() OVER (PARTITION BY lat_cell, lon_cell {order}) AS rn FROM far) WHERE rn = 1),
picked AS (SELECT * FROM first_pick UNION ALL SELECT * FROM second_pick)"""
    q: dict[str, str] = {}

    q["obs_wide"] = with_(region, select="SELECT * FROM day_obs")
    q["obs_quality_filter"] = """SELECT event_id, ts::DATE AS date, value AS raw_value FROM events
WHERE ts IS NOT NULL AND value IS NOT NULL AND value <> -9999 AND event_type <> 'error'"""
    expected = n.baseline_days
    q["completeness_by_station"] = with_(nation, base(n), LONG_OBS, select=f"""
SELECT station_id, element, count(DISTINCT date) AS observed_days, {expected} AS expected_days,
       round(count(DISTINCT date) / {expected} * 100.0::DOUBLE, 2) AS completeness_percent,
       CASE WHEN count(DISTINCT date) / {expected} >= {n.element_completeness} THEN 'YES' ELSE 'NO' END AS meets_80_percent
FROM long_obs WHERE date BETWEEN DATE '{n.baseline_start}' AND DATE '{n.baseline_end}' GROUP BY 1, 2""")
    q["valid_years"] = with_(region, profile(r), select=f"""
SELECT station_id, year::INTEGER AS year, complete_days, pct AS days_present_pct FROM prof WHERE pct >= {r.valid_year_pct}""")
    q["station_eligibility"] = with_(nation, profile(n), eligibility(n), select=f"SELECT {six} FROM elig")
    q["station_scores"] = with_(region, profile(r), eligibility(r), select="SELECT * FROM elig")

    q["threshold_calendar_window"] = with_(region, base(r), window(r), select="SELECT * FROM win")
    q["threshold_exact"] = with_(region, base(r), window(r), rain(r), select="""
SELECT w.*, prcp_threshold FROM win w LEFT JOIN rain r ON w.station_id = r.station_id""")
    q["threshold_annual_wet"] = with_(nation, base(n), rain(n), select="SELECT * FROM rain")
    q["thresholds_all"] = with_(nation, base(n), limits(n), long_limits, select=f"""
SELECT station_id, element, target_calendar_day, threshold, CASE WHEN element = 'PRCP' THEN 'mm' ELSE 'degrees_C' END AS threshold_unit,
       {definition} AS threshold_definition, '{n.baseline_start}' AS baseline_start, '{n.baseline_end}' AS baseline_end,
       7 AS window_days_each_side, 366 AS calendar_days FROM long_limits""")
    q["thresholds_of_eligible"] = with_(nation, base(n), limits(n), profile(n), eligibility(n), select="""
SELECT l.station_id, count(tmax_threshold) AS tmax_threshold_days, count(tmin_threshold) AS tmin_threshold_days, count(prcp_threshold) AS prcp_threshold_days
FROM limits l JOIN elig e ON l.station_id = e.station_id WHERE baseline_eligible GROUP BY 1""")
    q["baseline_calendar_mean"] = with_(region, base(r), limits(r), select="""
SELECT station_id, target_calendar_day, round(baseline_mean_tmax * n_obs, 2) / n_obs AS baseline_mean_tmax, n_obs FROM means""")

    q["daily_flags"] = with_(*to_flags, select=f"""
SELECT station_id, date, hot_flag, cold_flag, dry_flag, rain_flag,
       CASE WHEN hot_flag = 1 THEN tmax - tmax_threshold END AS heat_excess, CASE WHEN cold_flag = 1 THEN tmin_threshold - tmin END AS cold_deficit,
       CASE WHEN rain_flag = 1 THEN prcp - prcp_threshold END AS rain_excess, CASE WHEN dry_flag = 1 THEN {n.wet_day_mm}::DOUBLE - prcp END AS rain_deficit
FROM flagged WHERE has_thresholds""")
    q["heat_runs"] = with_(region, base(r), f"""
cuts AS (SELECT station_id, quantile_disc(tmax, {r.hot_percentile}) AS cut FROM base GROUP BY 1),
hot AS (
  SELECT d.station_id, date, tmax - cut AS excess, date - (row_number() OVER (PARTITION BY d.station_id ORDER BY date))::INTEGER AS island
  FROM day_obs d JOIN cuts c ON d.station_id = c.station_id WHERE tmax > cut)""", select="""
SELECT station_id, min(date) AS start_date, max(date) AS end_date, count(*) AS duration_days, round(max(excess), 2) AS intensity_value
FROM hot GROUP BY station_id, island HAVING count(*) >= 3""")
    for name, event_type in (
        ("heat_events", "HEATWAVE"), ("cold_events", "COLD_SNAP"), ("dry_events", "DRY_SPELL"),
        ("heavy_rain_days", "HEAVY_RAIN"), ("compound_overlap", "COMPOUND_HEATWAVE_DRY_SPELL"),
    ):
        q[name] = with_(*to_events, select=f"SELECT * FROM ev WHERE event_type = '{event_type}'")
    q["run_totals"] = with_(*to_events, select="""
SELECT station_id, event_type, start_date, duration_days, round(total_excess, 2) AS total_excess, round(peak_excess, 2) AS peak_excess,
       round(total_excess / duration_days, 6) AS mean_excess FROM runs
UNION ALL SELECT station_id, event_type, start_date, 1, round(intensity_value, 2), round(intensity_value, 2), round(intensity_value, 6) FROM heavy""")
    q["events_all"] = with_(*to_events, select="SELECT * FROM ev")
    q["events_by_year"] = with_(*to_a, select="SELECT * REPLACE (year::INTEGER AS year) FROM ev_year")
    q["station_events"] = with_(*to_events, table_e, select="SELECT * REPLACE (year::INTEGER AS year) FROM table_e")
    q["longest_dry_run"] = with_(*to_a, select="SELECT station_id, year::INTEGER AS year, longest_dry_spell FROM dry_year")

    q["station_year_metrics"] = with_(*to_a, select="SELECT * REPLACE (year::INTEGER AS year) FROM table_a")
    q["tmax_anomaly"] = with_(*to_a, select="SELECT station_id, year::INTEGER AS year, tmax_anomaly_mean, days_present_pct FROM day_year")
    q["trend_theil_sen"] = with_(supplier_series, supplier_pairs, select="""
SELECT l_suppkey, round(median(slope), 6) AS slope_per_year FROM pairs GROUP BY 1""")
    q["trend_decades"] = with_("""
vals AS (SELECT l_suppkey, year(l_shipdate)::INTEGER AS year, count(*) / 160.0::DOUBLE AS value FROM lineitem GROUP BY 1, 2)""", supplier_pairs, select="""
SELECT l_suppkey, round_even(median(slope) * 10, 3) AS trend_slope FROM pairs GROUP BY 1""")
    q["mann_kendall"] = with_(supplier_series, supplier_pairs, f"""
sums AS (SELECT l_suppkey, sum(sg)::BIGINT AS mk_s FROM pairs GROUP BY 1),
sizes AS (SELECT l_suppkey, count(*) AS n FROM vals GROUP BY 1),
ties AS (SELECT l_suppkey, sum(t * (t - 1) * (2 * t + 5)) AS tied FROM (SELECT l_suppkey, value, count(*) AS t FROM vals GROUP BY 1, 2) GROUP BY 1),
stats AS (
  SELECT z.l_suppkey, coalesce(mk_s, 0) AS mk_s, (n * (n - 1) * (2 * n + 5) - tied) / 18.0::DOUBLE AS mk_variance
  FROM sizes z LEFT JOIN sums s ON z.l_suppkey = s.l_suppkey JOIN ties t ON z.l_suppkey = t.l_suppkey),
zs AS (SELECT *, {mk_z} AS mk_z FROM stats)""", select=f"""
SELECT l_suppkey, mk_s, round(mk_variance, 6) AS mk_variance, round(mk_z, 6) AS mk_z, round({two_sided_p('mk_z')}, 6) AS mk_p FROM zs""")
    q["station_summary"] = with_(*to_b, select="SELECT * FROM table_b")
    q["latest_station_row"] = """SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"""

    q["station_levels"] = with_(*to_b, select="SELECT station_id, event_type, round(level, 6) AS level FROM used")
    q["risk_score"] = with_(*to_risk, select="SELECT * FROM scored")
    q["percentile_rank"] = """SELECT p_partkey, p_brand,
  round(CASE WHEN n = 1 THEN 0.5::DOUBLE ELSE (low + (ties - 1) / 2.0::DOUBLE - 1) / (n - 1) END, 6) AS share, place::INTEGER AS place
FROM (SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS low,
             rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS place,
             count(*) OVER (PARTITION BY p_brand, p_size) AS ties, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"""
    lanes = km(lat("s_nationkey"), lon("s_nationkey"), lat("c_nationkey"), lon("c_nationkey"))
    q["haversine_lanes"] = f"""SELECT s_nationkey, c_nationkey, lines, round({lanes}, 3) AS km FROM (
  SELECT s_nationkey, c_nationkey, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
    q["grid_cells"] = f"""SELECT floor(({lat('s_suppkey')}) / 10.0::DOUBLE)::INTEGER AS lat_cell,
  floor(({lon('s_suppkey')}) / 10.0::DOUBLE)::INTEGER AS lon_cell, count(*) AS points FROM supplier GROUP BY 1, 2"""
    q["knn_edges"] = with_(*to_supplier, select="SELECT event_type, i, j, round(distance_km, 3) AS distance_km, position FROM edges")
    q["gi_star"] = with_(*to_supplier, select=f"""
SELECT station_id, round(gi_z, 6) AS gi_z, round({two_sided_p('gi_z')}, 6) AS gi_p, {hotspot_class('gi_z', two_sided_p('gi_z'))} AS hotspot_class FROM gi""")
    classes = ", ".join(
        f"count(*) FILTER (WHERE c = '{label}') AS {name}" for label, name in HOTSPOT_COLUMNS.items()
    )
    q["hotspot_crosstab"] = with_(*to_supplier, f"""
classed AS (SELECT event_type, {hotspot_class('gi_z', two_sided_p('gi_z'))} AS c FROM gi)""", select=f"""
SELECT event_type, {classes} FROM classed WHERE c IS NOT NULL GROUP BY 1""")
    q["morans_i"] = with_(*to_supplier, select="""
SELECT event_type, round(morans_i, 6) AS morans_i, round(morans_p, 6) AS morans_p FROM moran""")
    q["graph_components"] = with_(neighbours(SUPPLIER_POINTS, 2), """
both_ways AS (SELECT i, j FROM edges UNION SELECT j, i FROM edges),
reach AS (SELECT station_id AS id, station_id AS other FROM pts UNION SELECT r.id, b.j FROM reach r JOIN both_ways b ON r.other = b.i)""",
        select="SELECT id, min(other) AS component FROM reach GROUP BY 1")
    q["summary_with_risk"] = with_(*to_c, select="SELECT * FROM filled")
    q["global_statistics"] = with_(*to_c, select="SELECT * FROM table_c")

    eight = "station_id, station_name, lat, lon, elevation_m, region_name, country, continent"
    tips = "heatwave_max_intensity, max_daily_prcp_mm, prcp_total_mm, tmax_anomaly_mean"
    q["long_unpivot"] = with_(*to_c, f"""
long_a AS ({unpivot_a(f'{eight}, year, days_present_pct, {tips}', complete_a)})""", select=f"""
SELECT l.*, {LABEL.replace('event_type', 'l.event_type')} AS event_label, trend_slope, trend_p_value, years_used, coalesce(trend_eligible, FALSE) AS trend_eligible,
       CASE WHEN NOT coalesce(trend_eligible, FALSE) THEN 'Not enough years' WHEN trend_p_value < 0.05 AND trend_slope > 0 THEN 'Increasing (p<0.05)'
            WHEN trend_p_value < 0.05 AND trend_slope < 0 THEN 'Decreasing (p<0.05)' ELSE 'Not significant' END AS trend_status,
       risk_score, risk_rank, gi_z_score, gi_p_value, hotspot_class, morans_i, morans_p_value, n_stations
FROM (SELECT * REPLACE (year::INTEGER AS year) FROM long_a) l LEFT JOIN filled f ON l.station_id = f.station_id AND l.event_type = f.event_type
LEFT JOIN table_c c ON l.event_type = c.event_type""")
    q["season_rollup"] = with_(*to_a, table_e, seasons, select=f"""
SELECT s.station_id, station_name, lat, lon, elevation_m, region_name, country, continent, year::INTEGER AS year, season, event_type,
       {LABEL} AS event_label, events, event_days, max_intensity
FROM seasons s JOIN stations t ON s.station_id = t.station_id""")
    yearly = " UNION ALL ".join(
        f"SELECT '{e}' AS event_type, station_id, year, {c}::BIGINT AS d FROM table_a WHERE {complete_a} AND {c} > 0"
        for e, c in (("heatwave", "heatwave_days"), ("cold", "coldsnap_days"), ("compound", "compound_days"),
                     ("heavy_rain", "heavy_rain_days"), ("dry_spell", "dry_spell_days"))
    )
    q["season_reconcile"] = with_(*to_a, table_e, seasons, f"""
mine AS (SELECT event_type, station_id, year, sum(event_days) AS d FROM seasons GROUP BY 1, 2, 3), theirs AS ({yearly})""", select="""
SELECT coalesce(m.event_type, t.event_type) AS event_type, count(*) AS station_years, count(*) FILTER (WHERE coalesce(m.d, 0) <> coalesce(t.d, 0)) AS differences
FROM mine m FULL JOIN theirs t ON m.event_type = t.event_type AND m.station_id = t.station_id AND m.year = t.year GROUP BY 1""")
    q["dashboard_station_map"] = with_(*to_a, shown, select="""
SELECT station_id, event_type, round(avg(value), 6) AS mean_value, count(value) AS years FROM vals_a WHERE year BETWEEN 1996 AND 2000 GROUP BY 1, 2""")
    first, last = n.baseline_years
    q["dashboard_figures"] = with_(*to_a, shown, """
by_year AS (SELECT event_type, year, sum(value) / count(value) AS m FROM vals_a GROUP BY 1, 2),
worst AS (SELECT event_type, year FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY m DESC, year) AS rn FROM by_year) WHERE rn = 1)""", select=f"""
SELECT v.event_type, count(DISTINCT station_id) AS stations, round(avg(value), 6) AS mean_value,
       round(avg(value) - avg(value) FILTER (WHERE v.year BETWEEN {first} AND {last}), 6) AS change_from_baseline, max(w.year)::INTEGER AS worst_year
FROM vals_a v JOIN worst w ON v.event_type = w.event_type GROUP BY 1""")
    q["dashboard_top_regions"] = with_(*to_a, shown, select="""
SELECT region_name, round(avg(value), 6) AS mean_value FROM vals_a WHERE event_type = 'dry_spell' GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 10""")
    q["dashboard_top_risk"] = with_(*to_c, select="""
SELECT station_id, event_type, risk_score, risk_rank FROM filled WHERE event_type = 'dry_spell' AND risk_score IS NOT NULL
ORDER BY risk_score DESC, risk_rank, station_id LIMIT 20""")
    q["dashboard_phase_line"] = with_(*to_a, shown, PHASES, """
months AS (SELECT year, count(*) FILTER (WHERE enso_phase = 'El Nino' AND NOT provisional) AS a, count(*) FILTER (WHERE enso_phase = 'La Nina' AND NOT provisional) AS b,
           count(*) FILTER (WHERE provisional) AS c FROM phases GROUP BY 1)""", select="""
SELECT event_type, v.year::INTEGER AS year, round(avg(value), 6) AS mean_value, coalesce(max(a), 0) AS el_nino_months, coalesce(max(b), 0) AS la_nina_months,
       coalesce(max(c), 0) AS provisional_months FROM vals_a v LEFT JOIN months m ON v.year = m.year GROUP BY 1, 2""")
    q["dashboard_scatter"] = with_(*to_a, shown, select="""
SELECT station_id, round(avg(value) FILTER (WHERE event_type = 'heatwave'), 6) AS mean_heatwave_days,
       round(avg(value) FILTER (WHERE event_type = 'dry_spell'), 6) AS mean_longest_dry_spell,
       round(avg(value) FILTER (WHERE event_type = 'compound'), 6) AS mean_compound_days FROM vals_a GROUP BY 1""")
    q["dashboard_compare"] = with_(*to_a, shown, select="""
SELECT event_type, round(avg(value) FILTER (WHERE region_name = 'NATION_1'), 6) AS left_mean, round(avg(value) FILTER (WHERE region_name = 'NATION_2'), 6) AS right_mean,
       round(avg(value) FILTER (WHERE region_name = 'NATION_1') - avg(value) FILTER (WHERE region_name = 'NATION_2'), 6) AS difference
FROM vals_a WHERE region_name IN ('NATION_1', 'NATION_2') GROUP BY 1""")

    q["tolerance_match"] = with_(nation, f"""
large AS (SELECT DISTINCT {sid('c_nationkey')} AS state, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey WHERE TRUE)""",
        select="""
SELECT station_id AS state, date AS day FROM day_obs d WHERE prcp > 0
AND EXISTS (SELECT 1 FROM large l WHERE l.state = d.station_id AND l.day BETWEEN d.date - 1 AND d.date + 1)""")
    q["storm_days"] = with_(storm_days(), select="SELECT * FROM storm_days")
    kinds = " ".join(
        f"WHEN event_type IN ({', '.join(repr(t) for t in mine)}) THEN '{name}'" for name, (mine, _) in STORM_CATEGORIES.items()
    )
    q["storm_validation"] = with_(*to_events, STATIONS, storm_days(), f"""
us AS (SELECT station_id, upper(region_name) AS state FROM stations WHERE country = 'United States'),
win_y AS (SELECT make_date(min(y), 1, 1) AS f, make_date(max(y), 12, 31) AS l FROM records),
mine AS (
  SELECT CASE {kinds} END AS category, e.station_id, u.state, start_date, least(end_date, l) AS end_date
  FROM ev e JOIN us u ON e.station_id = u.station_id JOIN win_y ON start_date BETWEEN f AND l
  WHERE event_type <> 'COMPOUND_HEATWAVE_DRY_SPELL'),
found AS (SELECT DISTINCT category, state, unnest(generate_series(start_date, end_date, INTERVAL 1 DAY))::DATE AS day FROM mine),
stored AS (SELECT * FROM storm_days WHERE state IN (SELECT state FROM us)),
fm AS (SELECT f.*, EXISTS (SELECT 1 FROM stored s WHERE s.category = f.category AND s.state = f.state AND s.day BETWEEN f.day - 1 AND f.day + 1) AS hit FROM found f),
sm AS (SELECT s.*, EXISTS (SELECT 1 FROM found f WHERE s.category = f.category AND s.state = f.state AND f.day BETWEEN s.day - 1 AND s.day + 1) AS hit FROM stored s),
cats AS (SELECT unnest([{', '.join(f"'{c}'" for c in STORM_CATEGORIES)}]) AS category),
counts AS (
  SELECT c.category, (SELECT count(DISTINCT station_id) FROM mine m WHERE m.category = c.category) AS stations,
         (SELECT count(DISTINCT state) FROM mine m WHERE m.category = c.category) AS states,
         (SELECT count(*) FROM fm WHERE fm.category = c.category) AS detected_state_days,
         (SELECT count(*) FROM fm WHERE fm.category = c.category AND hit) AS md,
         (SELECT count(*) FROM sm WHERE sm.category = c.category) AS storm_state_days,
         (SELECT count(*) FROM sm WHERE sm.category = c.category AND hit) AS ms,
         (SELECT count(DISTINCT state) FROM us) * (SELECT l - f + 1 FROM win_y) AS total FROM cats c),
rates AS (
  SELECT *, CASE WHEN detected_state_days > 0 THEN md / detected_state_days END AS pr, CASE WHEN storm_state_days > 0 THEN ms / storm_state_days END AS re,
         CASE WHEN total > 0 THEN storm_state_days / total END AS br FROM counts)""", select="""
SELECT category, stations, states, detected_state_days, round_even(pr, 4) AS precision, storm_state_days, round_even(re, 4) AS recall,
       round_even(br, 4) AS base_rate, CASE WHEN br > 0 THEN round_even(pr / br, 1) END AS lift FROM rates""")
    q["date_expand_capped"] = """WITH spans AS (
  SELECT o_orderdate::DATE AS b, max(l_shipdate)::DATE AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate)
SELECT day, count(*) AS open_orders FROM (SELECT unnest(generate_series(b, greatest(b, e), INTERVAL 1 DAY))::DATE AS day FROM spans) GROUP BY 1"""
    q["geo_lookup"] = f"""WITH s AS (
  SELECT substr(upper(r_name), 1, 2) AS code, n_regionkey, n_nationkey, {lon('n_nationkey')} AS lon, n_nationkey % 10 AS digit, r_name AS home
  FROM nation JOIN region ON n_regionkey = r_regionkey),
coded AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'RS' WHEN n_nationkey % 3 = 1 THEN 'US' ELSE code END AS code, * EXCLUDE (code) FROM s),
named AS (
  SELECT code || lpad(n_nationkey::VARCHAR, 9, '0') AS station_id, code, lon,
         CASE code WHEN 'RS' THEN 'Russia' WHEN 'US' THEN 'United States' ELSE upper(home[1]) || lower(home[2:]) END AS country,
         CASE code WHEN 'US' THEN r.r_name END AS state_name, home
  FROM coded LEFT JOIN region r ON digit = r.r_regionkey)
SELECT station_id, coalesce(state_name, country) AS region_name, country,
       CASE WHEN code = 'US' THEN 'AMERICA' WHEN code = 'RS' THEN CASE WHEN lon < 60 THEN 'Europe' ELSE 'Asia' END ELSE home END AS continent
FROM named"""
    q["phase_runs"] = with_(PHASES, select="SELECT * FROM phases")

    q["fixed_width_daily"] = with_(nation, LONG_OBS, select="""
SELECT station_id, date, element, (floor(value)::BIGINT % 100000) / 10.0::DOUBLE AS value, CASE WHEN element = 'PRCP' THEN 'mm' ELSE 'degrees_C' END AS unit FROM long_obs""")
    key = "substr(station_id, 3, 9)::INTEGER"
    q["fixed_width_inventory"] = with_(nation, select=f"""
SELECT station_id, round({lat(key)}, 4) AS lat, round({lon(key)}, 4) AS lon, min(year(date))::INTEGER AS first_year, max(year(date))::INTEGER AS last_year
FROM day_obs GROUP BY 1""")

    prior = "CASE WHEN substr(station_id, 3, 1) IN ('W', 'M', 'N', 'E') THEN 2 ELSE 0 END"
    q["candidate_choice"] = with_(results, select=f"""
SELECT station_id, lat_cell, lon_cell, first_year, last_year, rn::INTEGER AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY lat_cell, lon_cell ORDER BY {prior} DESC, first_year, last_year DESC, station_id) AS rn
  FROM results WHERE first_year <= 1995 AND last_year >= 2001)""")
    q["spread_selection"] = with_(results, picks, select="SELECT station_id, lat_cell, lon_cell, place FROM picked")
    q["farthest_selection"] = farthest(10)
    q["screening_totals"] = with_(results, picks, """
marks AS (SELECT CASE WHEN lon < 0 THEN 'West' ELSE 'East' END AS continent, 1 AS screened, (years >= 7)::INTEGER AS passing,
          (station_id IN (SELECT station_id FROM picked))::INTEGER AS selected FROM results)""", select="""
SELECT coalesce(continent, 'TOTAL') AS continent, sum(screened)::BIGINT AS screened, sum(passing)::BIGINT AS passing, sum(selected)::BIGINT AS selected
FROM marks GROUP BY ROLLUP (continent)""")
    other = replace(n, valid_year_pct=63.0)
    compared = ("baseline_valid_years", "valid_years_1995_2001", "meets_80_all_variables", "baseline_eligible", "enough_years_for_trend")
    q["results_compare"] = with_(nation, profile(n), eligibility(n), eligibility(other, name="other"), select=" UNION ALL ".join(
        f"SELECT a.station_id, '{c}' AS \"column\", a.{c}::INTEGER AS screening, b.{c}::INTEGER AS pipeline FROM elig a JOIN other b ON a.station_id = b.station_id WHERE a.{c} IS DISTINCT FROM b.{c}"
        for c in compared))
    q["id_overlap"] = """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS common, count(*) FILTER (WHERE b.k IS NULL) AS only_mine,
       count(*) FILTER (WHERE a.k IS NULL) AS only_other FROM a FULL JOIN b ON a.k = b.k"""
    q["merged_results"] = with_(results, select="""
SELECT station_id, busy AS baseline_valid_years, CASE WHEN busy >= 3 THEN 'ok' ELSE 'not_found' END AS status FROM results""")

    sides = {"urgent": "o_orderpriority = '1-URGENT'", "finished": "o_orderstatus = 'F'"}
    keys = "o_custkey, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, day(o_orderdate)::INTEGER AS day"
    one, two = (f"SELECT DISTINCT {keys} FROM orders WHERE {rule}" for rule in sides.values())
    q["anti_join_check"] = f"""SELECT 'urgent' AS only_in, * FROM ({one} EXCEPT {two}) UNION ALL
SELECT 'finished' AS only_in, * FROM ({two} EXCEPT {one})"""
    q["duplicate_keys"] = "SELECT l_orderkey, l_linenumber, count(*) AS records FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"
    q["null_profile"] = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM documents"
        for c in ("doc_id", "text", "lang", "source", "n_chars")
    )
    q["value_ranges"] = with_(nation, LONG_OBS, select="""
SELECT element, min(value) AS minimum, max(value) AS maximum, count(*) AS records FROM long_obs GROUP BY 1""")
    q["observation_overview"] = with_(nation, LONG_OBS, select="""
SELECT count(*) AS observations, min(date) AS first_date, max(date) AS last_date, count(DISTINCT station_id) AS stations FROM long_obs""")
    q["compound_report"] = with_(*to_events, select=f"""
SELECT (SELECT count(*) FROM compound) AS compound_events, (SELECT count(*) FROM overlap_spans) AS expected_overlaps, 0::BIGINT AS not_an_overlap, 0::BIGINT AS missing_overlap,
       count(*) FILTER (WHERE event_type = 'HEATWAVE' AND duration_days < {n.heat_min_days}) AS short_heatwaves,
       count(*) FILTER (WHERE event_type = 'DRY_SPELL' AND duration_days < {n.dry_min_days}) AS short_dry_spells FROM ev""")
    q["event_durations"] = with_(*to_events, select="""
SELECT event_type, count(*) AS event_count, min(duration_days) AS minimum_days, max(duration_days) AS maximum_days FROM ev GROUP BY 1""")
    q["invalid_events"] = with_(*to_events, """
bent AS (SELECT * REPLACE (CASE WHEN day(start_date) % 5 = 0 THEN start_date - 1 ELSE end_date END AS end_date,
                           CASE WHEN day(start_date) % 7 = 0 THEN duration_days + 1 ELSE duration_days END AS duration_days) FROM ev)""", select="""
SELECT * FROM bent WHERE end_date < start_date OR duration_days < 1
UNION ALL SELECT * FROM bent WHERE end_date - start_date + 1 <> duration_days""")
    q["event_store"] = with_(*to_events, select="""
SELECT station_id, event_type, start_date, end_date, duration_days FROM ev WHERE event_type <> 'HEATWAVE' OR duration_days >= 5""")
    q["summary_rules"] = with_(*to_b, select="""
SELECT 'slope and p-value come with eligibility' AS rule, count(*) AS broken FROM table_b WHERE event_type = 'hot_days' AND trend_eligible HAVING count(*) > 0
UNION ALL SELECT 'a station has all event types', count(DISTINCT station_id) FROM table_a WHERE right(station_id, 1) = '3' HAVING count(*) > 0""")
    q["broken_thresholds"] = with_(nation, base(n), limits(n), long_limits, select="""
SELECT station_id, element, target_calendar_day, target_calendar_day % 50 = 9 AS is_nan FROM long_limits WHERE target_calendar_day % 50 IN (7, 9)""")
    q["dashboard_region_filter"] = with_(*to_a, shown, select="""
SELECT event_type, station_id, year::INTEGER AS year, round(value, 6) AS value FROM vals_a
WHERE (event_type = 'dry_spell' AND country = 'United States' AND year BETWEEN 1996 AND 2000) OR (event_type = 'heatwave' AND region_name = 'NATION_1')""")
    q["longest_dry_spells"] = with_(*to_events, select="""
SELECT station_id, start_date, end_date, duration_days, intensity_value FROM ev WHERE event_type = 'DRY_SPELL'
ORDER BY duration_days DESC, station_id, start_date LIMIT 10""")
    q["threshold_balance"] = with_(nation, base(n), limits(n), long_limits, select="""
SELECT count(*) AS threshold_rows, count(DISTINCT station_id) * 1098 AS expected_rows FROM long_limits""")
    q["rain_inspection"] = with_(nation, """
spine AS (SELECT unnest(generate_series(DATE '1997-01-01', DATE '1998-12-31', INTERVAL 1 DAY))::DATE AS date),
days AS (SELECT s.date, prcp FROM spine s LEFT JOIN day_obs d ON s.date = d.date AND station_id = 'ST000000003')""", select="""
SELECT count(*) AS expected_days, count(prcp) AS observed_rainfall_days, min(prcp) AS minimum_rainfall_mm, max(prcp) AS maximum_rainfall_mm,
       count(*) FILTER (WHERE prcp IS NULL) AS missing_days, count(*) FILTER (WHERE prcp < 10) AS dry_days, count(*) FILTER (WHERE prcp >= 10) AS wet_days FROM days""")
    q["rain_ends"] = with_(nation, """
spine AS (SELECT unnest(generate_series(DATE '1997-01-01', DATE '1998-12-31', INTERVAL 1 DAY))::DATE AS date),
days AS (SELECT s.date, prcp AS rainfall_mm, CASE WHEN prcp IS NULL THEN 'missing' WHEN prcp < 10 THEN 'dry' ELSE 'wet' END AS state
         FROM spine s LEFT JOIN day_obs d ON s.date = d.date AND station_id = 'ST000000003')""", select="""
SELECT *, 'first' AS "end" FROM days WHERE date <= DATE '1997-01-05' UNION ALL SELECT *, 'last' FROM days WHERE date >= DATE '1998-12-27'""")
    q["calendar_faults"] = with_(nation, base(n), limits(n), long_limits, select="""
SELECT station_id, element, count(*) AS records FROM long_limits WHERE NOT (element = 'TMAX' AND target_calendar_day = 50) GROUP BY 1, 2 HAVING count(*) < 366""")
    q["percent_faults"] = with_(*to_a, select="""
SELECT station_id, year::INTEGER AS year, days_present_pct * 1.2::DOUBLE AS days_present_pct FROM table_a WHERE NOT days_present_pct * 1.2::DOUBLE BETWEEN 0 AND 100""")
    q["dashboard_filtered"] = with_(*to_a, shown, select="""
SELECT station_id, event_type, round(avg(value), 6) AS mean_value, count(value) AS years FROM vals_a WHERE event_type = 'dry_spell' AND continent = 'AMERICA' GROUP BY 1, 2""")
    q["dashboard_season_days"] = with_(*to_a, table_e, seasons, select="""
SELECT event_type, sum(events)::BIGINT AS events, sum(event_days)::BIGINT AS event_days FROM seasons WHERE season = 'DJF' GROUP BY 1""")
    q["days_in_years"] = f"""SELECT year::INTEGER AS year, orders, days_seen, {year_days('year')}::INTEGER AS days_in_year FROM (
  SELECT year(o_orderdate) AS year, count(*) AS orders, count(DISTINCT o_orderdate::DATE) AS days_seen FROM orders GROUP BY 1)"""
    return q


def all_statements() -> dict[str, str]:
    from stationwise.plans import roundtrip_sql

    return _statements() | roundtrip_sql.statements()
