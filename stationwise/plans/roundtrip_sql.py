"""SQL of the queries over stores, files and staged runs."""

from __future__ import annotations

from stationwise.plans.oracle import EARTH, km, lat, lon, sid, with_, year_days
from stationwise.plans.roundtrips import SCREEN_RULES as RULES

CODED = f"""
coded AS (
  SELECT s_suppkey, n_name, r_name, r_regionkey, upper(substr(r_name, 1, 2)) || lpad(s_suppkey::VARCHAR, 9, '0') AS station_id,
         round({lat('s_suppkey')}, 4) AS lat, round({lon('s_suppkey')}, 4) AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

INSIDE = f"date BETWEEN DATE '{RULES.baseline_start}' AND DATE '{RULES.baseline_end}'"
GAPPY = f"""
gappy AS (
  SELECT station_id, l_shipdate::DATE AS date, bool_or(l_linenumber > 1) AS low, bool_or(l_returnflag = 'R') AS rain
  FROM lineitem JOIN coded ON l_suppkey = s_suppkey GROUP BY 1, 2),
prof AS (
  SELECT *, round(complete_days / {year_days('year')} * 100.0::DOUBLE, 2) AS pct FROM (
    SELECT station_id, year(date) AS year, count(*) FILTER (WHERE low AND rain) AS complete_days,
           count(*) FILTER (WHERE {INSIDE}) AS d_tmax, count(*) FILTER (WHERE low AND {INSIDE}) AS d_tmin, count(*) FILTER (WHERE rain AND {INSIDE}) AS d_prcp
    FROM gappy GROUP BY 1, 2))"""

FIRST, LAST = RULES.baseline_years
ENOUGH = " AND ".join(f"sum(d_{e}) / {RULES.baseline_days} >= {RULES.element_completeness}" for e in ("tmax", "tmin", "prcp"))
ELIGIBLE = f"""
elig AS (
  SELECT *, meets_80_all_variables AND baseline_valid_years >= {RULES.min_baseline_valid_years} AS baseline_eligible,
         valid_years_1995_2001 >= {RULES.min_trend_years} AS enough_years_for_trend FROM (
    SELECT station_id, count(*) FILTER (WHERE pct >= {RULES.valid_year_pct} AND year BETWEEN {FIRST} AND {LAST}) AS baseline_valid_years,
           count(*) FILTER (WHERE pct >= {RULES.valid_year_pct} AND year BETWEEN 1995 AND 2001) AS valid_years_1995_2001,
           {ENOUGH} AS meets_80_all_variables,
           sum(d_tmax)::BIGINT AS baseline_days_tmax, sum(d_tmin)::BIGINT AS baseline_days_tmin, sum(d_prcp)::BIGINT AS baseline_days_prcp
    FROM prof GROUP BY 1))"""

SCREENED = """
ranges AS (
  SELECT station_id, greatest(min(y), min(y) FILTER (WHERE low), min(y) FILTER (WHERE rain)) AS first_year,
         least(max(y), max(y) FILTER (WHERE low), max(y) FILTER (WHERE rain)) AS last_year
  FROM (SELECT *, year(date) AS y FROM gappy) GROUP BY 1 HAVING bool_or(low) AND bool_or(rain)),
screened AS (
  SELECT c.station_id, c.lat, c.lon, floor(c.lat / 30.0::DOUBLE)::INTEGER AS lat_cell, floor(c.lon / 30.0::DOUBLE)::INTEGER AS lon_cell,
         CASE WHEN r_regionkey < 4 THEN upper(r_name[1]) || lower(r_name[2:]) END AS country, CASE WHEN r_regionkey < 4 THEN r_name END AS continent,
         CASE WHEN s_suppkey % 13 = 0 THEN 'not_found' ELSE 'ok' END AS status
  FROM coded c JOIN ranges r ON c.station_id = r.station_id WHERE first_year <= 1995 AND last_year >= 2001),
outcome AS (SELECT s.*, e.* EXCLUDE (station_id) FROM screened s LEFT JOIN elig e ON s.status = 'ok' AND s.station_id = e.station_id),
good AS (SELECT * FROM outcome WHERE baseline_eligible AND enough_years_for_trend)"""


def spread(source: str, order: str) -> str:
    """The best station of every cell and the best one of the rest that is 600 km away from it."""
    ranked = f"row_number() OVER (PARTITION BY lat_cell, lon_cell ORDER BY {order}) AS rn"
    return f"""
first_pick AS (SELECT * EXCLUDE (rn), 1 AS place FROM (SELECT *, {ranked} FROM {source}) WHERE rn = 1),
away AS (
  SELECT o.* FROM {source} o JOIN first_pick f ON o.lat_cell = f.lat_cell AND o.lon_cell = f.lon_cell
  WHERE o.station_id <> f.station_id AND {km('o.lat', 'o.lon', 'f.lat', 'f.lon')} >= 600),
picked AS (SELECT * FROM first_pick UNION ALL SELECT * EXCLUDE (rn), 2 AS place FROM (SELECT *, {ranked} FROM away) WHERE rn = 1)"""


def thinned(source: str, picks: int, order: str, start: tuple[str, ...] = (), radius: float = EARTH) -> list[str]:
    """Farthest-point choice unrolled, as tables p1, p2 and so on with all columns of the source."""
    parts = [f"n0 AS (SELECT *, 'inf'::DOUBLE AS near FROM {source})"]
    for i in range(1, picks + 1):
        choice = f"WHERE station_id = '{start[i - 1]}'" if i <= len(start) else f"ORDER BY near DESC, {order} LIMIT 1"
        away = km("n.lat", "n.lon", "p.lat", "p.lon", radius)
        parts.append(f"p{i} AS MATERIALIZED (SELECT * FROM n{i - 1} {choice})")
        parts.append(
            f"n{i} AS MATERIALIZED (SELECT n.* REPLACE (least(n.near, {away}) AS near) FROM n{i - 1} n, p{i} p WHERE n.station_id <> p.station_id)"
        )
    union = " UNION ALL ".join(f"SELECT *, {i} AS pick_order FROM p{i}" for i in range(1, picks + 1))
    return [*parts, f"kept AS ({union})"]


CELLS = "lat_cell, lon_cell, place"
BEST = "valid_years_1995_2001 DESC, baseline_valid_years DESC, station_id"
CHOSEN = [CODED, GAPPY, ELIGIBLE, SCREENED, spread("good", BEST), *thinned("picked", 12, CELLS)]

SUPPLIERS = f"""
yearly AS (SELECT l_suppkey, year(l_shipdate) AS year, count(*) AS lines FROM lineitem GROUP BY 1, 2),
ok AS (
  SELECT {sid('s_suppkey')} AS station_id, {lat('s_suppkey')} AS lat, {lon('s_suppkey')} AS lon, years, busy,
         floor(({lat('s_suppkey')}) / 30.0::DOUBLE)::INTEGER AS lat_cell, floor(({lon('s_suppkey')}) / 30.0::DOUBLE)::INTEGER AS lon_cell
  FROM supplier JOIN (SELECT l_suppkey, count(*) AS years, count(*) FILTER (WHERE lines >= 90) AS busy FROM yearly GROUP BY 1) ON s_suppkey = l_suppkey
  WHERE years >= 7)"""

DAYS = """
seasons AS (
  SELECT l_suppkey, year(l_shipdate) AS year, CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'DJF' WHEN month(l_shipdate) < 6 THEN 'MAM'
           WHEN month(l_shipdate) < 9 THEN 'JJA' ELSE 'SON' END AS season, count(DISTINCT l_shipdate::DATE) AS days
  FROM lineitem GROUP BY 1, 2, 3),
yearly AS (SELECT l_suppkey, year, sum(days) AS days FROM seasons GROUP BY 1, 2)"""

RECORDS = """
records AS (
  SELECT n_name AS STATE, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Heat' WHEN '2' THEN 'Flood' WHEN '3' THEN 'Drought'
           WHEN '4' THEN 'Frost/Freeze' ELSE 'Hail' END AS EVENT_TYPE, year(o_orderdate)::VARCHAR AS YEAR,
         upper(strftime(o_orderdate, '%d-%b-%y %H:%M:%S')) AS b,
         upper(strftime(o_orderdate::DATE + (o_orderkey % 3 + CASE WHEN o_orderkey % 97 = 0 THEN 150 ELSE 0 END)::INTEGER, '%d-%b-%y %H:%M:%S')) AS e
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

LINES = f"""
faults AS (
  SELECT *, CASE s_suppkey % 20 WHEN 0 THEN 'line shorter than an id' WHEN 2 THEN 'latitude is not a number' WHEN 4 THEN 'longitude is not a number'
    WHEN 6 THEN 'position outside the globe' WHEN 8 THEN 'elevation is not a number' END AS reason FROM coded)"""


def statements() -> dict[str, str]:
    q: dict[str, str] = {}
    q["gappy_valid_years"] = with_(CODED, GAPPY, select=f"""
SELECT station_id, year::INTEGER AS year, complete_days, pct AS days_present_pct FROM prof WHERE pct >= {RULES.valid_year_pct}""")
    q["gappy_eligibility"] = with_(CODED, GAPPY, ELIGIBLE, select="SELECT * FROM elig")
    q["gappy_completeness"] = with_(CODED, GAPPY, select=" UNION ALL ".join(f"""
SELECT station_id, '{e}' AS element, sum(d_{e.lower()})::BIGINT AS observed_days, {RULES.baseline_days} AS expected_days,
       round(sum(d_{e.lower()}) / {RULES.baseline_days} * 100.0::DOUBLE, 2) AS completeness_percent,
       CASE WHEN sum(d_{e.lower()}) / {RULES.baseline_days} >= {RULES.element_completeness} THEN 'YES' ELSE 'NO' END AS meets_80_percent
FROM prof GROUP BY 1 HAVING sum(d_{e.lower()}) > 0""" for e in ("TMAX", "TMIN", "PRCP")))
    q["screening_results"] = with_(CODED, GAPPY, ELIGIBLE, SCREENED, select="SELECT * EXCLUDE (lat, lon, lat_cell, lon_cell) FROM outcome")
    q["screening_chain"] = with_(*CHOSEN, select="SELECT station_id, country, continent, place, baseline_valid_years, valid_years_1995_2001 FROM kept")
    q["screening_chain_report"] = with_(*CHOSEN, """
marks AS (SELECT continent, 1 AS screened, (station_id IN (SELECT station_id FROM good))::INTEGER AS passing,
                 (station_id IN (SELECT station_id FROM kept))::INTEGER AS selected FROM outcome WHERE status = 'ok' AND continent IS NOT NULL)""", select="""
SELECT coalesce(continent, 'TOTAL') AS continent, sum(screened)::BIGINT AS screened, sum(passing)::BIGINT AS passing, sum(selected)::BIGINT AS selected
FROM marks GROUP BY ROLLUP (continent)""")
    q["thinned_selection"] = with_(
        SUPPLIERS, spread("ok", "years DESC, busy DESC, station_id"), *thinned("picked", 20, CELLS), select="SELECT station_id, place FROM kept")
    points = f"pts AS (SELECT {sid('s_suppkey')} AS station_id, {lat('s_suppkey')} AS lat, {lon('s_suppkey')} AS lon FROM supplier)"
    required = (f"ST{3:09d}", f"ST{8:09d}")
    q["pilot_selection"] = with_(points, *thinned("pts", 15, "station_id", required, 6371.0), select="SELECT station_id, pick_order FROM kept")
    q["result_store"] = with_(f"""
found AS (
  SELECT l_suppkey, count(*) FILTER (WHERE year(l_shipdate) <= 1997) AS early, count(*) FILTER (WHERE year(l_shipdate) >= 1998) AS late FROM lineitem GROUP BY 1)""", select=f"""
SELECT {sid('l_suppkey')} AS station_id, CASE WHEN l_suppkey % 3 = 0 AND late > 0 THEN late ELSE early END AS lines, 3::BIGINT AS version FROM found
WHERE early > 0 OR (l_suppkey % 3 = 0 AND late > 0)""")
    lost = "(year = 1998 AND season = 'DJF' AND l_suppkey % 5 = 3)"
    q["gated_tables"] = with_(DAYS, f"""
counts AS (SELECT (SELECT count(*) FROM yearly) AS y, (SELECT count(*) FROM seasons) AS s, (SELECT count(*) FROM seasons WHERE NOT {lost}) AS kept,
  (SELECT count(*) FROM yearly WHERE round(days / {year_days('year')} * 100.0::DOUBLE, 2) * 5.0::DOUBLE > 100) AS broken),
attempts AS (SELECT unnest(['bad', 'good', 'bad again']) AS attempt)""", select="""
SELECT attempt, 'yearly' AS table_name, y AS rows, CASE WHEN attempt = 'good' THEN 0 ELSE broken END AS broken,
       CASE WHEN attempt = 'good' THEN 0 ELSE (broken > 0)::INTEGER + (kept < s)::INTEGER END AS problems, CASE WHEN attempt = 'bad' THEN 0 ELSE y END AS visible_rows
FROM attempts, counts UNION ALL
SELECT attempt, 'seasons', CASE WHEN attempt = 'good' THEN s ELSE kept END, 0, CASE WHEN attempt = 'good' THEN 0 ELSE (broken > 0)::INTEGER + (kept < s)::INTEGER END,
       CASE WHEN attempt = 'bad' THEN 0 ELSE s END FROM attempts, counts""")
    q["storm_files"] = with_(RECORDS, select="""
SELECT YEAR, STATE, EVENT_TYPE, CASE WHEN YEAR::INTEGER % 2 = 0 THEN 'x, y' END AS NOTE, count(*) AS records, min(b) AS least_begin, max(e) AS largest_end
FROM records GROUP BY 1, 2, 3, 4""")
    q["storm_revisions"] = """WITH named AS (
  SELECT year(o_orderdate)::INTEGER AS year, strftime(o_orderdate, '%Y%m%d') AS created, CASE WHEN o_orderkey % 2 = 0 THEN '.csv' ELSE '.csv.gz' END AS suffix
  FROM orders WHERE o_orderkey % 5 <> 0)
SELECT year, max('StormEvents_details-ftp_v1.0_d' || year || '_c' || created || suffix) AS filename, max(created) AS created FROM named GROUP BY 1"""
    q["station_id_form"] = """WITH named AS (SELECT c_custkey, translate(right(c_name, 11), '#', '-') AS tail FROM customer),
cased AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN lower(tail) ELSE upper(tail) END AS station_id FROM named)
SELECT station_id FROM cased WHERE regexp_full_match(station_id, '[A-Z0-9-]{11}')"""
    q["metadata_rejects"] = with_(CODED, LINES, select="""
SELECT CASE WHEN s_suppkey % 20 = 0 THEN substr(station_id, 1, 7) ELSE station_id END AS line_head, reason FROM faults WHERE reason IS NOT NULL""")
    q["metadata_stations"] = with_(CODED, LINES, select="""
SELECT station_id, n_name AS station_name, lat, lon, s_suppkey * 0.5::DOUBLE AS elevation_m, 'TX' AS state FROM faults WHERE reason IS NULL""")
    q["metadata_coverage"] = with_(CODED, LINES, select="""
SELECT station_id, CASE WHEN reason IS NULL THEN 'extra' ELSE 'missing' END AS problem FROM faults
WHERE (reason IS NULL AND s_suppkey % 3 = 0) OR (reason IS NOT NULL AND s_suppkey % 3 > 0)""")
    return q
