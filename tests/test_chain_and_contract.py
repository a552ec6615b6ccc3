import calendar
import datetime as dt

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract
from stationwise.config import ClimateConfig
from stationwise.operators import checks
from stationwise.plans.chain import RawInputs, run_chain
from stationwise.plans.oracle import all_statements
from stationwise.plans.queries import NATION_RULES, all_queries, nation_days, nation_flags
from stationwise.operators import events

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# Fast queries, one of each kind; tools/compare.py runs all of them.
COMPARED = [
    "obs_quality_filter", "station_eligibility", "threshold_annual_wet", "baseline_calendar_mean", "heat_runs", "events_all",
    "mann_kendall", "percentile_rank", "knn_edges", "date_expand_capped", "storm_days", "phase_runs", "fixed_width_daily",
    "spread_selection", "farthest_selection", "trend_decades", "anti_join_check", "calendar_faults", "id_overlap", "null_profile", "latest_station_row",
]


def test_every_station_query_has_sql():
    assert set(all_queries()) == set(all_statements())
    assert set(all_queries()) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_a_stable_schema(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["station_id", "start_date", "end_date", "duration_days", "intensity_value"]
    assert frame.count() == 5


def plain(value):
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = contract.queries()[name](spark, FOLDER)
    result = connection.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    assert ours == sorted(tuple(map(plain, r)) for r in result.fetchall())


@pytest.fixture(scope="module")
def high_keys(tmp_path_factory):
    """The smallest tables with supplier keys whose product with a position's multiplier leaves 32 bits."""
    folder = tmp_path_factory.mktemp("high_keys")
    for table in TABLES.split():
        keys = {"supplier": "s_suppkey", "lineitem": "l_suppkey"}
        shifted = f"REPLACE ({keys[table]} + 60000 AS {keys[table]})" if table in keys else ""
        duckdb.execute(f"COPY (SELECT * {shifted} FROM '{FOLDER}/{table}.parquet') TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["screening_chain", "screening_chain_report", "screening_results"])
def test_screening_takes_high_keys(spark, high_keys, name):
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{high_keys}/{table}.parquet'")
    frame = contract.queries()[name](spark, high_keys)
    result = connection.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    assert ours == sorted(tuple(map(plain, r)) for r in result.fetchall())


def test_run_search_follows_the_threshold_join_without_a_shuffle(spark):
    """The daily side is shuffled once for the join; the month windows reuse it."""
    flagged = nation_flags(nation_days(spark, FOLDER))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = events.run_events(flagged, NATION_RULES)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    join = plan.index("SortMergeJoin")
    assert plan[:join].count("Exchange") == 1 and "CartesianProduct" not in plan


@pytest.fixture(scope="module")
def raw_files(tmp_path_factory):
    """Twelve stations with 31 years of seasonal weather in the text layouts."""
    folder = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(21)
    places = {}
    for k in range(12):
        sid = f"USW{k:08d}" if k < 8 else f"FRM{k:08d}"
        places[sid] = (30.0 + k, -100.0 + 3 * k)
        lines = []
        for year in range(1991, 2022):
            for month in range(1, 13):
                days = calendar.monthrange(year, month)[1]
                doy = np.array([dt.date(year, month, d).timetuple().tm_yday for d in range(1, days + 1)])
                tmax = 200 + 100 * np.sin((doy - 100) / 58) + rng.normal(0, 40, days) + (year - 1991) * (2 + k % 3)
                rain = np.where(rng.random(days) < 0.25, rng.gamma(1.5, 60, days), 0)
                for element, values in (("TMAX", tmax), ("TMIN", tmax - 90 + rng.normal(0, 20, days)), ("PRCP", rain)):
                    blocks = [f"{int(v):5d}  S" for v in values] + ["-9999   "] * (31 - days)
                    lines.append(f"{sid}{year:4d}{month:02d}{element}" + "".join(blocks))
        (folder / f"{sid}.dly").write_text("\n".join(lines) + "\n")
    stations = [f"{s:<11} {la:8.4f} {lo:9.4f} {-999.9 if s.endswith('3') else 50.0:6.1f} TX {'NAME ' + s:<30}" for s, (la, lo) in places.items()]
    (folder / "stations.txt").write_text("\n".join(stations) + "\n")
    (folder / "ids.txt").write_text("\n".join(places) + "\n")
    (folder / "countries.csv").write_text("country_code,country,continent\nUS,United States,North America\nFR,France,Europe\n")
    (folder / "subdivisions.csv").write_text("country_code,state_code,region_name\nUS,TX,Texas\n")
    (folder / "storms.csv").write_text(
        "EVENT_ID,STATE,EVENT_TYPE,BEGIN_DATE_TIME,END_DATE_TIME,YEAR\n1,TEXAS,Heat,11-JUL-19 12:00:00,13-JUL-19 18:00:00,2019\n"
        "2,TEXAS,Flood,01-MAR-20 12:00:00,03-MAR-20 18:00:00,2020\n")
    return folder, list(places)


def test_full_chain(spark, raw_files, tmp_path):
    raw, names = raw_files
    inputs = RawInputs(
        daily=[str(raw / f"{n}.dly") for n in names], stations=str(raw / "stations.txt"), station_ids=str(raw / "ids.txt"),
        countries=str(raw / "countries.csv"), subdivisions=str(raw / "subdivisions.csv"), storms=str(raw / "storms.csv"))
    tables = run_chain(spark, inputs, str(tmp_path))
    assert tables["problems"] == []
    assert tables["table_a"].count() == 12 * 31 and tables["table_b"].count() == 12 * 6 and tables["table_c"].count() == 6
    assert tables["thresholds"].count() == 12 * 1098
    hot = {r["station_id"]: r for r in tables["table_b"].filter("event_type = 'hot_days'").collect()}
    assert all(r["trend_eligible"] and r["trend_slope"] > 0 and r["risk_score"] is not None for r in hot.values())
    assert tables["table_c"].filter("event_type = 'hot_days'").first()["n_stations"] == 12
    report = checks.compound_report(tables["events"], ClimateConfig()).first()
    assert report["not_an_overlap"] == 0 and report["missing_overlap"] == 0
    share = tables["table_a"].selectExpr("sum(hot_days) / sum(365.25 * days_present_pct / 100)").first()[0]
    assert 0.03 < share < 0.10
    assert {p.name for p in (tmp_path / "csv").iterdir()} == {
        "station_year_metrics", "station_summary", "global_stats", "station_events", "dashboard_data", "dashboard_season"}
    assert (tmp_path / "extreme_events" / "event_type=HEATWAVE").exists()
    storm = {r["category"]: r for r in tables["storm_validation"].collect()}
    assert storm["heatwave"]["storm_state_days"] == 3 and storm["heatwave"]["detected_state_days"] > 0
    assert tables["table_a"].filter("elevation_m IS NULL").select("station_id").distinct().count() == 1
