"""Registered queries over stores, files and staged runs: tables go out and come back.

Folders lie below the session's shared folder; every call takes a new one.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.config import HEATWAVE, ClimateConfig, SelectionConfig
from stationwise.functions.calendar import percent_of_year, season
from stationwise.operators import checks, completeness, dashboard, selection, trends
from stationwise.operators.daymaps import bitmap_profile, day_bitmaps
from stationwise.plans import queries as base
from stationwise.plans.screening import ScreeningInputs, run_screening
from stationwise.plans.standin import NATION_RULES, pseudo_lat, pseudo_lon, station_id, storm_records, table
from stationwise.session import work_folder
from stationwise.sinks import writers
from stationwise.sinks.files import Files
from stationwise.sinks.gate import Gated, fingerprint, violations, write_together
from stationwise.sinks.store import RunStore
from stationwise.sources.stations import coverage_of, format_station_lines, store_station_lines
from stationwise.sources.storms import newest_revisions, read_storm_events, valid_station_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SCREEN_RULES = ClimateConfig(
    baseline_start=dt.date(1995, 1, 2), baseline_end=dt.date(1999, 12, 31), trend_first_year=1995, trend_last_year=2001,
    valid_year_pct=6.0, element_completeness=0.07, min_baseline_valid_years=4, min_trend_years=5,
)
SCREEN_SELECTION = SelectionConfig(
    first_year=1995, last_year=2001, cell_degrees=30.0, per_cell=2, min_separation_km=600.0, max_stations=12, required=(),
)


def query(function):
    QUERIES[function.__name__] = function
    return function


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- observations in which variables are missing singly -------------------------


def coded_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers with an id that starts with the code of their region."""
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.upper(F.substring("r_name", 1, 2))
    return (
        table(spark, folder, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", "n_name", "r_name", F.concat(code, F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("station_id"))
    )


def gappy_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Long observations per order line and supplier: TMAX always, TMIN not on first lines, PRCP on returned lines only."""
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("date"), "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity"
    )
    values = F.array(
        F.struct(F.lit("TMAX").alias("element"), F.col("l_extendedprice").alias("value")),
        F.struct(F.lit("TMIN").alias("element"), F.when(F.col("l_linenumber") > 1, F.col("l_extendedprice")).alias("value")),
        F.struct(F.lit("PRCP").alias("element"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("value")),
    )
    own = coded_suppliers(spark, folder).select("s_suppkey", "station_id")
    return lines.join(own, F.col("l_suppkey") == F.col("s_suppkey")).select("station_id", "date", F.inline(values))


def gappy_profile(spark: SparkSession, folder: str) -> DataFrame:
    return bitmap_profile(day_bitmaps(gappy_observations(spark, folder)), SCREEN_RULES)


@query
def gappy_valid_years(spark, folder):
    """Station-years with enough days on which all variables are there, from day bitmaps."""
    return completeness.valid_years(gappy_profile(spark, folder), SCREEN_RULES)


@query
def gappy_eligibility(spark, folder):
    return completeness.station_scores(gappy_profile(spark, folder), SCREEN_RULES)


@query
def gappy_completeness(spark, folder):
    return completeness.completeness_report(gappy_profile(spark, folder), SCREEN_RULES)


# ---- screening ------------------------------------------------------------------


def screening_inputs(spark: SparkSession, folder: str, second_try: bool) -> ScreeningInputs:
    """Suppliers as stations; files of some are missing, those of others fail at the first try."""
    observations = gappy_observations(spark, folder)
    key = F.substring("station_id", 3, 9).cast("long")
    ranges = observations.filter("value IS NOT NULL").groupBy("station_id", "element").agg(
        F.min(F.year("date")).alias("first_year"), F.max(F.year("date")).alias("last_year")
    )
    layout = "%-11s %8.4f %9.4f %s %4d %4d"
    lines = ranges.select(
        F.format_string(layout, "station_id", pseudo_lat(key), pseudo_lon(key), "element", "first_year", "last_year").alias("value")
    )
    regions = table(spark, folder, "region").filter(F.col("r_regionkey") < 4)
    countries = regions.select(
        F.upper(F.substring("r_name", 1, 2)).alias("country_code"), F.initcap("r_name").alias("country"), F.col("r_name").alias("continent")
    )
    failing = F.when(key % 7 == 0, "ok" if second_try else "download_failed").otherwise("ok")
    status = F.when(key % 13 == 0, "not_found").otherwise(failing)
    return ScreeningInputs(
        lines, countries, lambda candidates: candidates.withColumn("status", status),
        lambda stations: observations.join(stations, "station_id", "left_semi"), folder,
    )


def screened(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A run that is stopped twice and has failed stations at first."""
    place = new_folder(spark, "screening")
    first = screening_inputs(spark, folder, False)
    for stop in ("candidates", "results"):
        run_screening(spark, first, place, SCREEN_RULES, SCREEN_SELECTION, stop)
    return run_screening(spark, screening_inputs(spark, folder, True), place, SCREEN_RULES, SCREEN_SELECTION)[0]


@query
def screening_chain(spark, folder):
    """From inventory text to the thinned selection, over two interruptions."""
    thinned = screened(spark, folder)["thinned"]
    return thinned.select("station_id", "country", "continent", "place", "baseline_valid_years", "valid_years_1995_2001")


@query
def screening_chain_report(spark, folder):
    return screened(spark, folder)["report"]


@query
def screening_results(spark, folder):
    """Every candidate's status and scores after failed ones were tried again."""
    return screened(spark, folder)["results"].drop("lat", "lon")


@query
def thinned_selection(spark, folder):
    """The spread-out selection thinned to twenty stations by farthest points."""
    results = base.reused(base.supplier_results(spark, folder))
    rules = replace(base.SUPPLIER_SELECTION, max_stations=20)
    return selection.thin_selection(selection.select_stations(results, rules), rules).select("station_id", "place")


@query
def pilot_selection(spark, folder):
    """A pilot of fifteen stations around two required ones, by the older earth radius."""
    required = (f"ST{3:09d}", f"ST{8:09d}")
    return selection.pilot_stations(base.supplier_positions(spark, folder), 15, required).select("station_id", "pick_order")


# ---- stores -----------------------------------------------------------------------


def supplier_lines(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    year = F.year("l_shipdate")
    lines = table(spark, folder, "lineitem").filter(year.between(first, last))
    return lines.groupBy(station_id(F.col("l_suppkey")).alias("station_id")).agg(F.count(F.lit(1)).alias("lines"))


@query
def result_store(spark, folder):
    """Two runs that were committed, one that was not, and their compaction."""
    early, late = supplier_lines(spark, folder, 1995, 1997), supplier_lines(spark, folder, 1998, 2001)
    store = RunStore(spark, new_folder(spark, "store"), early.schema, ["station_id"])
    key = F.substring("station_id", 3, 9).cast("long")
    store.append(early)
    store.write_run(late.withColumn("lines", F.lit(-1).cast("long")))
    store.append(late.filter(key % 3 == 0))
    store.compact()
    store.vacuum()
    return store.read()


def supplier_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days with sales per supplier, year and season."""
    day = F.to_date("l_shipdate")
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", F.year(day).alias("year"), season(day).alias("season"))
        .agg(F.count_distinct(day).alias("days"))
    )


def publish_days(spark: SparkSession, place: str, seasons: DataFrame, scale: float) -> tuple[dict, list[str]]:
    """The yearly and the seasonal table, visible together or not at all."""
    yearly = (
        seasons.groupBy("l_suppkey", "year").agg(F.sum("days").alias("days"))
        .withColumn("percent", percent_of_year(F.col("days"), F.col("year")) * scale)
    )
    keys, rules = ["l_suppkey", "year"], {"percent_out_of_range": F.col("percent").between(0, 100), "null_key": F.col("year").isNotNull()}
    gone = F.lit(False) if scale == 1.0 else (F.col("year") == 1998) & (F.col("season") == "DJF") & (F.col("l_suppkey") % 5 == 3)
    tables = {
        "yearly": Gated(yearly, {**violations(**rules), **fingerprint(keys, "days")}, list(rules)),
        "seasons": Gated(seasons.filter(~gone), fingerprint(keys, "days")),
    }

    def reconciled(measured):
        names = [f"fingerprint_{k}" for k in range(2)]
        same = all(measured["yearly"][n] == measured["seasons"][n] for n in names)
        return [] if same else ["days by season do not add up to days by year"]

    return write_together(spark, place, tables, reconciled)


@query
def gated_tables(spark, folder):
    """A good pair of tables is published; one with planted faults leaves nothing but its report."""
    place = new_folder(spark, "gated")
    seasons = base.reused(supplier_days(spark, folder))
    report = []
    for attempt, scale in (("bad", 5.0), ("good", 1.0), ("bad again", 5.0)):
        measured, problems = publish_days(spark, place, seasons, scale)
        visible = Files(spark, place).exists("yearly")
        for name in ("yearly", "seasons"):
            rows = spark.read.parquet(f"{place}/{name}").count() if visible else 0
            broken = measured[name].get("percent_out_of_range", 0)
            report.append((attempt, name, measured[name]["rows"], broken, len(problems), rows))
    return spark.createDataFrame(report, "attempt string, table_name string, rows long, broken long, problems int, visible_rows long")


@query
def event_store(spark, folder):
    """Events by type on disk, after the heat events alone were written anew with a longer least duration."""
    place = new_folder(spark, "events")
    found = base.reused(base.nation_events(spark, folder))
    writers.write_events(found, place)
    writers.rewrite_events(found.filter((F.col("event_type") == HEATWAVE) & (F.col("duration_days") >= 5)), place)
    stored = writers.read_events(spark, place, found.schema)
    return stored.select("station_id", "event_type", "start_date", "end_date", "duration_days")


# ---- files --------------------------------------------------------------------------


@query
def storm_files(spark, folder):
    """Storm records in files whose headers differ in order and columns, some compressed."""
    place = new_folder(spark, "storms")
    records = storm_records(spark, folder)
    odd = F.col("YEAR").cast("int") % 2 == 1
    records.filter(odd).write.option("header", True).option("compression", "gzip").csv(f"{place}/odd")
    even = records.filter(~odd).select("YEAR", "END_DATE_TIME", "EVENT_TYPE", F.lit("x, y").alias("NOTE"), "STATE", "BEGIN_DATE_TIME")
    even.write.option("header", True).csv(f"{place}/even")
    back = read_storm_events(spark, [f"{place}/odd", f"{place}/even"])
    return back.groupBy("YEAR", "STATE", "EVENT_TYPE", "NOTE").agg(
        F.count(F.lit(1)).alias("records"), F.min("BEGIN_DATE_TIME").alias("least_begin"), F.max("END_DATE_TIME").alias("largest_end")
    )


@query
def storm_revisions(spark, folder):
    """The newest file of every year in a listing of file names, and ids of the right form."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    name = F.concat(F.lit("StormEvents_details-ftp_v1.0_d"), F.year("o_orderdate"), F.lit("_c"), day)
    suffix = F.when(F.col("o_orderkey") % 5 == 0, ".txt").when(F.col("o_orderkey") % 2 == 0, ".csv").otherwise(".csv.gz")
    return newest_revisions(table(spark, folder, "orders").select(F.concat(F.lit("a/b/"), name, suffix).alias("filename")))


@query
def station_id_form(spark, folder):
    """Customer keys in the form of a station id; lower-case ones do not pass."""
    tail = F.translate(F.substring("c_name", -11, 11), "#", "-")
    name = F.when(F.col("c_custkey") % 4 == 0, F.lower(tail)).otherwise(F.upper(tail))
    return valid_station_ids(table(spark, folder, "customer").select(name.alias("station_id")))


def station_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers in the metadata layout; some lines cannot be read, for different reasons."""
    key = F.col("s_suppkey")
    fault = key % 20
    lat = F.when(fault == 2, F.lit("x7.50")).otherwise(F.format_string("%.4f", pseudo_lat(key)))
    lon = F.when(fault == 4, F.lit("")).when(fault == 6, F.lit("999.0000")).otherwise(F.format_string("%.4f", pseudo_lon(key)))
    height = F.when(fault == 8, F.lit("12,0")).otherwise(F.format_string("%.1f", key * 0.5))
    listed = coded_suppliers(spark, folder).select(
        F.when(fault == 0, F.substring("station_id", 1, 7)).otherwise(F.col("station_id")).alias("station_id"),
        lat.alias("lat"), lon.alias("lon"), height.alias("elevation_m"), F.lit("TX").alias("state"), F.col("n_name").alias("station_name"),
    )
    whole = F.length(F.trim(F.substring("value", 1, 11))) == 11
    return format_station_lines(listed).select(F.when(whole, F.col("value")).otherwise(F.substring("value", 1, 7)).alias("value"))


def stored_stations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    place = new_folder(spark, "stations")
    station_lines(spark, folder).write.text(f"{place}/raw")
    return store_station_lines(spark, f"{place}/raw", f"{place}/read")


@query
def metadata_rejects(spark, folder):
    """Unreadable station lines with their reason."""
    _, rejects = stored_stations(spark, folder)
    return rejects.select(F.substring("line", 1, 11).alias("line_head"), "reason")


@query
def metadata_stations(spark, folder):
    """Readable station lines by column, state included."""
    return stored_stations(spark, folder)[0]


@query
def metadata_coverage(spark, folder):
    """Wanted ids without metadata and stations that nobody asked for."""
    stations, _ = stored_stations(spark, folder)
    key = F.col("s_suppkey")
    wanted = coded_suppliers(spark, folder).filter(key % 3 > 0).select("station_id")
    return coverage_of(stations, wanted)


# ---- checks that had no query ---------------------------------------------------------


@query
def summary_rules(spark, folder):
    """Rules of Table B on a table in which some rows were bent."""
    a = base.reused(base.table_a(spark, folder))
    b = trends.station_summary(a, NATION_RULES)
    bent = b.withColumn("trend_slope", F.when(F.col("event_type") != "hot_days", F.col("trend_slope")))
    bent = bent.filter(~((F.col("event_type") == "heavy_rain") & F.col("station_id").endswith("3")))
    return checks.summary_faults(base.reused(bent), a, NATION_RULES).filter("broken > 0")


@query
def broken_thresholds(spark, folder):
    """Thresholds that are missing or not a number, in a table in which some were spoilt."""
    limits = base.nation_thresholds(base.nation_days(spark, folder))
    day = F.col("target_calendar_day")
    spoilt = F.when(day % 50 == 7, F.lit(None)).when(day % 50 == 9, F.lit(float("nan"))).otherwise(F.col("threshold"))
    found = checks.invalid_thresholds(limits.withColumn("threshold", spoilt))
    return found.select("station_id", "element", "target_calendar_day", F.isnan("threshold").alias("is_nan"))


@query
def dashboard_region_filter(spark, folder):
    """Yearly values of two event types in one country and one region."""
    shown = base._dashboard_values(spark, folder)
    by_country = dashboard.choose(shown, event_type="dry_spell", country="United States", first_year=1996, last_year=2000)
    by_region = dashboard.choose(shown, event_type="heatwave", region_name="NATION_1")
    return by_country.unionByName(by_region).select("event_type", "station_id", "year", F.round("value", 6).alias("value"))
