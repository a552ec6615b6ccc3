"""Registered queries: every operator on whole tables of the given folder.

Keys are the query names; each callable takes (spark, folder). The matching
ANSI SQL is in ``stationwise.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.config import (
    COLD_SNAP,
    DRY_SPELL,
    HEATWAVE,
    HEAVY_RAIN,
    STORM_CATEGORIES,
    SelectionConfig,
    SpatialConfig,
    StormConfig,
)
from stationwise.functions.calendar import days_in_year
from stationwise.functions.geo import haversine_km
from stationwise.functions.ranking import with_descending_rank, with_percentile_rank
from stationwise.operators import checks, completeness, dashboard, events, geography, intervals, panel, risk
from stationwise.operators import runs, selection, spatial, storms, thresholds, trends
from stationwise.operators.observations import daily_wide, keep_valid
from stationwise.plans.standin import (
    NATION_RULES,
    REGION_RULES,
    day_observations,
    inventory_lines,
    long_observations,
    monthly_index_lines,
    pseudo_lat,
    pseudo_lon,
    reused,
    station_id,
    station_list,
    storm_records,
    supplier_positions,
    table,
    tenths,
)
from stationwise.sources import daily as daily_source
from stationwise.sources import indices, stations as station_source

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    from stationwise.plans import roundtrips

    return _QUERIES | roundtrips.QUERIES


# ---- shared stand-in tables ------------------------------------------------


def nation_days(spark: SparkSession, folder: str) -> DataFrame:
    return reused(day_observations(spark, folder, "nation"))


def region_days(spark: SparkSession, folder: str) -> DataFrame:
    return reused(day_observations(spark, folder, "region"))


def nation_thresholds(wide: DataFrame) -> DataFrame:
    return thresholds.threshold_table(thresholds.baseline_slice(wide, NATION_RULES), NATION_RULES)


def nation_flags(wide: DataFrame, with_means: bool = False) -> DataFrame:
    means = thresholds.baseline_means(thresholds.baseline_slice(wide, NATION_RULES), NATION_RULES) if with_means else None
    return events.flag_days(wide, nation_thresholds(wide), NATION_RULES, means)


def nation_events(spark: SparkSession, folder: str) -> DataFrame:
    return events.detect_events(nation_flags(nation_days(spark, folder)), NATION_RULES)


def panel_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flagged days, thresholds and events of the nation stations."""
    wide = nation_days(spark, folder)
    limits = reused(nation_thresholds(wide))
    means = thresholds.baseline_means(thresholds.baseline_slice(wide, NATION_RULES), NATION_RULES)
    flagged = reused(events.flag_days(wide, limits, NATION_RULES, means))
    return flagged, limits, events.detect_events(flagged, NATION_RULES)


def panel_of(spark: SparkSession, folder: str, flagged: DataFrame, limits: DataFrame, found: DataFrame) -> DataFrame:
    listed = station_list(spark, folder)
    return panel.station_year_metrics(flagged, limits, found, listed, listed)


def table_a(spark: SparkSession, folder: str) -> DataFrame:
    return panel_of(spark, folder, *panel_inputs(spark, folder))


def tables_ae(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    flagged, limits, found = panel_inputs(spark, folder)
    found = reused(found)
    return reused(panel_of(spark, folder, flagged, limits, found)), panel.station_events(found)


def tables_abc(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a = reused(table_a(spark, folder))
    b = reused(trends.station_summary(a, NATION_RULES))
    filled, c = risk.risk_and_hotspots(a, b, NATION_RULES)
    return a, filled, c


# ---- observations, completeness, eligibility --------------------------------


@query
def obs_wide(spark, folder):
    """Long observations to one row per station and day."""
    return daily_wide(long_observations(spark, folder, "region"))


@query
def obs_quality_filter(spark, folder):
    """Valid-value rule on the event stream; error events carry a quality flag."""
    raw = table(spark, folder, "events").select(
        "event_id",
        F.to_date("ts").alias("date"),
        F.col("value").alias("raw_value"),
        F.when(F.col("event_type") == "error", "E").otherwise(" ").alias("quality_flag"),
    )
    return keep_valid(raw).select("event_id", "date", "raw_value")


@query
def completeness_by_station(spark, folder):
    profile = completeness.yearly_profile(day_observations(spark, folder, "nation"), NATION_RULES)
    return completeness.completeness_report(profile, NATION_RULES)


@query
def valid_years(spark, folder):
    profile = completeness.yearly_profile(day_observations(spark, folder, "region"), REGION_RULES)
    return completeness.valid_years(profile, REGION_RULES)


@query
def station_eligibility(spark, folder):
    profile = completeness.yearly_profile(day_observations(spark, folder, "nation"), NATION_RULES)
    return completeness.station_eligibility(profile, NATION_RULES)


@query
def station_scores(spark, folder):
    """Screening scores with the baseline day counts of each variable."""
    profile = completeness.yearly_profile(day_observations(spark, folder, "region"), REGION_RULES)
    return completeness.station_scores(profile, REGION_RULES)


# ---- thresholds --------------------------------------------------------------


@query
def threshold_calendar_window(spark, folder):
    base = thresholds.baseline_slice(day_observations(spark, folder, "region"), REGION_RULES)
    return thresholds.window_thresholds(base, REGION_RULES)


@query
def threshold_exact(spark, folder):
    """Window thresholds next to the exact annual rain percentile."""
    base = reused(thresholds.baseline_slice(day_observations(spark, folder, "region"), REGION_RULES))
    window = thresholds.window_thresholds(base, REGION_RULES)
    return window.join(thresholds.annual_rain_threshold(base, REGION_RULES, exact=True), "station_id", "left")


@query
def threshold_annual_wet(spark, folder):
    base = thresholds.baseline_slice(day_observations(spark, folder, "nation"), NATION_RULES)
    return thresholds.annual_rain_threshold(base, NATION_RULES)


@query
def thresholds_all(spark, folder):
    return nation_thresholds(nation_days(spark, folder))


@query
def thresholds_of_eligible(spark, folder):
    """Threshold stations gated by completeness and eligibility."""
    wide = nation_days(spark, folder)
    profile = reused(completeness.yearly_profile(wide, NATION_RULES))
    allowed = thresholds.eligible_stations(
        completeness.completeness_report(profile, NATION_RULES),
        completeness.station_eligibility(profile, NATION_RULES),
    )
    base = thresholds.baseline_slice(wide, NATION_RULES).join(allowed, "station_id", "left_semi")
    return thresholds.threshold_coverage(thresholds.threshold_table(base, NATION_RULES))


@query
def baseline_calendar_mean(spark, folder):
    base = thresholds.baseline_slice(day_observations(spark, folder, "region"), REGION_RULES)
    means = thresholds.baseline_means(base, REGION_RULES)
    # Prices have two decimals: rounding the sum removes the summation order.
    total = F.round(F.col("baseline_mean_tmax") * F.col("n_obs"), 2)
    return means.withColumn("baseline_mean_tmax", total / F.col("n_obs"))


# ---- flags, runs and events --------------------------------------------------


@query
def daily_flags(spark, folder):
    flagged = nation_flags(nation_days(spark, folder)).filter("has_thresholds")
    return flagged.select(
        "station_id", "date", "hot_flag", "cold_flag", "dry_flag", "rain_flag",
        "heat_excess", "cold_deficit", "rain_excess", "rain_deficit",
    )


@query
def heat_runs(spark, folder):
    """Station-relative threshold, daily flag and runs of three hot days by region."""
    wide = region_days(spark, folder)
    base = thresholds.baseline_slice(wide, REGION_RULES)
    cut = base.groupBy("station_id").agg(
        F.percentile_approx("tmax", REGION_RULES.hot_percentile, REGION_RULES.percentile_accuracy).alias("cut")
    )
    hot = wide.join(cut, "station_id").filter(F.col("tmax") > F.col("cut")).select(
        "station_id", "date", F.lit(HEATWAVE).alias("event_type"), (F.col("tmax") - F.col("cut")).alias("excess")
    )
    found = runs.consecutive_runs(hot, {HEATWAVE: 3})
    return found.select(
        "station_id", "start_date", "end_date", "duration_days", F.round("peak_excess", 2).alias("intensity_value")
    )


def _events_of(spark, folder, event_type):
    found = events.run_events(nation_flags(nation_days(spark, folder)), NATION_RULES)
    return found.filter(F.col("event_type") == event_type)


@query
def heat_events(spark, folder):
    return _events_of(spark, folder, HEATWAVE)


@query
def cold_events(spark, folder):
    return _events_of(spark, folder, COLD_SNAP)


@query
def dry_events(spark, folder):
    return _events_of(spark, folder, DRY_SPELL)


@query
def heavy_rain_days(spark, folder):
    return _events_of(spark, folder, HEAVY_RAIN)


@query
def run_totals(spark, folder):
    """Runs of any length with the summed, largest and mean excess."""
    flagged = nation_flags(nation_days(spark, folder))
    found = runs.consecutive_runs(events.qualifying_days(flagged), {}, one_day_types=[HEAVY_RAIN])
    return found.select(
        "station_id",
        "event_type",
        "start_date",
        "duration_days",
        F.round("total_excess", 2).alias("total_excess"),
        F.round("peak_excess", 2).alias("peak_excess"),
        F.round(F.col("total_excess") / F.col("duration_days"), 6).alias("mean_excess"),
    )


@query
def compound_overlap(spark, folder):
    """Overlap of hot and dry runs as a binned interval join."""
    found = reused(events.run_events(nation_flags(nation_days(spark, folder)), NATION_RULES))
    return events.compound_events(found)


@query
def events_all(spark, folder):
    return nation_events(spark, folder)


@query
def events_by_year(spark, folder):
    return panel.event_metrics_by_year(nation_events(spark, folder))


@query
def station_events(spark, folder):
    return panel.station_events(nation_events(spark, folder))


@query
def longest_dry_run(spark, folder):
    return panel.longest_dry_run_by_year(nation_flags(nation_days(spark, folder)))


# ---- yearly panel and trends -------------------------------------------------


@query
def station_year_metrics(spark, folder):
    return table_a(spark, folder)


@query
def tmax_anomaly(spark, folder):
    flagged = nation_flags(nation_days(spark, folder), with_means=True)
    return panel.daily_metrics_by_year(flagged).select("station_id", "year", "tmax_anomaly_mean", "days_present_pct")


def _supplier_series(spark, folder):
    yearly = (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"))
        .agg(F.sum("l_quantity").alias("value"))
    )
    return yearly.groupBy("l_suppkey").agg(
        F.array_sort(F.collect_list(F.struct("year", "value"))).alias("series")
    )


@query
def trend_theil_sen(spark, folder):
    """Slope of the yearly quantity of every supplier."""
    series = trends.trend_columns(_supplier_series(spark, folder))
    return series.select("l_suppkey", F.round("slope_per_year", 6).alias("slope_per_year"))


@query
def trend_decades(spark, folder):
    """Slope per decade of every supplier's yearly lines over 160, rounded half to even: ties at the third decimal are common."""
    yearly = (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"))
        .agg((F.count(F.lit(1)) / 160.0).alias("value"))
    )
    series = yearly.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("year", "value"))).alias("series"))
    slopes = trends.trend_columns(series)
    return slopes.select("l_suppkey", F.bround(F.col("slope_per_year") * 10.0, 3).alias("trend_slope"))


@query
def mann_kendall(spark, folder):
    series = trends.trend_columns(_supplier_series(spark, folder))
    return series.select(
        "l_suppkey",
        "mk_s",
        F.round("mk_variance", 6).alias("mk_variance"),
        F.round("mk_z", 6).alias("mk_z"),
        F.round("mk_p", 6).alias("mk_p"),
    )


@query
def station_summary(spark, folder):
    return trends.station_summary(table_a(spark, folder), NATION_RULES).drop(
        "risk_score", "risk_rank", "gi_z_score", "gi_p_value", "hotspot_class"
    )


@query
def latest_station_row(spark, folder):
    """Newest order of every customer: the keep-last rule as a maximum, not a sort."""
    orders = table(spark, folder, "orders")
    newest = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))
    return orders.groupBy("o_custkey").agg(newest.alias("last")).select("o_custkey", "last.*")


# ---- risk and space ----------------------------------------------------------


@query
def station_levels(spark, folder):
    levels = risk.station_levels(table_a(spark, folder), NATION_RULES)
    return levels.withColumn("level", F.round("level", 6))


@query
def risk_score(spark, folder):
    a = reused(table_a(spark, folder))
    b = trends.station_summary(a, NATION_RULES)
    return risk.risk_scores(risk.ranked_rows(a, b, NATION_RULES))


@query
def percentile_rank(spark, folder):
    """Average-tie and minimum-tie ranks of all parts within their brand."""
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("p_size"))
    ranked = with_percentile_rank(parts, "p_brand", "p_size", "share")
    ranked = with_descending_rank(ranked, "p_brand", "p_size", "place")
    return ranked.select("p_partkey", "p_brand", F.round("share", 6).alias("share"), "place")


@query
def haversine_lanes(spark, folder):
    """Great-circle distance and lines of every supplier to customer nation lane."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    lanes = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "c_nationkey")
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    a, b = F.col("s_nationkey"), F.col("c_nationkey")
    km = haversine_km(pseudo_lat(a), pseudo_lon(a), pseudo_lat(b), pseudo_lon(b))
    return lanes.select(a, b, "lines", F.round(km, 3).alias("km"))


@query
def grid_cells(spark, folder):
    """Suppliers per ten-degree cell; negative positions floor down."""
    points = supplier_positions(spark, folder)
    return selection.with_cell(points, 10.0).groupBy("lat_cell", "lon_cell").agg(F.count(F.lit(1)).alias("points"))


def _supplier_edges(spark, folder, k=5):
    points = supplier_positions(spark, folder)
    return points, spatial.nearest_neighbours(points, k, "event_type", SpatialConfig().earth_radius_km)


@query
def knn_edges(spark, folder):
    _, edges = _supplier_edges(spark, folder)
    return edges.select("event_type", "i", "j", F.round("distance_km", 3).alias("distance_km"), "position")


@query
def gi_star(spark, folder):
    points, edges = _supplier_edges(spark, folder)
    spots = spatial.gi_star(points, edges, "event_type", "level")
    return spots.select(
        "station_id", F.round("gi_z", 6).alias("gi_z"), F.round("gi_p", 6).alias("gi_p"), "hotspot_class"
    )


@query
def morans_i(spark, folder):
    points, edges = _supplier_edges(spark, folder)
    found = spatial.morans_i(points, reused(edges), "event_type", "level")
    return found.select(
        "event_type", F.round("morans_i", 6).alias("morans_i"), F.round("morans_p", 6).alias("morans_p")
    )


@query
def graph_components(spark, folder):
    """Groups of suppliers linked to their two nearest neighbours."""
    points, edges = _supplier_edges(spark, folder, k=2)
    return spatial.connected_components(edges, points.select(F.col("station_id").alias("id")))


@query
def summary_with_risk(spark, folder):
    _, filled, _ = tables_abc(spark, folder)
    return filled


@query
def global_statistics(spark, folder):
    _, _, c = tables_abc(spark, folder)
    return c


@query
def hotspot_crosstab(spark, folder):
    """Suppliers by account level and hotspot class."""
    points, edges = _supplier_edges(spark, folder)
    return risk.hotspot_counts(spatial.gi_star(points, edges, "event_type", "level"))


# ---- dashboard ---------------------------------------------------------------


@query
def long_unpivot(spark, folder):
    a, b, c = tables_abc(spark, folder)
    return dashboard.long_table(a, b, c, NATION_RULES)


@query
def season_rollup(spark, folder):
    a, e = tables_ae(spark, folder)
    return dashboard.season_table(a, e, NATION_RULES)


@query
def season_reconcile(spark, folder):
    a, e = tables_ae(spark, folder)
    return dashboard.reconciliation(a, dashboard.season_table(a, e, NATION_RULES), NATION_RULES)


def _dashboard_values(spark, folder):
    kept = ["station_id", "region_name", "country", "continent", "year"]
    values = [F.col(m).cast("double").alias(e) for e, m in dashboard.TREND_MEASURES.items()]
    return dashboard.complete_years(table_a(spark, folder), NATION_RULES).unpivot(kept, values, "event_type", "value")


@query
def dashboard_station_map(spark, folder):
    shown = dashboard.station_map(dashboard.choose(_dashboard_values(spark, folder), first_year=1996, last_year=2000))
    return shown.withColumn("mean_value", F.round("mean_value", 6))


@query
def dashboard_figures(spark, folder):
    figures = dashboard.overview_figures(reused(_dashboard_values(spark, folder)), NATION_RULES)
    return figures.withColumns(
        {c: F.round(c, 6) for c in ("mean_value", "change_from_baseline")}
    )


@query
def dashboard_top_regions(spark, folder):
    top = dashboard.top_regions(_dashboard_values(spark, folder), "dry_spell", 10)
    return top.withColumn("mean_value", F.round("mean_value", 6))


@query
def dashboard_top_risk(spark, folder):
    _, filled, _ = tables_abc(spark, folder)
    return dashboard.top_risk(filled, "dry_spell", 20)


@query
def dashboard_phase_line(spark, folder):
    phases = indices.phase_table(reused(indices.parse_index_lines(monthly_index_lines(spark, folder))))
    line = dashboard.yearly_line_with_phases(_dashboard_values(spark, folder), phases)
    return line.withColumn("mean_value", F.round("mean_value", 6))


@query
def dashboard_scatter(spark, folder):
    scatter = dashboard.warm_dry_scatter(_dashboard_values(spark, folder))
    return scatter.select("station_id", *[F.round(c, 6).alias(c) for c in scatter.columns[1:]])


@query
def dashboard_compare(spark, folder):
    both = dashboard.region_comparison(_dashboard_values(spark, folder), "NATION_1", "NATION_2")
    return both.select("event_type", *[F.round(c, 6).alias(c) for c in both.columns[1:]])


# ---- storms, geography, phases ------------------------------------------------


@query
def tolerance_match(spark, folder):
    """Rainy days of a nation with an order of its customers within one day."""
    days = day_observations(spark, folder, "nation").filter(F.col("prcp") > 0).select(
        F.lit("rain").alias("category"), F.col("station_id").alias("state"), F.col("date").alias("day")
    )
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    large = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.lit("rain").alias("category"),
            station_id(F.col("c_nationkey")).alias("state"),
            F.to_date("o_orderdate").alias("day"),
        )
        .distinct()
    )
    return storms.near_days(days, large, 1).select("state", "day")


@query
def storm_validation(spark, folder):
    listed = station_list(spark, folder)
    return storms.validate_events(reused(nation_events(spark, folder)), reused(storm_records(spark, folder)), listed)


@query
def storm_days(spark, folder):
    """Distinct category, state and day of the text-dated records."""
    kinds = {name: theirs for name, (_, theirs) in STORM_CATEGORIES.items()}
    return storms.storm_state_days(storm_records(spark, folder), StormConfig(), kinds)


@query
def date_expand_capped(spark, folder):
    """Open orders of every day, from order date to last ship date: a sweep line, no span becomes days."""
    shipped = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("shipped"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("begin"))
    spans = orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "begin", storms.capped_end(F.col("begin"), F.col("shipped"), None).alias("end")
    )
    return intervals.days_open(spans, "begin", "end", name="open_orders")


@query
def geo_lookup(spark, folder):
    """Region, country and continent of all nation stations with lookup fallbacks."""
    regions = table(spark, folder, "region")
    nations = table(spark, folder, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    home = F.upper(F.substring("r_name", 1, 2))
    code = F.when(key % 3 == 0, "RS").when(key % 3 == 1, "US").otherwise(home)
    metadata = nations.select(
        F.concat(code, F.lpad(key.cast("string"), 9, "0")).alias("station_id"), pseudo_lon(key).alias("lon")
    )
    states = metadata.select("station_id", F.concat(F.lit("S"), F.substring("station_id", 11, 1)).alias("state"))
    countries = regions.select(home.alias("country_code"), F.concat(F.substring("r_name", 1, 1), F.lower(F.expr("substring(r_name, 2)"))).alias("country"), F.col("r_name").alias("continent"))
    known = regions.filter(F.col("r_regionkey") == 0).select(
        F.inline(
            F.array(
                *[
                    F.struct(*[F.lit(x).alias(c) for c, x in zip(("country_code", "country", "continent"), row)])
                    for row in (("US", "United States", "AMERICA"), ("RS", "Russia", "EUROPE"))
                ]
            )
        )
    )
    subdivisions = regions.select(
        F.lit("US").alias("country_code"),
        F.concat(F.lit("S"), F.col("r_regionkey").cast("string")).alias("state_code"),
        F.col("r_name").alias("region_name"),
    )
    return geography.station_geography(metadata, states, countries.unionByName(known), subdivisions)


@query
def phase_runs(spark, folder):
    """Index text to months with phases and the open last run."""
    return indices.phase_table(reused(indices.parse_index_lines(monthly_index_lines(spark, folder))))


# ---- text layouts -------------------------------------------------------------


@query
def fixed_width_daily(spark, folder):
    """Observations written in the fixed-width layout and parsed back."""
    lines = daily_source.format_daily_lines(tenths(day_observations(spark, folder, "nation")))
    return daily_source.clean_daily(daily_source.parse_daily_lines(lines)).select(
        "station_id", "date", "element", "value", "unit"
    )


@query
def fixed_width_inventory(spark, folder):
    parsed = station_source.parse_inventory_lines(inventory_lines(day_observations(spark, folder, "nation")))
    return parsed.select("station_id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "first_year", "last_year")


# ---- selection ------------------------------------------------------------------

SUPPLIER_SELECTION = SelectionConfig(
    first_year=1995, last_year=2001, cell_degrees=30.0, per_cell=2, min_separation_km=600.0, required=(),
)


def supplier_results(spark, folder):
    """Suppliers as screened stations: years with sales and years with many sales."""
    yearly = (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("lines"))
        .groupBy("l_suppkey")
        .agg(
            F.count(F.lit(1)).alias("valid_years_1991_2025"),
            F.count_if(F.col("lines") >= 90).alias("baseline_valid_years"),
            F.min("year").alias("first_year"),
            F.max("year").alias("last_year"),
        )
    )
    points = table(spark, folder, "supplier").join(yearly, F.col("s_suppkey") == F.col("l_suppkey"))
    key = F.col("s_suppkey")
    return points.select(
        station_id(key).alias("station_id"),
        pseudo_lat(key).alias("lat"),
        pseudo_lon(key).alias("lon"),
        "first_year",
        "last_year",
        F.lit("ok").alias("status"),
        F.lit(True).alias("baseline_eligible"),
        (F.col("valid_years_1991_2025") >= 7).alias("enough_years_for_trend"),
        "valid_years_1991_2025",
        "baseline_valid_years",
    )


@query
def candidate_choice(spark, folder):
    chosen = selection.choose_candidates(supplier_results(spark, folder), SUPPLIER_SELECTION)
    return chosen.select("station_id", "lat_cell", "lon_cell", "first_year", "last_year", "position")


@query
def spread_selection(spark, folder):
    chosen = selection.select_stations(reused(supplier_results(spark, folder)), SUPPLIER_SELECTION)
    return chosen.select("station_id", "lat_cell", "lon_cell", "place")


@query
def farthest_selection(spark, folder):
    """Ten suppliers as far apart as possible, starting with the first one."""
    return selection.farthest_points(supplier_positions(spark, folder), 10).select("station_id", "pick_order")


@query
def screening_totals(spark, folder):
    results = reused(supplier_results(spark, folder).withColumn(
        "continent", F.when(F.col("lon") < 0, "West").otherwise("East")
    ))
    return selection.screening_report(results, selection.select_stations(results, SUPPLIER_SELECTION))


@query
def results_compare(spark, folder):
    """Eligibility by two completeness rules, compared column by column."""
    profile = reused(completeness.yearly_profile(day_observations(spark, folder, "nation"), NATION_RULES))
    mine = completeness.station_eligibility(profile, NATION_RULES)
    other = completeness.station_eligibility(profile, replace(NATION_RULES, valid_year_pct=63.0))
    columns = ["baseline_valid_years", "valid_years_1995_2001", *selection.COMPARED]
    return selection.compare_results(mine, other, columns)


@query
def id_overlap(spark, folder):
    """Customers with urgent orders against customers with finished orders."""
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("station_id"), "o_orderpriority", "o_orderstatus")
    return selection.id_overlap(
        orders.filter(F.col("o_orderpriority") == "1-URGENT"), orders.filter(F.col("o_orderstatus") == "F")
    )


@query
def merged_results(spark, folder):
    """Screening results of two runs: the newer row wins, failed ones are retried."""
    nations = supplier_results(spark, folder).select("station_id", "baseline_valid_years", "valid_years_1991_2025")
    done = nations.select(
        "station_id", "baseline_valid_years",
        F.when(F.col("baseline_valid_years") >= 3, "ok").otherwise("error").alias("status"),
    )
    new = selection.still_to_screen(nations.select("station_id", "baseline_valid_years"), done)
    new = new.select("station_id", "baseline_valid_years", F.lit("not_found").alias("status"))
    return selection.merge_results(done, new)


# ---- checks ---------------------------------------------------------------------


@query
def anti_join_check(spark, folder):
    """Customer days with urgent orders only or with finished orders only: a two-sided difference on four keys."""
    keys = ["o_custkey", "year", "month", "day"]
    orders = table(spark, folder, "orders").withColumns(
        {"year": F.year("o_orderdate"), "month": F.month("o_orderdate"), "day": F.dayofmonth("o_orderdate")}
    )
    urgent = orders.filter(F.col("o_orderpriority") == "1-URGENT").select(*keys).distinct()
    finished = orders.filter(F.col("o_orderstatus") == "F").select(*keys).distinct()
    return urgent.join(finished, keys, "left_anti").withColumn("only_in", F.lit("urgent")).unionByName(
        finished.join(urgent, keys, "left_anti").withColumn("only_in", F.lit("finished"))
    )


@query
def duplicate_keys(spark, folder):
    return checks.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def null_profile(spark, folder):
    return checks.null_profile(table(spark, folder, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


@query
def value_ranges(spark, folder):
    return checks.value_ranges(long_observations(spark, folder, "nation"), "element", "value")


@query
def observation_overview(spark, folder):
    return checks.observation_overview(long_observations(spark, folder, "nation"))


@query
def compound_report(spark, folder):
    return checks.compound_report(reused(nation_events(spark, folder)), NATION_RULES)


@query
def event_durations(spark, folder):
    return checks.duration_summary(nation_events(spark, folder))


@query
def invalid_events(spark, folder):
    """Event rows with broken dates or durations, in a table in which some are bent."""
    start = F.dayofmonth("start_date")
    found = reused(
        nation_events(spark, folder)
        .withColumn("end_date", F.when(start % 5 == 0, F.date_sub("start_date", 1)).otherwise(F.col("end_date")))
        .withColumn("duration_days", F.when(start % 7 == 0, F.col("duration_days") + 1).otherwise(F.col("duration_days")))
    )
    return checks.invalid_event_dates(found).unionByName(checks.duration_mismatches(found))


@query
def longest_dry_spells(spark, folder):
    return checks.longest_dry_spells(nation_events(spark, folder), 10)


@query
def threshold_balance(spark, folder):
    return checks.threshold_row_balance(nation_thresholds(nation_days(spark, folder)))


@query
def rain_inspection(spark, folder):
    """Missing, dry and wet days of one station on a full date spine."""
    observations = long_observations(spark, folder, "nation")
    days = checks.inspect_rain(observations, "ST000000003", "1997-01-01", "1998-12-31", 10.0)
    return checks.rain_summary(days)


@query
def rain_ends(spark, folder):
    """First and last five days of the inspected period."""
    observations = long_observations(spark, folder, "nation")
    days = checks.inspect_rain(observations, "ST000000003", "1997-01-01", "1998-12-31", 10.0)
    return checks.rain_ends(days, 5)


@query
def calendar_faults(spark, folder):
    """Calendars with too few thresholds, after one day of every maximum-temperature calendar was taken out."""
    table_of = nation_thresholds(nation_days(spark, folder))
    gap = (F.col("element") == "TMAX") & (F.col("target_calendar_day") == 50)
    return checks.incomplete_calendars(table_of.filter(~gap))


@query
def percent_faults(spark, folder):
    """Station-years whose completeness, scaled up by a fifth, leaves 0..100."""
    scaled = table_a(spark, folder).withColumn("days_present_pct", F.col("days_present_pct") * 1.2)
    return checks.out_of_range_percent(scaled).select("station_id", "year", "days_present_pct")


@query
def dashboard_filtered(spark, folder):
    """Station map of one event type on one continent."""
    chosen = dashboard.choose(_dashboard_values(spark, folder), event_type="dry_spell", continent="AMERICA")
    return dashboard.station_map(chosen).withColumn("mean_value", F.round("mean_value", 6))


@query
def dashboard_season_days(spark, folder):
    """Event days of the winter season by event type."""
    a, e = tables_ae(spark, folder)
    winter = dashboard.choose(dashboard.season_table(a, e, NATION_RULES), season_name="DJF")
    return winter.groupBy("event_type").agg(F.sum("events").alias("events"), F.sum("event_days").alias("event_days"))


@query
def days_in_years(spark, folder):
    """Orders per year against the days of that year."""
    year = F.year("o_orderdate")
    return (
        table(spark, folder, "orders")
        .groupBy(year.alias("year"))
        .agg(F.count(F.lit(1)).alias("orders"), F.count_distinct(F.to_date("o_orderdate")).alias("days_seen"))
        .withColumn("days_in_year", days_in_year(F.col("year")))
    )
