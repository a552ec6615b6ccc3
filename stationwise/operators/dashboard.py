"""Dashboard tables and the queries the storyboard asks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationwise.config import EVENT_LABELS, TREND_MEASURES, ClimateConfig
from stationwise.functions.calendar import season

STATION_COLUMNS = [
    "station_id",
    "station_name",
    "lat",
    "lon",
    "elevation_m",
    "region_name",
    "country",
    "continent",
]
TOOLTIP_COLUMNS = ["heatwave_max_intensity", "max_daily_prcp_mm", "prcp_total_mm", "tmax_anomaly_mean"]
TREND_COLUMNS = ["trend_slope", "trend_p_value", "years_used", "trend_eligible"]
RISK_COLUMNS = ["risk_score", "risk_rank", "gi_z_score", "gi_p_value", "hotspot_class"]
GLOBAL_COLUMNS = ["morans_i", "morans_p_value", "n_stations"]

# Season-table event type -> yearly column it must add up to.
RECONCILED = {
    "heatwave": "heatwave_days",
    "cold": "coldsnap_days",
    "compound": "compound_days",
    "heavy_rain": "heavy_rain_days",
    "dry_spell": "dry_spell_days",
}

# Event types that have single events and can be filtered by season.
SEASONAL_TYPES = tuple(RECONCILED)


def _label(event_type: Column) -> Column:
    pairs = [F.lit(item) for pair in EVENT_LABELS.items() for item in pair]
    return F.create_map(*pairs)[event_type]


def complete_years(table_a: DataFrame, config: ClimateConfig) -> DataFrame:
    return table_a.filter(F.col("days_present_pct") >= config.valid_year_pct)


def trend_status(eligible: Column, slope: Column, p_value: Column) -> Column:
    significant = p_value < 0.05
    return (
        F.when(~F.coalesce(eligible, F.lit(False)), "Not enough years")
        .when(significant & (slope > 0), "Increasing (p<0.05)")
        .when(significant & (slope < 0), "Decreasing (p<0.05)")
        .otherwise("Not significant")
    )


def long_table(table_a: DataFrame, table_b: DataFrame, table_c: DataFrame, config: ClimateConfig) -> DataFrame:
    """One row per station, complete year and event type, trends and global values attached."""
    kept = [*STATION_COLUMNS, "year", "days_present_pct", *TOOLTIP_COLUMNS]
    values = [F.col(m).cast("double").alias(e) for e, m in TREND_MEASURES.items()]
    long = complete_years(table_a, config).unpivot(kept, values, "event_type", "value")
    attached = long.join(
        table_b.select("station_id", "event_type", *TREND_COLUMNS, *RISK_COLUMNS), ["station_id", "event_type"], "left"
    ).join(table_c.select("event_type", *GLOBAL_COLUMNS), "event_type", "left")
    return attached.withColumns(
        {
            "event_label": _label(F.col("event_type")),
            "trend_eligible": F.coalesce("trend_eligible", F.lit(False)),
            "trend_status": trend_status(F.col("trend_eligible"), F.col("trend_slope"), F.col("trend_p_value")),
        }
    ).select(
        *STATION_COLUMNS,
        "year",
        "days_present_pct",
        "event_type",
        "event_label",
        "value",
        *TOOLTIP_COLUMNS,
        *TREND_COLUMNS,
        "trend_status",
        *RISK_COLUMNS,
        *GLOBAL_COLUMNS,
    )


def season_table(table_a: DataFrame, table_e: DataFrame, config: ClimateConfig) -> DataFrame:
    """Events of complete years by season of their start, the year staying the start year."""
    years = complete_years(table_a, config).select("station_id", "year")
    stations = table_a.groupBy("station_id").agg(
        F.min_by(F.struct(*STATION_COLUMNS[1:]), "year").alias("station")
    )
    grouped = (
        table_e.withColumn("season", season(F.to_date("start_date")))
        .groupBy("station_id", "year", "season", "event_type")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum("duration_days").alias("event_days"),
            F.max("intensity_value").alias("max_intensity"),
        )
    )
    return (
        grouped.join(years, ["station_id", "year"], "left_semi")
        .join(stations, "station_id", "left")
        .select(
            "station_id",
            "station.*",
            "year",
            "season",
            "event_type",
            _label(F.col("event_type")).alias("event_label"),
            "events",
            "event_days",
            "max_intensity",
        )
    )


def reconciliation(table_a: DataFrame, seasons: DataFrame, config: ClimateConfig) -> DataFrame:
    """Event days by season against the yearly columns, per event type.

    Both sides meet in one grouping: a station-year that is missing on one side
    counts as zero there, as in a full outer join.
    """
    keys = ["event_type", "station_id", "year"]
    by_season = seasons.select(*keys, F.col("event_days").alias("season_days"), F.lit(None).cast("long").alias("year_days"))
    columns = [F.col(c).cast("long").alias(e) for e, c in RECONCILED.items()]
    by_year = (
        complete_years(table_a, config)
        .unpivot(["station_id", "year"], columns, "event_type", "year_days")
        .filter(F.col("year_days") > 0)
        .select(*keys, F.lit(None).cast("long").alias("season_days"), "year_days")
    )
    compared = (
        by_season.filter(F.col("event_type").isin(*RECONCILED))
        .unionByName(by_year)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum("season_days"), F.lit(0)).alias("season_days"),
            F.coalesce(F.sum("year_days"), F.lit(0)).alias("year_days"),
        )
    )
    return compared.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("station_years"),
        F.count_if(F.col("season_days") != F.col("year_days")).alias("differences"),
    )


def failing_event_types(report: DataFrame) -> list[str]:
    """Names of the event types that do not add up: at most five."""
    rows = report.filter(F.col("differences") > 0).select("event_type").collect()
    order = list(RECONCILED)
    return sorted((r["event_type"] for r in rows), key=order.index)


# ---- storyboard queries over the long and season tables -------------------


def choose(
    long: DataFrame,
    event_type: str | None = None,
    first_year: int | None = None,
    last_year: int | None = None,
    continent: str | None = None,
    country: str | None = None,
    region_name: str | None = None,
    season_name: str | None = None,
) -> DataFrame:
    """The global filters. A season applies to event measures only."""
    if season_name is not None and "season" not in long.columns:
        raise ValueError("season filter not available for a yearly value")
    chosen = long
    exact = {
        "event_type": event_type,
        "continent": continent,
        "country": country,
        "region_name": region_name,
        "season": season_name,
    }
    for name, wanted in exact.items():
        if wanted is not None:
            chosen = chosen.filter(F.col(name) == wanted)
    if first_year is not None:
        chosen = chosen.filter(F.col("year") >= first_year)
    if last_year is not None:
        chosen = chosen.filter(F.col("year") <= last_year)
    return chosen


def station_map(long: DataFrame) -> DataFrame:
    """Mean yearly value of every station and event type over the chosen years."""
    return long.groupBy("station_id", "event_type").agg(
        F.avg("value").alias("mean_value"), F.count("value").alias("years")
    )


def overview_figures(long: DataFrame, config: ClimateConfig) -> DataFrame:
    """Stations shown, mean per station-year, change against the baseline and worst year."""
    first, last = config.baseline_years
    by_year = long.groupBy("event_type", "year").agg(
        F.sum("value").alias("total"), F.count("value").alias("values")
    )
    stations = long.groupBy("event_type").agg(F.count_distinct("station_id").alias("stations"))
    baseline = F.col("year").between(first, last)
    worst = F.max_by("year", F.struct(F.col("total") / F.col("values"), -F.col("year")))
    figures = by_year.groupBy("event_type").agg(
        (F.sum("total") / F.sum("values")).alias("mean_value"),
        (
            F.sum("total") / F.sum("values")
            - F.sum(F.when(baseline, F.col("total"))) / F.sum(F.when(baseline, F.col("values")))
        ).alias("change_from_baseline"),
        worst.alias("worst_year"),
    )
    return stations.join(figures, "event_type")


def top_regions(long: DataFrame, event_type: str, limit: int = 10) -> DataFrame:
    return (
        long.filter(F.col("event_type") == event_type)
        .groupBy("region_name")
        .agg(F.avg("value").alias("mean_value"))
        .orderBy(F.desc("mean_value"), "region_name")
        .limit(limit)
    )


def top_risk(table_b: DataFrame, event_type: str, limit: int = 20) -> DataFrame:
    return (
        table_b.filter((F.col("event_type") == event_type) & F.col("risk_score").isNotNull())
        .select("station_id", "event_type", "risk_score", "risk_rank")
        .orderBy(F.desc("risk_score"), "risk_rank", "station_id")
        .limit(limit)
    )


def yearly_line_with_phases(long: DataFrame, phases: DataFrame) -> DataFrame:
    """Yearly mean per event type with the months of each phase in that year."""
    months = phases.groupBy("year").agg(
        F.count_if((F.col("enso_phase") == "El Nino") & ~F.col("provisional")).alias("el_nino_months"),
        F.count_if((F.col("enso_phase") == "La Nina") & ~F.col("provisional")).alias("la_nina_months"),
        F.count_if("provisional").alias("provisional_months"),
    )
    return (
        long.groupBy("event_type", "year")
        .agg(F.avg("value").alias("mean_value"))
        .join(months, "year", "left")
        .fillna(0, ["el_nino_months", "la_nina_months", "provisional_months"])
    )


def warm_dry_scatter(long: DataFrame) -> DataFrame:
    """Per station: mean heatwave days, mean longest dry spell and mean compound days."""

    def mean_of(event_type: str) -> Column:
        return F.avg(F.when(F.col("event_type") == event_type, F.col("value")))

    return long.groupBy("station_id").agg(
        mean_of("heatwave").alias("mean_heatwave_days"),
        mean_of("dry_spell").alias("mean_longest_dry_spell"),
        mean_of("compound").alias("mean_compound_days"),
    )


def region_comparison(long: DataFrame, left: str, right: str) -> DataFrame:
    """Mean of all six measures in two regions and their difference."""

    def mean_of(region: str) -> Column:
        return F.avg(F.when(F.col("region_name") == region, F.col("value")))

    return (
        long.filter(F.col("region_name").isin(left, right))
        .groupBy("event_type")
        .agg(mean_of(left).alias("left_mean"), mean_of(right).alias("right_mean"))
        .withColumn("difference", F.col("left_mean") - F.col("right_mean"))
    )
