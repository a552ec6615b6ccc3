"""Station-year metrics (Table A) and the exported event table (Table E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationwise.config import (
    CALENDAR_DAYS,
    COLD_SNAP,
    COMPOUND,
    DRY_SPELL,
    HEATWAVE,
    SHORT_NAMES,
)
from stationwise.functions.calendar import percent_of_year
from stationwise.operators.completeness import all_present
from stationwise.operators.runs import consecutive_runs
from stationwise.operators.thresholds import threshold_coverage

METADATA_COLUMNS = ["station_name", "lat", "lon", "elevation_m"]
GEOGRAPHY_COLUMNS = ["region_name", "country", "continent"]

TABLE_A_COLUMNS = [
    "station_id",
    *METADATA_COLUMNS,
    *GEOGRAPHY_COLUMNS,
    "year",
    "days_present_pct",
    "hot_days",
    "heatwave_count",
    "heatwave_days",
    "heatwave_max_intensity",
    "cold_days",
    "coldsnap_count",
    "coldsnap_days",
    "heavy_rain_days",
    "max_daily_prcp_mm",
    "prcp_total_mm",
    "dry_spell_count",
    "dry_spell_days",
    "longest_dry_spell",
    "compound_event_count",
    "compound_days",
    "tmax_anomaly_mean",
]

TABLE_E_COLUMNS = [
    "station_id",
    "event_type",
    "start_date",
    "end_date",
    "duration_days",
    "intensity_value",
    "intensity_measure",
    "year",
]

# Yearly count columns are <prefix>_count and <prefix>_days.
METRIC_PREFIXES = {
    HEATWAVE: "heatwave",
    COLD_SNAP: "coldsnap",
    DRY_SPELL: "dry_spell",
    COMPOUND: "compound",
}

MISSING_ELEVATION = -999


def _event_measures() -> list[Column]:
    kind = F.col("event_type")
    measures = []
    for event_type, prefix in METRIC_PREFIXES.items():
        measures.append(F.count_if(kind == event_type).alias(f"{prefix}_count"))
        measures.append(F.sum(F.when(kind == event_type, F.col("duration_days"))).alias(f"{prefix}_days"))
    measures.append(
        F.max(F.when(kind == HEATWAVE, F.col("intensity_value"))).alias("heatwave_max_intensity")
    )
    return measures


def event_metrics_by_year(events: DataFrame) -> DataFrame:
    """Counts, days and strongest heatwave per station and start year, one aggregation."""
    return events.groupBy("station_id", F.year("start_date").alias("year")).agg(*_event_measures())


def dry_runs_any_length(flagged: DataFrame) -> DataFrame:
    """Runs of dry days of any length over all days, with or without thresholds."""
    days = flagged.filter(F.col("dry_flag") == 1).select(
        "station_id", "month", "date", F.lit("DRY_RUN").alias("event_type"), F.lit(1.0).alias("excess")
    )
    return consecutive_runs(days)


def longest_dry_run_by_year(flagged: DataFrame) -> DataFrame:
    """Longest dry run of the runs that start in the year."""
    return (
        dry_runs_any_length(flagged)
        .groupBy("station_id", F.year("start_date").alias("year"))
        .agg(F.max("duration_days").alias("longest_dry_spell"))
    )


def daily_metrics_by_year(flagged: DataFrame) -> DataFrame:
    """Completeness, threshold counts, rain and anomaly per station and year."""
    return (
        flagged.groupBy("station_id", F.year("date").alias("year"))
        .agg(
            F.count_if(all_present()).alias("complete_days"),
            F.sum("hot_flag").alias("hot_days"),
            F.sum("cold_flag").alias("cold_days"),
            F.sum("rain_flag").alias("heavy_rain_days"),
            F.max("prcp").alias("max_daily_prcp_mm"),
            F.sum("prcp").alias("prcp_total_mm"),
            F.count("prcp").alias("prcp_days"),
            F.round(F.avg(F.col("tmax") - F.col("baseline_mean_tmax")), 3).alias("tmax_anomaly_mean"),
        )
        .withColumn("days_present_pct", percent_of_year(F.col("complete_days"), F.col("year")))
    )


def _one_row_per_year(daily: DataFrame, events: DataFrame, dry: DataFrame) -> DataFrame:
    """Merge the three yearly tables in one grouping instead of a chain of joins.

    Only station-years with at least one daily row stay.
    """
    keys = ["station_id", "year"]
    merged = (
        daily.withColumn("has_days", F.lit(True))
        .unionByName(events, allowMissingColumns=True)
        .unionByName(dry, allowMissingColumns=True)
    )
    measures = [name for name in merged.columns if name not in keys]
    return (
        merged.groupBy(*keys)
        .agg(*[F.max(name).alias(name) for name in measures])
        .filter("has_days")
        .drop("has_days")
    )


def station_year_metrics(
    flagged: DataFrame,
    thresholds: DataFrame,
    events: DataFrame,
    metadata: DataFrame | None = None,
    geography: DataFrame | None = None,
) -> DataFrame:
    """Table A: one row per station and year that has any observation.

    A count is NULL when it cannot be known: a threshold count needs all 366
    thresholds of its variable, an event count needs a station with thresholds,
    and the longest dry spell needs rain observations in the year. A known
    count without any event is 0.
    """
    panel = _one_row_per_year(
        daily_metrics_by_year(flagged), event_metrics_by_year(events), longest_dry_run_by_year(flagged)
    ).join(threshold_coverage(thresholds), "station_id", "left")

    known = F.col("tmax_threshold_days").isNotNull()
    event_counts = [f"{p}_{suffix}" for p in METRIC_PREFIXES.values() for suffix in ("count", "days")]
    columns = {
        "hot_days": F.when(F.col("tmax_threshold_days") == CALENDAR_DAYS, F.col("hot_days")),
        "cold_days": F.when(F.col("tmin_threshold_days") == CALENDAR_DAYS, F.col("cold_days")),
        "heavy_rain_days": F.when(F.col("prcp_threshold_days") == CALENDAR_DAYS, F.col("heavy_rain_days")),
        "longest_dry_spell": F.when(
            known & (F.col("prcp_days") > 0), F.coalesce(F.col("longest_dry_spell"), F.lit(0))
        ),
    }
    for name in event_counts:
        columns[name] = F.when(known, F.coalesce(F.col(name), F.lit(0)))
    panel = panel.withColumns(columns).withColumnRenamed("compound_count", "compound_event_count")

    panel = _attach(panel, None if metadata is None else clean_metadata(metadata), METADATA_COLUMNS)
    panel = _attach(panel, geography, GEOGRAPHY_COLUMNS)
    return panel.select(*TABLE_A_COLUMNS)


def clean_metadata(metadata: DataFrame) -> DataFrame:
    """Station metadata with a missing elevation as NULL instead of -999.9."""
    elevation = F.col("elevation_m").cast("double")
    return metadata.select(
        "station_id",
        "station_name",
        F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"),
        F.when(elevation > MISSING_ELEVATION, elevation).alias("elevation_m"),
    )


def _attach(panel: DataFrame, stations: DataFrame | None, columns: list[str]) -> DataFrame:
    """Left join station attributes; typed NULLs when there is no table."""
    if stations is None:
        numeric = {"lat", "lon", "elevation_m"}
        return panel.withColumns(
            {c: F.lit(None).cast("double" if c in numeric else "string") for c in columns}
        )
    return panel.join(stations.select("station_id", *columns), "station_id", "left")


def station_events(events: DataFrame) -> DataFrame:
    """Table E: events with short type names and their start year."""
    pairs = [F.lit(item) for pair in SHORT_NAMES.items() for item in pair]
    short = F.coalesce(F.create_map(*pairs)[F.col("event_type")], F.col("event_type"))
    return (
        events.withColumn("event_type", short)
        .withColumn("year", F.year("start_date"))
        .select(*TABLE_E_COLUMNS)
    )
