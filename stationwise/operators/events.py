"""Daily flags and the five event types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationwise.config import COLD_SNAP, COMPOUND, DRY_SPELL, HEATWAVE, HEAVY_RAIN, ClimateConfig
from stationwise.functions.calendar import calendar_day, month_of_calendar_day
from stationwise.operators.runs import consecutive_runs, overlapping_runs

EVENT_COLUMNS = [
    "station_id",
    "event_type",
    "start_date",
    "end_date",
    "duration_days",
    "intensity_value",
    "intensity_measure",
]

CLIMATE_COLUMNS = ["tmax_threshold", "tmin_threshold", "prcp_threshold", "baseline_mean_tmax"]


def climatology_months(thresholds: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Thresholds and means of one station and month packed into one row.

    A row holds at most 31 calendar days, so a month of daily rows finds all
    its thresholds through one join row, and the daily side stays grouped by
    (station, month) for the run search that follows.
    """
    position = F.col("target_calendar_day")
    rows = thresholds.select("station_id", position, "element", "threshold", F.lit(None).cast("double").alias("mean"))
    if means is not None:
        rows = rows.unionByName(
            means.select(
                "station_id",
                position,
                F.lit("MEAN").alias("element"),
                F.lit(None).cast("double").alias("threshold"),
                F.col("baseline_mean_tmax").alias("mean"),
            )
        )
    is_threshold = F.col("element").isin("TMAX", "TMIN", "PRCP")

    def threshold_of(element: str) -> Column:
        return F.max(F.when(F.col("element") == element, F.col("threshold")))

    return (
        rows.withColumn("month", month_of_calendar_day(position))
        .repartition("station_id", "month")
        .groupBy("station_id", "month", "target_calendar_day")
        .agg(
            threshold_of("TMAX").alias("tmax_threshold"),
            threshold_of("TMIN").alias("tmin_threshold"),
            threshold_of("PRCP").alias("prcp_threshold"),
            F.max("mean").alias("baseline_mean_tmax"),
            F.max(is_threshold).alias("has_thresholds"),
        )
        .groupBy("station_id", "month")
        .agg(
            F.map_from_entries(
                F.collect_list(
                    F.struct("target_calendar_day", F.struct(*CLIMATE_COLUMNS, "has_thresholds"))
                )
            ).alias("climatology")
        )
    )


def flag_days(wide: DataFrame, thresholds: DataFrame, config: ClimateConfig, means: DataFrame | None = None) -> DataFrame:
    """Every wide day with its thresholds, 0/1 flags and exceedances.

    Days without thresholds stay in, with ``has_thresholds`` false: the yearly
    panel needs them, event detection drops them. Comparisons are strict.
    """
    packed = climatology_months(thresholds, means)
    days = wide.withColumn("month", F.month("date")).join(packed, ["station_id", "month"], "left")
    found = F.col("climatology")[calendar_day(F.col("date"))]
    days = days.withColumn("found", found).select(
        "station_id",
        "month",
        "date",
        "tmax",
        "tmin",
        "prcp",
        *[F.col(f"found.{name}").alias(name) for name in CLIMATE_COLUMNS],
        F.coalesce(F.col("found.has_thresholds"), F.lit(False)).alias("has_thresholds"),
    )
    conditions = {
        "hot": F.col("tmax") > F.col("tmax_threshold"),
        "cold": F.col("tmin") < F.col("tmin_threshold"),
        "dry": F.col("prcp") < config.wet_day_mm,
        "rain": F.col("prcp") > F.col("prcp_threshold"),
    }
    return days.withColumns(
        {f"{name}_flag": F.when(condition, 1).otherwise(0) for name, condition in conditions.items()}
    ).withColumns(
        {
            "heat_excess": F.when(F.col("hot_flag") == 1, F.col("tmax") - F.col("tmax_threshold")),
            "cold_deficit": F.when(F.col("cold_flag") == 1, F.col("tmin_threshold") - F.col("tmin")),
            "rain_excess": F.when(F.col("rain_flag") == 1, F.col("prcp") - F.col("prcp_threshold")),
            "rain_deficit": F.when(F.col("dry_flag") == 1, F.lit(config.wet_day_mm) - F.col("prcp")),
        }
    )


def qualifying_days(flagged: DataFrame) -> DataFrame:
    """One row per flagged condition of a day with thresholds: hot, cold, dry or heavy rain."""

    def condition(event_type: str, flag: str, excess: str) -> Column:
        return F.when(
            F.col(flag) == 1, F.struct(F.lit(event_type).alias("event_type"), F.col(excess).alias("excess"))
        )

    conditions = F.array(
        condition(HEATWAVE, "hot_flag", "heat_excess"),
        condition(COLD_SNAP, "cold_flag", "cold_deficit"),
        condition(DRY_SPELL, "dry_flag", "rain_deficit"),
        condition(HEAVY_RAIN, "rain_flag", "rain_excess"),
    )
    return (
        flagged.filter("has_thresholds")
        .select("station_id", "month", "date", F.explode(F.array_compact(conditions)).alias("item"))
        .select("station_id", "month", "date", "item.event_type", "item.excess")
    )


def _as_events(runs: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    by_duration = kind.isin(DRY_SPELL, COMPOUND)
    return runs.select(
        "station_id",
        "event_type",
        "start_date",
        "end_date",
        "duration_days",
        F.when(by_duration, F.col("duration_days").cast("double"))
        .otherwise(F.col("peak_excess"))
        .alias("intensity_value"),
        F.when(kind == HEATWAVE, "max TMAX exceedance (degrees_C)")
        .when(kind == COLD_SNAP, "max TMIN deficit (degrees_C)")
        .when(kind == DRY_SPELL, "duration (days)")
        .when(kind == HEAVY_RAIN, "rainfall excess (mm)")
        .otherwise("overlap duration (days)")
        .alias("intensity_measure"),
    )


def run_events(flagged: DataFrame, config: ClimateConfig) -> DataFrame:
    """Heatwaves, cold snaps, dry spells and heavy-rain days from one pass.

    A heavy-rain day is an event of its own, never part of a longer run.
    """
    return _as_events(
        consecutive_runs(qualifying_days(flagged), config.min_run_days(), one_day_types=[HEAVY_RAIN])
    )


def compound_events(events: DataFrame) -> DataFrame:
    """Overlap of every qualifying heatwave and dry spell, as a binned interval join."""
    overlap = overlapping_runs(
        events.filter(F.col("event_type") == HEATWAVE), events.filter(F.col("event_type") == DRY_SPELL)
    )
    return _as_events(
        overlap.withColumn("event_type", F.lit(COMPOUND)).withColumn("peak_excess", F.lit(None).cast("double"))
    )


def with_compound_events(events: DataFrame) -> DataFrame:
    """The events plus their compound overlaps, reading the events only once.

    Heatwaves and dry spells meet inside their (station, year) group, which
    holds at most one run per two days of the year. A pair that meets in two
    years is kept in the year its overlap starts.
    """
    kind = F.col("event_type")
    span = F.struct("start_date", "end_date")
    in_start_year = F.year("start_date") == F.col("overlap_year")
    grouped = (
        events.withColumn("overlap_year", F.explode(F.sequence(F.year("start_date"), F.year("end_date"))))
        .groupBy("station_id", "overlap_year")
        .agg(
            F.collect_list(F.when(kind == HEATWAVE, span)).alias("heat"),
            F.collect_list(F.when(kind == DRY_SPELL, span)).alias("dry"),
            F.collect_list(F.when(in_start_year, F.struct(*EVENT_COLUMNS[1:]))).alias("events"),
        )
    )

    def overlap(h: Column, d: Column) -> Column:
        start = F.greatest(h["start_date"], d["start_date"])
        end = F.least(h["end_date"], d["end_date"])
        days = (F.datediff(end, start) + 1).cast("long")
        return F.when(
            (start <= end) & (F.year(start) == F.col("overlap_year")),
            F.struct(
                F.lit(COMPOUND).alias("event_type"),
                start.alias("start_date"),
                end.alias("end_date"),
                days.alias("duration_days"),
                days.cast("double").alias("intensity_value"),
                F.lit("overlap duration (days)").alias("intensity_measure"),
            ),
        )

    pairs = F.flatten(F.transform("heat", lambda h: F.transform("dry", lambda d: overlap(h, d))))
    return grouped.select(
        "station_id", F.explode(F.concat(F.col("events"), F.array_compact(pairs))).alias("event")
    ).select("station_id", "event.*")


def detect_events(flagged: DataFrame, config: ClimateConfig) -> DataFrame:
    """All five event types in one table."""
    return with_compound_events(run_events(flagged, config)).select(*EVENT_COLUMNS)
