"""Station-relative thresholds and baseline means on the circular calendar.

The temperature window touches 15 calendar days for every target day. Sending
15 copies of each observation through the shuffle is avoided by cutting the
calendar into month tiles: an observation reaches at most two tiles, so the
shuffle carries about 1.5 copies, and the windows are cut inside the tile's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationwise.config import CALENDAR_DAYS, ClimateConfig
from stationwise.functions.calendar import calendar_day, month_of_calendar_day, shift_calendar_day


def baseline_slice(frame: DataFrame, config: ClimateConfig) -> DataFrame:
    """Rows of the baseline period; the range reaches the Parquet scan."""
    return frame.filter(
        (F.col("date") >= F.lit(config.baseline_start)) & (F.col("date") <= F.lit(config.baseline_end))
    )


def eligible_stations(completeness: DataFrame, eligibility: DataFrame | None = None) -> DataFrame:
    """Station ids that may have thresholds.

    Without the eligibility table only the per-variable rule applies.
    """
    passing = (
        completeness.groupBy("station_id")
        .agg(F.count_if(F.col("meets_80_percent") == "YES").alias("passing"))
        .filter(F.col("passing") == 3)
        .select("station_id")
    )
    if eligibility is None:
        return passing
    return passing.join(eligibility.filter("baseline_eligible").select("station_id"), "station_id", "left_semi")


def _percentile(column: str, p: float, config: ClimateConfig, exact: bool) -> Column:
    if exact:
        return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")
    return F.percentile_approx(column, p, config.percentile_accuracy)


def _values_by_tile(days: DataFrame, config: ClimateConfig) -> DataFrame:
    """One row per (station, tile): its calendar days with their values.

    A calendar day has at most one value per baseline year, and a tile needs
    its own month and the days of the window around it.
    """
    position = F.col("calendar_day")
    reach = F.array(*[
        month_of_calendar_day(shift_calendar_day(position, F.lit(offset)))
        for offset in (-config.window_days, config.window_days)
    ])
    return (
        days.withColumn("tile", F.explode(F.array_distinct(reach)))
        .repartition("station_id", "tile")
        .groupBy("station_id", "tile", "calendar_day")
        .agg(F.collect_list("tmax").alias("tmax"), F.collect_list("tmin").alias("tmin"))
        .groupBy("station_id", "tile")
        .agg(F.collect_list(F.struct("calendar_day", "tmax", "tmin")).alias("days"))
    )


def _at_rank(ordered: Column, p: float) -> Column:
    """Discrete percentile of a sorted array; NULL when it is empty."""
    size = F.size(ordered)
    return F.when(size > 0, F.element_at(ordered, F.greatest(F.lit(1), F.ceil(F.lit(p) * size).cast("int"))))


def window_thresholds(wide_baseline: DataFrame, config: ClimateConfig) -> DataFrame:
    """Hot and cold thresholds per station and calendar day, side by side.

    The percentiles are exact: each target day sorts the few hundred values of
    its window inside the row of its tile. The window must be narrower than a
    month tile (at most 14 days each side).
    """
    if config.window_days > 14:
        raise ValueError("the calendar window must stay within a month tile")
    days = wide_baseline.select(
        "station_id", calendar_day(F.col("date")).alias("calendar_day"), "tmax", "tmin"
    ).filter(F.col("tmax").isNotNull() | F.col("tmin").isNotNull())
    half = config.window_days
    target = F.col("target_calendar_day")
    first = F.make_date(F.lit(2000), F.col("tile"), F.lit(1))
    tile_days = F.sequence(F.dayofyear(first), F.dayofyear(F.last_day(first)))

    def in_window(day: Column, center: Column) -> Column:
        return F.pmod(day["calendar_day"] - center + half, F.lit(CALENDAR_DAYS)) <= 2 * half

    reached = F.filter(tile_days, lambda center: F.exists("days", lambda d: in_window(d, center)))
    near = F.filter("days", lambda d: in_window(d, target))

    def ordered(name: str) -> Column:
        return F.sort_array(F.flatten(F.transform("near", lambda d: d[name])))

    return (
        _values_by_tile(days, config)
        .withColumn("target_calendar_day", F.explode(reached))
        .withColumn("near", near)
        .select("station_id", target, ordered("tmax").alias("tmax"), ordered("tmin").alias("tmin"))
        .select(
            "station_id",
            target,
            _at_rank(F.col("tmax"), config.hot_percentile).alias("tmax_threshold"),
            _at_rank(F.col("tmin"), config.cold_percentile).alias("tmin_threshold"),
        )
    )


def annual_rain_threshold(wide_baseline: DataFrame, config: ClimateConfig, exact: bool = False) -> DataFrame:
    """One wet-day percentile per station. Sketches merge on the map side."""
    return (
        wide_baseline.filter(F.col("prcp") >= config.wet_day_mm)
        .groupBy("station_id")
        .agg(_percentile("prcp", config.rain_percentile, config, exact).alias("prcp_threshold"))
    )


def _percent_label(p: float) -> str:
    number = round(p * 100)
    ending = "th" if number % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(number % 10, "th")
    return f"{number}{ending}"


def threshold_table(wide_baseline: DataFrame, config: ClimateConfig, exact: bool = False) -> DataFrame:
    """All thresholds in long form, with unit, definition and baseline columns.

    ``exact`` concerns the annual rain percentile, a mergeable sketch otherwise.
    """
    window = window_thresholds(wide_baseline, config)
    temperature = window.unpivot(
        ["station_id", "target_calendar_day"],
        [F.col("tmax_threshold").alias("TMAX"), F.col("tmin_threshold").alias("TMIN")],
        "element",
        "threshold",
    ).filter(F.col("threshold").isNotNull())
    rain = annual_rain_threshold(wide_baseline, config, exact).select(
        "station_id",
        F.lit("PRCP").alias("element"),
        F.explode(F.sequence(F.lit(1), F.lit(CALENDAR_DAYS))).alias("target_calendar_day"),
        F.col("prcp_threshold").alias("threshold"),
    )
    element = F.col("element")
    wet = f"(>= {config.wet_day_mm:g} mm)"
    return (
        temperature.select("station_id", "element", "target_calendar_day", "threshold")
        .unionByName(rain)
        .select(
            "station_id",
            "element",
            "target_calendar_day",
            "threshold",
            F.when(element == "PRCP", "mm").otherwise("degrees_C").alias("threshold_unit"),
            F.when(element == "TMAX", f"{_percent_label(config.hot_percentile)} percentile of baseline TMAX")
            .when(element == "TMIN", f"{_percent_label(config.cold_percentile)} percentile of baseline TMIN")
            .otherwise(
                f"{_percent_label(config.rain_percentile)} percentile of baseline wet-day PRCP {wet}, "
                "annual per station"
            )
            .alias("threshold_definition"),
            F.lit(config.baseline_start.isoformat()).alias("baseline_start"),
            F.lit(config.baseline_end.isoformat()).alias("baseline_end"),
            F.lit(config.window_days).alias("window_days_each_side"),
            F.lit(CALENDAR_DAYS).alias("calendar_days"),
        )
    )


def baseline_means(wide_baseline: DataFrame, config: ClimateConfig) -> DataFrame:
    """Mean TMAX over the window per station and calendar day.

    Sums and counts per calendar day come first, so only 366 rows per station
    are spread over the window.
    """
    half = config.window_days
    per_day = (
        wide_baseline.filter(F.col("tmax").isNotNull())
        .groupBy("station_id", calendar_day(F.col("date")).alias("calendar_day"))
        .agg(F.sum("tmax").alias("total"), F.count("tmax").alias("days"))
    )
    return (
        per_day.withColumn("offset", F.explode(F.sequence(F.lit(-half), F.lit(half))))
        .groupBy(
            "station_id",
            shift_calendar_day(F.col("calendar_day"), F.col("offset")).alias("target_calendar_day"),
        )
        .agg(F.sum("total").alias("total"), F.sum("days").alias("n_obs"))
        .select(
            "station_id",
            "target_calendar_day",
            (F.col("total") / F.col("n_obs")).alias("baseline_mean_tmax"),
            "n_obs",
        )
    )


def threshold_coverage(thresholds: DataFrame) -> DataFrame:
    """Per station: how many calendar days have a threshold, by variable."""
    return thresholds.groupBy("station_id").agg(
        *[
            F.count(F.when(F.col("element") == e, F.col("threshold"))).alias(f"{e.lower()}_threshold_days")
            for e in ("TMAX", "TMIN", "PRCP")
        ]
    )
