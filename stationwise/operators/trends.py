"""Station summary (Table B): trends per station and event type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationwise.config import TREND_MEASURES, ClimateConfig
from stationwise.functions.stats import (
    mann_kendall_s,
    mann_kendall_variance,
    mann_kendall_z,
    theil_sen_slope,
    two_sided_p,
)

STATION_COLUMNS = ["lat", "lon", "region_name", "country", "continent"]

TABLE_B_COLUMNS = [
    "station_id",
    *STATION_COLUMNS,
    "event_type",
    "trend_slope",
    "trend_p_value",
    "years_used",
    "trend_eligible",
    "risk_score",
    "risk_rank",
    "gi_z_score",
    "gi_p_value",
    "hotspot_class",
]


def counts_for_trend(config: ClimateConfig) -> Column:
    """Valid years inside the trend window."""
    return F.col("year").between(config.trend_first_year, config.trend_last_year) & (
        F.col("days_present_pct") >= config.valid_year_pct
    )


def yearly_series(table_a: DataFrame, config: ClimateConfig) -> DataFrame:
    """One row per station and event type with its ordered (year, value) series.

    All six measures travel in one grouping per station. A station-year is
    unique, so an array never exceeds the trend window.
    """
    measures = list(TREND_MEASURES.values())
    for name in ("station_id", "year", "days_present_pct", *STATION_COLUMNS, *measures):
        if name not in table_a.columns:
            raise ValueError(f"the yearly table has no column {name!r}")

    year_row = F.struct("year", *[F.col(m).cast("double").alias(m) for m in measures])
    stations = table_a.groupBy("station_id").agg(
        F.max_by(F.struct(*STATION_COLUMNS), "year").alias("station"),
        F.array_sort(F.collect_list(F.when(counts_for_trend(config), year_row))).alias("years"),
    )

    def series_of(event_type: str, measure: str) -> Column:
        present = F.filter("years", lambda item: item[measure].isNotNull())
        return F.struct(
            F.lit(event_type).alias("event_type"),
            F.transform(
                present, lambda item: F.struct(item["year"].alias("year"), item[measure].alias("value"))
            ).alias("series"),
        )

    return stations.select(
        "station_id",
        "station.*",
        F.explode(F.array(*[series_of(e, m) for e, m in TREND_MEASURES.items()])).alias("item"),
    ).select("station_id", *STATION_COLUMNS, "item.event_type", "item.series")


def trend_columns(series: DataFrame) -> DataFrame:
    """Slope per year, Mann-Kendall S, variance, z and p of each series."""
    items = F.col("series")
    with_test = series.withColumns(
        {
            "slope_per_year": theil_sen_slope(items),
            "mk_s": mann_kendall_s(items),
            "mk_variance": mann_kendall_variance(items),
        }
    )
    return with_test.withColumn("mk_z", mann_kendall_z(F.col("mk_s"), F.col("mk_variance"))).withColumn(
        "mk_p", two_sided_p(F.col("mk_z"))
    )


def station_summary(table_a: DataFrame, config: ClimateConfig) -> DataFrame:
    """Table B: six rows per station; slope per decade and p only if eligible."""
    series = yearly_series(table_a, config).withColumn("years_used", F.size("series"))
    eligible = F.col("years_used") >= config.min_trend_years
    series = series.withColumn("trend_eligible", eligible).withColumn(
        "series", F.when(eligible, F.col("series"))
    )
    return trend_columns(series).select(
        "station_id",
        *STATION_COLUMNS,
        "event_type",
        F.bround(F.col("slope_per_year") * 10.0, 3).alias("trend_slope"),
        F.bround("mk_p", 4).alias("trend_p_value"),
        "years_used",
        "trend_eligible",
        F.lit(None).cast("double").alias("risk_score"),
        F.lit(None).cast("int").alias("risk_rank"),
        F.lit(None).cast("double").alias("gi_z_score"),
        F.lit(None).cast("double").alias("gi_p_value"),
        F.lit(None).cast("string").alias("hotspot_class"),
    )
