"""Completeness, valid years and station eligibility.

Everything derives from one yearly profile: counts per station and year that
combine on the map side, so a station with a long or hot record is reduced to
one row per year before any shuffle on the station alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationwise.config import ELEMENTS, ClimateConfig
from stationwise.functions.calendar import percent_of_year


def _in_baseline(config: ClimateConfig) -> Column:
    return F.col("date").between(F.lit(config.baseline_start), F.lit(config.baseline_end))


def all_present() -> Column:
    """All three variables observed on the same day."""
    return F.col("tmax").isNotNull() & F.col("tmin").isNotNull() & F.col("prcp").isNotNull()


def yearly_profile(wide: DataFrame, config: ClimateConfig) -> DataFrame:
    """Per station and year: complete days, their share, and baseline days per variable."""
    baseline_days = [
        F.count(F.when(_in_baseline(config), F.col(e.lower()))).alias(f"baseline_days_{e.lower()}")
        for e in ELEMENTS
    ]
    return (
        wide.groupBy("station_id", F.year("date").alias("year"))
        .agg(F.count_if(all_present()).alias("complete_days"), *baseline_days)
        .withColumn("days_present_pct", percent_of_year(F.col("complete_days"), F.col("year")))
    )


def valid_years(profile: DataFrame, config: ClimateConfig) -> DataFrame:
    """Station-years with enough complete days."""
    return profile.filter(F.col("days_present_pct") >= config.valid_year_pct).select(
        "station_id", "year", "complete_days", "days_present_pct"
    )


def completeness_report(profile: DataFrame, config: ClimateConfig) -> DataFrame:
    """Observed baseline days per station and variable against the fixed expectation."""
    expected = config.baseline_days
    totals = profile.groupBy("station_id").agg(
        *[F.sum(f"baseline_days_{e.lower()}").alias(e) for e in ELEMENTS]
    )
    return (
        totals.unpivot("station_id", list(ELEMENTS), "element", "observed_days")
        .filter(F.col("observed_days") > 0)
        .select(
            "station_id",
            "element",
            "observed_days",
            F.lit(expected).alias("expected_days"),
            F.round(F.col("observed_days") / expected * 100, 2).alias("completeness_percent"),
            F.when(F.col("observed_days") / expected >= config.element_completeness, "YES")
            .otherwise("NO")
            .alias("meets_80_percent"),
        )
    )


def passing_stations(completeness: DataFrame) -> DataFrame:
    """Per station: whether all three variables meet the completeness rule."""
    return completeness.groupBy("station_id").agg(
        (F.count_if(F.col("meets_80_percent") == "YES") == len(ELEMENTS)).alias("meets_80_all_variables")
    )


def station_scores(profile: DataFrame, config: ClimateConfig) -> DataFrame:
    """Eligibility with the baseline day counts, in one aggregation per station."""
    first, last = config.baseline_years
    valid = F.col("days_present_pct") >= config.valid_year_pct
    counts = [f"baseline_days_{e.lower()}" for e in ELEMENTS]
    scored = profile.groupBy("station_id").agg(
        F.count_if(valid & F.col("year").between(first, last)).alias("baseline_valid_years"),
        F.count_if(
            valid & F.col("year").between(config.trend_first_year, config.trend_last_year)
        ).alias("trend_valid_years"),
        *[F.sum(name).alias(name) for name in counts],
    )
    enough = [F.col(name) / config.baseline_days >= config.element_completeness for name in counts]
    return _with_flags(
        scored.withColumn("meets_80_all_variables", enough[0] & enough[1] & enough[2]), config
    )


def _with_flags(scored: DataFrame, config: ClimateConfig) -> DataFrame:
    return (
        scored.withColumn(
            "baseline_eligible",
            F.col("meets_80_all_variables")
            & (F.col("baseline_valid_years") >= config.min_baseline_valid_years),
        )
        .withColumn("enough_years_for_trend", F.col("trend_valid_years") >= config.min_trend_years)
        .withColumnRenamed(
            "trend_valid_years", f"valid_years_{config.trend_first_year}_{config.trend_last_year}"
        )
    )


def station_eligibility(
    profile: DataFrame, config: ClimateConfig, completeness: DataFrame | None = None
) -> DataFrame:
    """Six-column eligibility table, one row for every station seen.

    With a separate completeness table its YES/NO flags decide, and a station
    missing from it fails; without one the counts of the profile decide.
    """
    scores = station_scores(profile, config)
    years = f"valid_years_{config.trend_first_year}_{config.trend_last_year}"
    if completeness is not None:
        given = passing_stations(completeness)
        scores = (
            scores.drop("meets_80_all_variables", "baseline_eligible", "enough_years_for_trend")
            .withColumnRenamed(years, "trend_valid_years")
            .join(given, "station_id", "left")
            .fillna({"meets_80_all_variables": False})
        )
        scores = _with_flags(scores, config)
    return scores.select(
        "station_id",
        "baseline_valid_years",
        years,
        "meets_80_all_variables",
        "baseline_eligible",
        "enough_years_for_trend",
    )
