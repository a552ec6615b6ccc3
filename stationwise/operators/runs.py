"""Consecutive-day runs (gaps and islands), found in month blocks and stitched.

A run is first found inside one (station, event type, year, month) block, which
holds at most 31 days, and only the block's runs are then joined across block
borders. No window ever sorts the whole daily record of a station, so one
station with most of the rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_COLUMNS = ["start_date", "end_date", "duration_days", "total_excess", "peak_excess"]


def minimum_length(min_days: Mapping[str, int], event_type: Column) -> Column:
    """Minimum duration of each event type; a type without a rule needs one day."""
    pairs = [F.lit(item) for pair in min_days.items() for item in pair]
    return F.coalesce(F.create_map(*pairs)[event_type], F.lit(1)) if pairs else F.lit(1)


def runs_within_months(days: DataFrame, one_day_types: Sequence[str] = ()) -> DataFrame:
    """Runs that do not look past the end of a calendar month.

    ``days`` has one row per qualifying (station_id, event_type, date) with a
    column ``excess``; a date without a row ends the run. If the rows are
    already hashed by (station_id, month) no shuffle is needed here. Days of a
    one-day type are never joined.
    """
    block = ["station_id", "month", "event_type", "year"]
    order = Window.partitionBy(*block).orderBy("date")
    island = F.date_sub("date", F.row_number().over(order))
    if one_day_types:
        island = F.when(F.col("event_type").isin(*one_day_types), F.col("date")).otherwise(island)
    if "month" not in days.columns:
        days = days.withColumn("month", F.month("date"))
    return (
        days.withColumn("year", F.year("date"))
        .withColumn("island", island)
        .groupBy(*block, "island")
        .agg(
            F.min("date").alias("start_date"),
            F.max("date").alias("end_date"),
            F.count(F.lit(1)).alias("duration_days"),
            F.sum("excess").alias("total_excess"),
            F.max("excess").alias("peak_excess"),
        )
        .select("station_id", "event_type", *RUN_COLUMNS)
    )


def stitch_runs(pieces: DataFrame, one_day_types: Sequence[str] = ()) -> DataFrame:
    """Join runs that continue on the day after the previous one ended."""
    order = Window.partitionBy("station_id", "event_type").orderBy("start_date")
    follows = F.date_sub("start_date", 1) == F.lag("end_date").over(order)
    if one_day_types:
        follows = follows & ~F.col("event_type").isin(*one_day_types)
    return (
        pieces.withColumn("new_run", F.when(follows, 0).otherwise(1))
        .withColumn("run_id", F.sum("new_run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("station_id", "event_type", "run_id")
        .agg(
            F.min("start_date").alias("start_date"),
            F.max("end_date").alias("end_date"),
            F.sum("duration_days").alias("duration_days"),
            F.sum("total_excess").alias("total_excess"),
            F.max("peak_excess").alias("peak_excess"),
        )
        .drop("run_id")
    )


def consecutive_runs(
    days: DataFrame, min_days: Mapping[str, int] | None = None, one_day_types: Sequence[str] = ()
) -> DataFrame:
    """All runs of the qualifying days that reach the minimum of their event type."""
    needed = minimum_length(min_days or {}, F.col("event_type"))
    pieces = runs_within_months(days, one_day_types)
    touches_border = (F.dayofmonth("start_date") == 1) | (F.col("end_date") == F.last_day("end_date"))
    worth_keeping = touches_border | (F.col("duration_days") >= needed)
    return stitch_runs(pieces.filter(worth_keeping), one_day_types).filter(F.col("duration_days") >= needed)


def overlapping_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Overlap interval of every left and right run of the same station.

    Both sides are placed in the calendar years they touch and meet on
    (station, year), so only runs of the same year are compared. A pair that
    meets in several years is kept once, in the year its overlap starts.
    """

    def by_year(runs: DataFrame, side: str) -> DataFrame:
        return runs.select(
            "station_id",
            F.col("start_date").alias(f"{side}_start"),
            F.col("end_date").alias(f"{side}_end"),
            F.explode(F.sequence(F.year("start_date"), F.year("end_date"))).alias("overlap_year"),
        )

    start = F.greatest("left_start", "right_start")
    end = F.least("left_end", "right_end")
    return (
        by_year(left, "left")
        .join(by_year(right, "right"), ["station_id", "overlap_year"])
        .filter((start <= end) & (F.year(start) == F.col("overlap_year")))
        .select(
            "station_id",
            start.alias("start_date"),
            end.alias("end_date"),
            (F.datediff(end, start) + 1).cast("long").alias("duration_days"),
        )
    )
