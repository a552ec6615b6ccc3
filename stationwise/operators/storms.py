"""Comparison of detected events with an external storm record, by state and day."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationwise.config import STORM_CATEGORIES, StormConfig
from stationwise.operators.intervals import merged_spans, span_days, widened

PLACE = ["category", "state"]
CATEGORY_DAYS = [*PLACE, "day"]
OUTPUT_COLUMNS = [
    "category",
    "stations",
    "states",
    "detected_state_days",
    "precision",
    "storm_state_days",
    "recall",
    "base_rate",
    "lift",
]


def record_timestamp(text: Column) -> Column:
    """Day of a '11-JUL-23 12:00:00' text; NULL when it is not one.

    Two-digit years 69 to 99 belong to the last century.
    """
    day = F.to_date(F.try_to_timestamp(text, F.lit("dd-MMM-yy HH:mm:ss")))
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)


def capped_end(begin: Column, end: Column, max_days: int | None) -> Column:
    """End not before the begin and, if a limit is set, not more than ``max_days`` after it."""
    end = F.greatest(begin, end)
    return end if max_days is None else F.least(end, F.date_add(begin, max_days))


def days_cut(begin: Column, end: Column, max_days: int | None) -> Column:
    """Days that the limit takes from an interval, for reports."""
    return F.datediff(F.greatest(begin, end), capped_end(begin, end, max_days))


def _by_category(frame: DataFrame, column: str, lists: Mapping[str, list[str]]) -> DataFrame:
    """One row per category an event type belongs to; other types drop out."""
    names = F.array_compact(
        F.array(*[F.when(F.col(column).isin(*types), F.lit(name)) for name, types in lists.items()])
    )
    return frame.withColumn("category", F.explode(names))


def storm_spans(storm: DataFrame, config: StormConfig, categories: Mapping[str, list[str]]) -> DataFrame:
    """Union of the recorded intervals per category and state."""
    dated = (
        _by_category(storm, "EVENT_TYPE", categories)
        .select(
            "category",
            F.upper("STATE").alias("state"),
            record_timestamp(F.col("BEGIN_DATE_TIME")).alias("begin"),
            record_timestamp(F.col("END_DATE_TIME")).alias("end"),
        )
        .filter(F.col("begin").isNotNull() & F.col("end").isNotNull())
        .withColumn("end", capped_end(F.col("begin"), F.col("end"), config.max_record_days))
    )
    return merged_spans(dated, "begin", "end", PLACE)


def storm_state_days(storm: DataFrame, config: StormConfig, categories: Mapping[str, list[str]]) -> DataFrame:
    """Distinct (category, state, day) of the storm record; overlapping records are one before they become days."""
    return span_days(storm_spans(storm, config, categories), PLACE)


def covered_stations(geography: DataFrame, config: StormConfig) -> DataFrame:
    """Stations of the country that have a region name, with its upper-case form."""
    return geography.filter(
        (F.col("country") == config.country) & F.col("region_name").isNotNull()
    ).select("station_id", F.upper("region_name").alias("state"))


def near_days(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """Rows of ``left`` with a ``right`` day in the same category and state within the tolerance.

    The right days grow by the tolerance on both sides and are merged before they
    become days again, for an equi semi join instead of a range condition.
    """
    spans = merged_spans(right, F.date_sub("day", tolerance), F.date_add("day", tolerance), PLACE)
    return left.join(span_days(spans, PLACE), CATEGORY_DAYS, "left_semi")


def matched_days(detected: DataFrame, recorded: DataFrame, tolerance: int) -> DataFrame:
    """Per category: days of both span tables, and those with a day of the other within the tolerance.

    Four day sets, each without repeats, meet in one grouping by category, state and
    day; nothing is joined.
    """
    marks = ("detected", "near_detected", "recorded", "near_recorded")
    sets = (detected, widened(detected, tolerance, PLACE), recorded, widened(recorded, tolerance, PLACE))
    tagged = [span_days(s, PLACE).withColumn("mark", F.lit(m)) for m, s in zip(marks, sets)]
    union = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])
    days = union.groupBy(*CATEGORY_DAYS).agg(*[F.max(F.col("mark") == m).alias(m) for m in marks])
    return days.groupBy("category").agg(
        F.count_if("detected").alias("detected_state_days"),
        F.count_if(F.col("detected") & F.col("near_recorded")).alias("matched_detected"),
        F.count_if("recorded").alias("storm_state_days"),
        F.count_if(F.col("recorded") & F.col("near_detected")).alias("matched_storm"),
    )


def validate_events(
    events: DataFrame,
    storm: DataFrame,
    geography: DataFrame,
    config: StormConfig = StormConfig(),
    categories: Mapping[str, tuple[list[str], list[str]]] = STORM_CATEGORIES,
) -> DataFrame:
    """One row per category: counts, precision, recall, base rate and lift."""
    ours = {name: mine for name, (mine, _) in categories.items()}
    theirs = {name: types for name, (_, types) in categories.items()}
    stations = covered_stations(geography, config)
    year = F.expr("try_cast(YEAR AS INT)")
    first = F.make_date(storm.agg(F.min(year)).scalar(), F.lit(1), F.lit(1))
    last = F.make_date(storm.agg(F.max(year)).scalar(), F.lit(12), F.lit(31))
    in_window = (
        _by_category(events.join(stations, "station_id"), "event_type", ours)
        .filter(F.col("start_date").between(first, last))
        .withColumn("end_date", F.least(F.col("end_date"), last))
    )
    detected = merged_spans(in_window, "start_date", "end_date", PLACE)
    states = stations.select("state").distinct()
    recorded = storm_spans(storm, config, theirs).join(states, "state", "left_semi")
    spark = events.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in categories])).alias("category"))
    network = in_window.groupBy("category").agg(
        F.count_distinct("station_id").alias("stations"), F.count_distinct("state").alias("states")
    )
    days = matched_days(detected, recorded, config.tolerance_days)
    totals = names.join(network, "category", "left").join(days, "category", "left")
    covered = states.agg(F.count(F.lit(1))).scalar()
    state_days = covered * (F.datediff(last, first) + 1)
    totals = totals.fillna(0)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole)

    return (
        totals.withColumns(
            {
                "precision": share(F.col("matched_detected"), F.col("detected_state_days")),
                "recall": share(F.col("matched_storm"), F.col("storm_state_days")),
                "base_rate": share(F.col("storm_state_days"), state_days),
            }
        )
        .withColumn("lift", F.bround(share(F.col("precision"), F.col("base_rate")), 1))
        .withColumns({name: F.bround(name, 4) for name in ("precision", "recall", "base_rate")})
        .select(*OUTPUT_COLUMNS)
    )
