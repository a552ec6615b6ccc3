"""Daily observations: quality filter, wide days and back to long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationwise.config import ELEMENTS

MISSING_VALUE = -9999


def keep_valid(
    frame: DataFrame,
    date: str = "date",
    value: str = "raw_value",
    quality_flag: str = "quality_flag",
) -> DataFrame:
    """Rows with a real date, a value that is not the missing mark, and no quality flag."""
    return frame.filter(
        F.col(date).isNotNull()
        & F.col(value).isNotNull()
        & (F.col(value) != MISSING_VALUE)
        & (F.trim(F.col(quality_flag)) == "")
    )


def _element_value(element: str) -> Column:
    return F.max(F.when(F.col("element") == element, F.col("value"))).alias(element.lower())


def daily_wide(observations: DataFrame) -> DataFrame:
    """One row per station and date with tmax, tmin and prcp side by side.

    The three conditional maxima combine on the map side and need one shuffle
    on (station, date), which no single station can dominate. A duplicate
    observation of one element and day resolves to its largest value.
    """
    return (
        observations.filter(
            F.col("station_id").isNotNull()
            & F.col("date").isNotNull()
            & F.col("element").isin(*ELEMENTS)
            & F.col("value").isNotNull()
        )
        .groupBy("station_id", F.to_date("date").alias("date"))
        .agg(*[_element_value(element) for element in ELEMENTS])
    )


def wide_to_long(wide: DataFrame) -> DataFrame:
    """Back to (station_id, date, element, value), without missing values."""
    return wide.select(
        "station_id",
        "date",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(e).alias("element"), F.col(e.lower()).alias("value"))
                    for e in ELEMENTS
                ]
            )
        ).alias("item"),
    ).select("station_id", "date", "item.element", "item.value").filter(F.col("value").isNotNull())
