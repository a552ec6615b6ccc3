"""Day bitmaps: which days of a year a station observed a variable, as six words of 64 bits.

Long observations become one row per station and year in a single grouping: a bit per
day and variable, combined by ``bit_or`` on the map side. Repeated observations set a
bit that is set, so nothing has to be made distinct or pivoted to days first. Days on
which all variables are there are the intersection of their bitmaps, counted by bit.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationwise.config import ELEMENTS, ClimateConfig
from stationwise.functions.calendar import percent_of_year

WORD_BITS = 64
WORDS = 366 // WORD_BITS + 1


def _words(element: str) -> str:
    return f"{element.lower()}_bits"


def day_bitmaps(observations: DataFrame, elements: Sequence[str] = ELEMENTS) -> DataFrame:
    """(station_id, year, one array of words per element) from (station_id, date, element, value).

    Rows without a value, a date or a known element set no bit.
    """
    place = F.dayofyear("date") - 1
    seen = observations.filter(F.col("value").isNotNull() & F.col("date").isNotNull() & F.col("element").isin(*elements))
    marked = seen.select(
        "station_id",
        F.year("date").alias("year"),
        "element",
        F.floor(place / WORD_BITS).cast("int").alias("word"),
        # The shift counts modulo 64, so the place itself will do.
        F.expr("shiftleft(1L, dayofyear(date) - 1)").alias("bit"),
    )

    def word(element: str, number: int) -> Column:
        own = (F.col("element") == element) & (F.col("word") == number)
        return F.coalesce(F.bit_or(F.when(own, F.col("bit"))), F.lit(0).cast("long"))

    maps = [F.array(*[word(e, w) for w in range(WORDS)]).alias(_words(e)) for e in elements]
    return marked.groupBy("station_id", "year").agg(*maps)


def bits(words: Column) -> Column:
    """Number of days in a bitmap."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda total, w: total + F.bit_count(w))


def both(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a.bitwiseAND(b))


def mask(first: dt.date, last: dt.date) -> list[int]:
    """The bitmap of the days from ``first`` to ``last`` of one year, as signed words."""
    whole = sum(1 << (d - 1) for d in range(first.timetuple().tm_yday, last.timetuple().tm_yday + 1))
    words = [(whole >> (WORD_BITS * w)) & ((1 << WORD_BITS) - 1) for w in range(WORDS)]
    return [w - (1 << WORD_BITS) if w >> (WORD_BITS - 1) else w for w in words]


def within(first: dt.date, last: dt.date, year: Column) -> Column:
    """The bitmap of the days of a period that lie in the year."""

    def literal(words: list[int]) -> Column:
        return F.array(*[F.lit(w).cast("long") for w in words])

    if first.year == last.year:
        border = F.when(year == first.year, literal(mask(first, last)))
    else:
        border = F.when(year == first.year, literal(mask(first, dt.date(first.year, 12, 31)))).when(
            year == last.year, literal(mask(dt.date(last.year, 1, 1), last))
        )
    inside = (year > first.year) & (year < last.year)
    return border.when(inside, literal([-1] * WORDS)).otherwise(literal([0] * WORDS))


def bitmap_profile(bitmaps: DataFrame, config: ClimateConfig, elements: Sequence[str] = ELEMENTS) -> DataFrame:
    """The yearly profile (complete days, their share, baseline days per variable) of day bitmaps."""
    complete = F.col(_words(elements[0]))
    for e in elements[1:]:
        complete = both(complete, F.col(_words(e)))
    period = within(config.baseline_start, config.baseline_end, F.col("year"))
    return bitmaps.select(
        "station_id",
        "year",
        bits(complete).alias("complete_days"),
        *[bits(both(F.col(_words(e)), period)).alias(f"baseline_days_{e.lower()}") for e in elements],
    ).withColumn("days_present_pct", percent_of_year(F.col("complete_days"), F.col("year")))
