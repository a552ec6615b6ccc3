"""Calendar columns: the 366-position circular calendar, years and seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stationwise.config import CALENDAR_DAYS

def calendar_day(date: Column) -> Column:
    """Position 1..366 of the month and day in a leap year (Feb 29 is 60)."""
    return F.dayofyear(F.make_date(F.lit(2000), F.month(date), F.dayofmonth(date)))


def month_of_calendar_day(position: Column) -> Column:
    """Month 1..12 of a position on the 366-day calendar."""
    return F.month(F.date_add(F.lit("2000-01-01").cast("date"), position - 1))


def shift_calendar_day(position: Column, offset: Column) -> Column:
    """Move a position by some days, wrapping around the year end."""
    return (F.pmod(position - 1 + offset, F.lit(CALENDAR_DAYS)) + 1).cast("int")


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def season(date: Column) -> Column:
    """Meteorological season of the month, the same in both hemispheres."""
    month = F.month(date)
    return (
        F.when(month.isin(12, 1, 2), "DJF")
        .when(month.isin(3, 4, 5), "MAM")
        .when(month.isin(6, 7, 8), "JJA")
        .when(month.isin(9, 10, 11), "SON")
    )


def percent_of_year(days: Column, year: Column) -> Column:
    """Share of the year's days in percent, two decimals."""
    return F.round(days / days_in_year(year) * 100.0, 2)
