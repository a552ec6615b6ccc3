"""Day intervals: how many are open on a day (sweep line) and their union.

Neither form turns an interval into its days before the aggregate: an interval is
two rows at most, however long it is, and days come out of the few intervals that
are left. Ends belong to the interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Field = str | Column


def _column(field: Field) -> Column:
    return F.col(field) if isinstance(field, str) else field


def days_open(
    spans: DataFrame, begin: Field, end: Field, keys: Sequence[str] = (), name: str = "open", weight: Field | None = None
) -> DataFrame:
    """(keys, day, number of open intervals) for every day on which one is open.

    Every interval counts +1 (or its weight) at its begin and -1 after its end.
    Those changes are added up per day on the map side, so a hot key has at most
    one row per day of the calendar afterwards. The running sum is kept within
    years; what a year hands on to the next is added up from one row per year.
    Intervals without a begin or an end are left out, as are those that end
    before they begin.
    """
    keys = list(keys)
    step = F.lit(1).cast("long") if weight is None else _column(weight).cast("long")
    edges = F.array(
        F.struct(_column(begin).alias("day"), step.alias("step")),
        F.struct(F.date_add(_column(end), 1).alias("day"), (-step).alias("step")),
    )
    valid = spans.filter(_column(begin) <= _column(end))
    changes = (
        valid.select(*keys, F.inline(edges))
        .groupBy(*keys, "day")
        .agg(F.sum("step").alias("step"))
        .filter(F.col("step") != 0)
        .withColumn("year", F.year("day"))
    )
    years = changes.groupBy(*keys, "year").agg(F.sum("step").alias("total"), F.min("day").alias("first"))
    in_order = F.array_sort(F.collect_list(F.struct("year", "total", "first")))
    # Carried in from earlier years, and the day on which the next change follows.
    carried = F.transform(
        F.col("listed"),
        lambda y, i: F.struct(
            y["year"].alias("year"),
            F.aggregate(F.slice("listed", 1, i), F.lit(0).cast("long"), lambda total, x: total + x["total"]).alias("carry"),
            F.get(F.col("listed"), i + 1)["first"].alias("following"),
        ),
    )
    borders = years.groupBy(*keys).agg(in_order.alias("listed")).select(*keys, F.inline(carried))
    order = Window.partitionBy(*keys, "year").orderBy("day")
    running = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("carry")
    until = F.coalesce(F.lead("day").over(order), F.col("following"))
    stretches = changes.join(borders, [*keys, "year"]).select(*keys, "day", running.alias(name), until.alias("until"))
    days = F.explode(F.sequence("day", F.date_sub("until", 1)))
    return stretches.filter((F.col(name) > 0) & F.col("until").isNotNull()).select(*keys, days.alias("day"), name)


def merged_spans(spans: DataFrame, begin: Field, end: Field, keys: Sequence[str]) -> DataFrame:
    """(keys, begin, end): the union of the intervals of a key, as intervals that neither overlap nor touch.

    Of intervals with one begin the longest is taken first, on the map side, so a
    hot key is at most one row per day of the calendar when it is put in order.
    """
    keys = list(keys)
    first, last = _column(begin), _column(end)
    longest = (
        spans.filter(first <= last)
        .select(*keys, first.alias("begin"), last.alias("end"))
        .groupBy(*keys, "begin")
        .agg(F.max("end").alias("end"))
    )
    order = Window.partitionBy(*keys).orderBy("begin")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = longest.withColumn("opens", F.when(F.col("begin") <= F.date_add(reach, 1), 0).otherwise(1))
    numbered = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island")


def widened(spans: DataFrame, days: int, keys: Sequence[str]) -> DataFrame:
    """The union after every interval grew by some days on both sides."""
    return merged_spans(spans, F.date_sub("begin", days), F.date_add("end", days), keys)


def span_days(spans: DataFrame, keys: Sequence[str], name: str = "day") -> DataFrame:
    """One row per day of every interval; distinct where the intervals are a union."""
    return spans.select(*keys, F.explode(F.sequence("begin", "end")).alias(name))
