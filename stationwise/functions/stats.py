"""Statistics as column expressions: normal tails, Theil-Sen, Mann-Kendall.

A series is an array column of structs ``(year, value)`` with distinct years, so
its length is bounded by the trend window. Pairwise slopes and signs stay array
elements inside the row: no self join and no pair rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal upper tail (Hart 1968,
# algorithm 5666, as given by West 2005), highest power first.
TAIL_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_SWITCH = 7.07106781186547
SQRT_TWO_PI = 2.506628274631


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value 2(1 - Phi(|z|)); NULL stays NULL."""
    x = F.abs(z)
    density = F.exp(-x * x / 2)
    near = density * _polynomial(x, TAIL_NUMERATOR) / _polynomial(x, TAIL_DENOMINATOR)
    fraction = reduce(lambda acc, k: x + F.lit(float(k)) / acc, (4, 3, 2, 1), x + F.lit(0.65))
    far = density / fraction / F.lit(SQRT_TWO_PI)
    return F.lit(2.0) * F.when(x < TAIL_SWITCH, near).otherwise(far)


def hotspot_class(z: Column, p: Column) -> Column:
    """Hot or cold spot label; NULL when z or p is missing."""
    side = F.when(z > 0, F.lit("Hot spot ")).otherwise(F.lit("Cold spot "))
    return F.when(
        ~(z.isNull() | p.isNull() | F.isnan(z) | F.isnan(p)),
        F.when(p < 0.01, F.concat(side, F.lit("99%")))
        .when(p < 0.05, F.concat(side, F.lit("95%")))
        .when(p < 0.10, F.concat(side, F.lit("90%")))
        .otherwise(F.lit("Not significant")),
    )


def median_of(values: Column) -> Column:
    """Median of an array column, the mean of the middle two if even."""
    ordered = F.array_sort(values)
    size = F.size(values)
    low = F.element_at(ordered, ((size + 1) / 2).cast("int"))
    high = F.element_at(ordered, (size / 2).cast("int") + 1)
    return F.when(size > 0, (low + high) / 2)


def _later_items(series: Column, index: Column) -> Column:
    return F.slice(series, index + 2, F.size(series))


def theil_sen_slope(series: Column) -> Column:
    """Median of all pairwise slopes, per year, on the real years."""
    slopes = F.flatten(
        F.transform(
            series,
            lambda a, i: F.transform(
                _later_items(series, i),
                lambda b: (b["value"] - a["value"]) / (b["year"] - a["year"]),
            ),
        )
    )
    return median_of(slopes)


def mann_kendall_s(series: Column) -> Column:
    """Sum of the signs of all later-minus-earlier differences."""
    per_item = F.transform(
        series,
        lambda a, i: F.aggregate(
            _later_items(series, i),
            F.lit(0).cast("long"),
            lambda acc, b: acc + F.signum(b["value"] - a["value"]).cast("long"),
        ),
    )
    return F.aggregate(per_item, F.lit(0).cast("long"), lambda acc, x: acc + x)


def mann_kendall_variance(series: Column) -> Column:
    """Variance of S with the correction for tied values."""
    n = F.size(series).cast("long")
    values = F.transform(series, lambda item: item["value"])
    tie_sizes = F.transform(
        F.array_distinct(values),
        lambda v: F.size(F.filter(values, lambda other: other == v)).cast("long"),
    )
    ties = F.aggregate(
        tie_sizes, F.lit(0).cast("long"), lambda acc, t: acc + t * (t - 1) * (2 * t + 5)
    )
    return (n * (n - 1) * (2 * n + 5) - ties) / F.lit(18.0)


def mann_kendall_z(s: Column, variance: Column) -> Column:
    """Continuity-corrected z; 0 when S is 0, as for a constant series."""
    return F.when(s == 0, F.lit(0.0)).otherwise((s - F.signum(s)) / F.sqrt(variance))
