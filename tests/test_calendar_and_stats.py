import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationwise.functions.calendar import calendar_day, days_in_year, season, shift_calendar_day
from stationwise.functions.geo import grid_cell, haversine_km
from stationwise.functions.stats import hotspot_class, two_sided_p
from stationwise.operators.trends import trend_columns


def test_calendar_positions(spark):
    dates = {
        dt.date(2023, 1, 1): 1, dt.date(2023, 2, 28): 59, dt.date(2024, 2, 29): 60,
        dt.date(2023, 3, 1): 61, dt.date(2024, 3, 1): 61, dt.date(2023, 12, 31): 366,
    }
    rows = spark.createDataFrame([(d,) for d in dates], "d date").select("d", calendar_day(F.col("d")).alias("c")).collect()
    assert {r["d"]: r["c"] for r in rows} == dates


def test_calendar_wraps_and_years(spark):
    row = spark.range(1).select(
        shift_calendar_day(F.lit(366), F.lit(1)), shift_calendar_day(F.lit(1), F.lit(-7)),
        days_in_year(F.lit(2023)), days_in_year(F.lit(2024)), days_in_year(F.lit(1900)),
        season(F.lit("1996-12-30").cast("date")), season(F.lit("1996-10-01").cast("date")),
    ).first()
    assert tuple(row) == (1, 360, 365, 366, 365, "DJF", "SON")


def test_distance_and_cells(spark):
    row = spark.range(1).select(
        haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("km"),
        grid_cell(F.lit(-0.5), F.lit(-118.39), 10.0).alias("cell"),
    ).first()
    assert abs(row["km"] - 10007.54) < 0.1
    assert tuple(row["cell"]) == (-1, -12)


def test_two_sided_p_matches_error_function(spark):
    zs = [float(z) for z in np.linspace(-9, 9, 181)]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", two_sided_p(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-6, abs=1e-14)


def test_hotspot_classes(spark):
    cases = [(z, p, None if math.isnan(p) else "Not significant" if p >= 0.1 else f"{'Hot' if z > 0 else 'Cold'} spot {level}%")
             for z in (-3.3, 0.4, 2.9) for p, level in ((0.0099, 99), (0.01, 95), (0.0499, 95), (0.05, 90), (0.0999, 90), (0.1, 0), (0.7, 0))]
    cases.append((float("nan"), float("nan"), None))
    frame = spark.createDataFrame([(i, z, p) for i, (z, p, _) in enumerate(cases)], "i int, z double, p double")
    rows = frame.select("i", hotspot_class(F.col("z"), F.col("p")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in rows} == {i: c for i, (_, _, c) in enumerate(cases)}


def mann_kendall(values):
    n = len(values)
    s = sum(np.sign(values[j] - values[i]) for i in range(n) for j in range(i + 1, n))
    ties = sum(c * (c - 1) * (2 * c + 5) for c in np.unique(values, return_counts=True)[1])
    var = (n * (n - 1) * (2 * n + 5) - ties) / 18
    z = 0.0 if s == 0 else (s - np.sign(s)) / math.sqrt(var)
    return s, var, math.erfc(abs(z) / math.sqrt(2))


def test_trend_columns_against_brute_force(spark):
    rng = np.random.default_rng(5)
    series = {}
    for key in range(40):
        years = sorted(rng.choice(np.arange(1991, 2026), size=int(rng.integers(1, 36)), replace=False).tolist())
        series[key] = [(int(y), float(rng.integers(0, 6))) for y in years]
    frame = spark.createDataFrame(list(series.items()), "k int, series array<struct<year:int,value:double>>")
    for r in trend_columns(frame).collect():
        items = series[r["k"]]
        slopes = [(b[1] - a[1]) / (b[0] - a[0]) for i, a in enumerate(items) for b in items[i + 1:]]
        s, var, p = mann_kendall([v for _, v in items])
        assert r["mk_s"] == s and r["mk_variance"] == pytest.approx(var)
        if slopes:
            assert r["slope_per_year"] == pytest.approx(statistics.median(slopes))
            assert r["mk_p"] == pytest.approx(p, abs=1e-12)
        else:
            assert r["slope_per_year"] is None
