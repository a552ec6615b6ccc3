import datetime as dt
import random
from itertools import groupby

from pyspark.sql import functions as F

from stationwise.operators.runs import consecutive_runs, overlapping_runs

DAYS = "station_id string, event_type string, date date, excess double"


def frame(spark, rows):
    return spark.createDataFrame(rows, DAYS)


def day(text):
    return dt.date.fromisoformat(text)


def span(start, count, station="A", kind="X", excess=1.0):
    return [(station, kind, day(start) + dt.timedelta(days=i), excess) for i in range(count)]


def found(runs):
    return sorted((r["station_id"], r["event_type"], r["start_date"], r["end_date"], r["duration_days"]) for r in runs.collect())


def brute(rows, minimum):
    out = []
    for (station, kind), items in groupby(sorted(rows), key=lambda r: r[:2]):
        days = [r[2] for r in items]
        start = prev = days[0]
        for d in [*days[1:], None]:
            if d is None or (d - prev).days != 1:
                if (prev - start).days + 1 >= minimum.get(kind, 1):
                    out.append((station, kind, start, prev, (prev - start).days + 1))
                start = d
            prev = d
    return sorted(out)


def test_run_crossing_month_and_year_is_one_run(spark):
    runs = consecutive_runs(frame(spark, span("1996-12-30", 40)), {"X": 3})
    assert found(runs) == [("A", "X", day("1996-12-30"), day("1997-02-07"), 40)]


def test_missing_day_splits_and_minimum_applies(spark):
    rows = span("2001-01-05", 3) + span("2001-01-09", 2)
    assert found(consecutive_runs(frame(spark, rows), {"X": 3})) == [("A", "X", day("2001-01-05"), day("2001-01-07"), 3)]
    assert len(found(consecutive_runs(frame(spark, rows)))) == 2


def test_short_pieces_at_a_border_still_count(spark):
    runs = consecutive_runs(frame(spark, span("2001-01-30", 4)), {"X": 4})
    assert found(runs) == [("A", "X", day("2001-01-30"), day("2001-02-02"), 4)]


def test_one_day_types_are_never_joined(spark):
    runs = consecutive_runs(frame(spark, span("2001-01-30", 4, kind="RAIN")), {}, one_day_types=["RAIN"])
    assert [r[4] for r in found(runs)] == [1, 1, 1, 1]


def test_totals_and_peak(spark):
    rows = [("A", "X", day("2001-01-31"), 1.0), ("A", "X", day("2001-02-01"), 4.0), ("A", "X", day("2001-02-02"), 2.0)]
    r = consecutive_runs(frame(spark, rows), {"X": 3}).first()
    assert (r["total_excess"], r["peak_excess"]) == (7.0, 4.0)


def test_random_runs_with_one_hot_station(spark):
    rng = random.Random(3)
    rows = []
    for station, chance in (("HOT", 0.97), ("B", 0.5), ("C", 0.2)):
        for kind in ("X", "Y"):
            rows += [(station, kind, dt.date(1999, 1, 1) + dt.timedelta(days=i), rng.random())
                     for i in range(1500) if rng.random() < chance]
    minimum = {"X": 3, "Y": 10}
    assert found(consecutive_runs(frame(spark, rows), minimum)) == brute(rows, minimum)


def test_overlaps(spark):
    schema = "station_id string, start_date date, end_date date"
    rng = random.Random(8)

    def intervals(count, longest):
        rows = []
        for _ in range(count):
            start = dt.date(1999, 1, 1) + dt.timedelta(days=rng.randrange(1200))
            rows.append((rng.choice("AB"), start, start + dt.timedelta(days=rng.randrange(longest))))
        return rows

    left, right = intervals(60, 8), intervals(40, 500)
    got = overlapping_runs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    wanted = sorted(
        (a[0], max(a[1], b[1]), min(a[2], b[2])) for a in left for b in right
        if a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2]
    )
    assert sorted((r["station_id"], r["start_date"], r["end_date"]) for r in got.collect()) == wanted


def test_touching_intervals_do_not_overlap(spark):
    schema = "station_id string, start_date date, end_date date"
    a = spark.createDataFrame([("A", day("2001-01-01"), day("2001-01-05"))], schema)
    b = spark.createDataFrame([("A", day("2001-01-06"), day("2001-01-20")), ("A", day("2001-01-05"), day("2001-01-05"))], schema)
    assert [r["duration_days"] for r in overlapping_runs(a, b).collect()] == [1]
