"""Sweep line, interval union, positions and runs over range blocks, against plain loops."""

import datetime as dt
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stationwise.functions.scans import with_position, with_runs
from stationwise.operators.intervals import days_open, merged_spans, span_days, widened
from stationwise.operators.phases import label_phases
from stationwise.operators.selection import choose_candidates
from stationwise.operators.storms import matched_days, near_days

START = dt.date(1999, 11, 20)


def spans(seed, n, longest, keys=("a", "b", None)):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        begin = START + dt.timedelta(draw.randint(0, 500))
        rows.append((draw.choice(keys), begin, begin + dt.timedelta(draw.randint(-2, longest))))
    return [*rows, ("a", None, START), ("a", START, None)]


def plain_days(rows):
    count = Counter()
    for key, begin, end in rows:
        if begin and end:
            for k in range((end - begin).days + 1):
                count[key, begin + dt.timedelta(k)] += 1
    return count


SPAN = "key string, begin date, end date"


@pytest.mark.parametrize("longest", [0, 3, 1_500])
def test_days_open_counts_every_day(spark, longest):
    rows = spans(longest, 60, longest, ("a", "b"))
    frame = spark.createDataFrame(rows, SPAN)
    keyed = {(r.key, r.day): r.open for r in days_open(frame, "begin", "end", ["key"]).collect()}
    assert keyed == plain_days(rows)
    total = Counter()
    for (_, day), n in plain_days(rows).items():
        total[day] += n
    assert {r.day: r.open for r in days_open(frame, "begin", "end").collect()} == total
    weighted = days_open(frame.withColumn("w", F.lit(3)), "begin", "end", weight="w").collect()
    assert {r.day: r.open for r in weighted} == {d: 3 * n for d, n in total.items()}


def test_years_without_a_change_are_filled(spark):
    frame = spark.createDataFrame([("a", dt.date(1990, 5, 1), dt.date(1996, 2, 1)), ("a", dt.date(1990, 5, 1), dt.date(1990, 5, 1))], SPAN)
    found = {r.day: r.open for r in days_open(frame, "begin", "end", ["key"]).collect()}
    assert len(found) == (dt.date(1996, 2, 1) - dt.date(1990, 5, 1)).days + 1
    assert found[dt.date(1990, 5, 1)] == 2 and found[dt.date(1993, 1, 1)] == 1
    assert days_open(frame.limit(0), "begin", "end").count() == 0


def test_union_of_a_hot_key_without_repeats(spark):
    rows = spans(7, 80, 9, ("a", "b"))
    frame = spark.createDataFrame(rows, SPAN)
    union = merged_spans(frame, "begin", "end", ["key"])
    days = [(r.key, r.day) for r in span_days(union, ["key"]).collect()]
    assert len(days) == len(set(days)) and set(days) == set(plain_days(rows))
    parts = sorted((r.key, r.begin, r.end) for r in union.collect())
    assert all(b[1] > a[2] + dt.timedelta(1) for a, b in zip(parts, parts[1:]) if a[0] == b[0])
    grown = {(r.key, r.day) for r in span_days(widened(union, 2, ["key"]), ["key"]).collect()}
    assert grown == {(k, d + dt.timedelta(s)) for k, d in days for s in range(-2, 3)}


def test_long_spans_stay_two_rows_until_they_are_counted(spark):
    frame = spark.range(2_000).select(
        F.lit(START).alias("begin"), F.date_add(F.lit(START), F.col("id").cast("int") * 5).alias("end")
    )
    open_days = days_open(frame, "begin", "end")
    plan = open_days._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(year" in plan and "windowspecdefinition(day" not in plan
    row = open_days.agg(F.count("*").alias("n"), F.max("open").alias("most"), F.sum("open").alias("total")).first()
    assert tuple(row) == (1_999 * 5 + 1, 2_000, sum(k * 5 + 1 for k in range(2_000)))


def test_matches_in_both_directions(spark):
    day = lambda k: START + dt.timedelta(k)
    mine = [("heat", "X", day(0), day(4)), ("heat", "Y", day(9), day(9)), ("cold", "X", day(1), day(2))]
    theirs = [("heat", "X", day(5), day(6)), ("heat", "Y", day(20), day(21)), ("rain", "X", day(1), day(1))]
    schema = "category string, state string, begin date, end date"
    found = {
        r.category: tuple(r)[1:]
        for r in matched_days(spark.createDataFrame(mine, schema), spark.createDataFrame(theirs, schema), 1).collect()
    }
    assert found == {"heat": (6, 1, 4, 1), "cold": (2, 0, 0, 0), "rain": (0, 0, 1, 0)}
    left = spark.createDataFrame([("heat", "X", day(k)) for k in range(9)], "category string, state string, day date")
    right = spark.createDataFrame([("heat", "X", day(4)), ("heat", "X", day(4))], left.schema)
    assert sorted(r.day for r in near_days(left, right, 1).collect()) == [day(3), day(4), day(5)]


# ---- positions and runs -------------------------------------------------------


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_positions_equal_a_plain_sort(spark, blocks):
    draw = random.Random(blocks)
    rows = [(draw.choice(["hot", "hot", "hot", "a", None]), draw.randint(0, 9), k) for k in range(500)]
    frame = spark.createDataFrame(rows, "cell string, score int, id int")
    found = with_position(frame, ["cell"], [F.desc("score"), F.asc("id")], "position", blocks).collect()
    expected = {}
    for cell in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == cell), key=lambda r: (-r[1], r[2]))
        expected.update({r[2]: k for k, r in enumerate(own, 1)})
    assert {r.id: r.position for r in found if r.cell is not None} == expected


def test_a_crowded_cell_is_spread_over_tasks(spark):
    frame = spark.range(40_000).select(
        F.format_string("USW%08d", "id").alias("station_id"), F.lit(41.0).alias("lat"), F.lit(-71.0).alias("lon"),
        (F.lit(1900) + F.col("id") % 50).cast("int").alias("first_year"), F.lit(2025).alias("last_year"),
    )
    chosen = choose_candidates(frame)
    rows = chosen.groupBy().agg(F.count("*").alias("n"), F.max("position").alias("last"), F.count_distinct("position").alias("d")).first()
    assert (rows.n, rows.last, rows.d) == (40_000, 40_000, 40_000)
    blocked = with_position(frame, ["lat"], [F.asc("station_id")], "position", 16)
    in_task = blocked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert in_task < 20_000


def plain_runs(states):
    """Length of the run of every place."""
    return [n for _, group in itertools.groupby(states) for n in [sum(1 for _ in group)] for _ in range(n)]


@pytest.mark.parametrize("blocks", [1, 2, 7, 40])
def test_runs_cross_blocks(spark, blocks):
    draw = random.Random(blocks)
    states = [s for _ in range(25) for s in [draw.randint(-1, 1)] * draw.choice([1, 2, 30])]
    frame = spark.createDataFrame([(k, s) for k, s in enumerate(states)], "at int, state int")
    found = sorted(with_runs(frame, ["at"], "state", blocks).collect(), key=lambda r: r["at"])
    assert [r.run_rows for r in found] == plain_runs(states)
    numbers = [1 + sum(a != b for a, b in zip(states[:k], states[1 : k + 1])) for k in range(len(states))]
    assert [r.run for r in found] == numbers
    assert [r.is_last_run for r in found] == [n == numbers[-1] for n in numbers]


def test_a_million_months_of_phases(spark):
    months = spark.range(1_000_000).select(
        (F.col("id") / 12).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"),
        F.when(F.col("id") < 600_000, 0.9).when(F.col("id") % 8 < 4, -0.7).otherwise(0.0).alias("nino34_anomaly"),
    )
    labelled = label_phases(months, blocks=8)
    assert "Exchange SinglePartition" not in labelled._jdf.queryExecution().executedPlan().toString()
    counts = {tuple(r)[:2]: r["count"] for r in labelled.groupBy("enso_phase", "provisional").count().collect()}
    assert counts == {("El Nino", False): 600_000, ("Neutral", False): 400_000}
    assert label_phases(months.limit(0)).count() == 0
    open_run = spark.createDataFrame([(2000, m, 0.0 if m < 11 else 0.8) for m in range(1, 13)] + [(2001, 1, None)], "year int, month int, nino34_anomaly double")
    assert [r.provisional for r in label_phases(open_run).orderBy("year", "month").collect()] == [False] * 13
    assert label_phases(open_run.filter("year = 2000")).filter("provisional").count() == 2
