"""Stores with commits, gated tables, event store, header groups, rejects, day bitmaps, farthest points and staged runs."""

import datetime as dt
import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from stationwise.config import ClimateConfig, SelectionConfig
from stationwise.operators.completeness import yearly_profile
from stationwise.operators.daymaps import bitmap_profile, day_bitmaps
from stationwise.operators.farthest import farthest_order
from stationwise.operators.observations import daily_wide
from stationwise.plans.screening import STAGES, ScreeningInputs, run_screening
from stationwise.sinks import writers
from stationwise.sinks.files import Files
from stationwise.sinks.gate import Gated, fingerprint, violations, write_together
from stationwise.sinks.store import RunStore
from stationwise.sources.stations import coverage_of, store_station_lines
from stationwise.sources.storms import read_storm_events

# ---- stores -------------------------------------------------------------------


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_runs_are_seen_whole_or_not_at_all(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "station_id string, status string")
    store = RunStore(spark, str(tmp_path), frame(("A", "x")).schema, ["station_id"])
    assert store.read().count() == 0 and store.compact() is None
    assert store.append(frame(("A", "ok"), ("B", "failed"))) == 1
    broken, rows = store.write_run(frame(("A", "half"), ("C", "half")))
    assert rows == 2 and rows_of(store.latest()) == [("A", "ok"), ("B", "failed")]
    assert store.append(frame(("B", "ok"), ("D", None))) == 2
    assert rows_of(store.read()) == [("A", "ok", 1), ("B", "failed", 1), ("B", "ok", 2), ("D", None, 2)]
    assert store.compact() == 3 and [c.version for c in store.visible()] == [3]
    assert rows_of(store.read()) == [("A", "ok", 3), ("B", "ok", 3), ("D", None, 3)]
    assert store.vacuum() == 2 and store.files.exists(f"runs/{broken}")
    # A run that took long is committed after all, under the next number.
    assert store.commit(broken, rows) == 4
    assert rows_of(store.latest()) == [("A", "half"), ("B", "ok"), ("C", "half"), ("D", None)]
    with pytest.raises(ValueError, match="columns"):
        store.append(spark.createDataFrame([("A",)], "station_id string"))


def test_a_taken_number_is_never_written_twice(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    assert files.put_new("commits/1.json", {"a": 1}) and not files.put_new("commits/1.json", {"a": 2})
    assert files.get("commits/1.json") == {"a": 1} and files.names("commits") == ["1.json"]


def test_compaction_gives_way_to_a_run_that_ends_meanwhile(spark, tmp_path, monkeypatch):
    frame = lambda *rows: spark.createDataFrame(rows, "station_id string, n int")
    store = RunStore(spark, str(tmp_path), frame(("A", 1)).schema, ["station_id"])
    store.append(frame(("A", 1)))
    store.append(frame(("A", 2)))
    plain = store.write_run

    def slow(rows):
        done = plain(rows)
        monkeypatch.undo()
        store.append(frame(("A", 3)))
        return done

    monkeypatch.setattr(store, "write_run", slow)
    assert store.compact() is None and rows_of(store.latest()) == [("A", 3)]


# ---- gate -----------------------------------------------------------------------


def test_nothing_is_visible_after_a_bad_write(spark, tmp_path):
    yearly = spark.createDataFrame([(k, 2000, 10 * k) for k in range(1, 40)], "id int, year int, days int")
    parts = yearly.select("id", "year", F.explode(F.sequence(F.lit(1), "days")).alias("p"), F.lit(1).alias("days"))
    both = lambda m: [] if all(m["y"][f"fingerprint_{k}"] == m["p"][f"fingerprint_{k}"] for k in (0, 1)) else ["differ"]

    def write(frame, rule):
        tables = {
            "y": Gated(yearly, {**violations(fits=F.expr(rule)), **fingerprint(["id", "year"], "days")}, ["fits"]),
            "p": Gated(frame, fingerprint(["id", "year"], "days"), partition_by=["year"]),
        }
        return write_together(spark, str(tmp_path), tables, both)

    moved = parts.withColumn("id", F.when((F.col("id") == 9) & (F.col("p") == 1), 8).otherwise(F.col("id")))
    assert write(moved, "days > 0")[1] == ["differ"]
    assert write(parts, "days > 10")[1] == ["y: fits = 1"] and list(tmp_path.iterdir()) == []
    measured, problems = write(parts, "days > 0")
    assert problems == [] and measured["y"]["rows"] == 39 and sorted(p.name for p in tmp_path.iterdir()) == ["p", "y"]
    assert write(parts, "days > 10")[1] and spark.read.parquet(str(tmp_path / "p")).count() == measured["p"]["rows"]
    assert write_together(spark, str(tmp_path), {"y": Gated(yearly.limit(0))})[1] == ["y: no rows"]
    assert write_together(spark, str(tmp_path), {"y": Gated(yearly.limit(0), may_be_empty=True)})[1] == []
    assert spark.read.schema(yearly.schema).parquet(str(tmp_path / "y")).count() == 0


# ---- event store, files -----------------------------------------------------------


def test_one_type_is_rewritten_and_scans_prune(spark, tmp_path):
    path = str(tmp_path / "events")
    found = spark.createDataFrame([("A", "HEAT", 3), ("B", "HEAT", 9), ("A", "COLD", 4)], "station_id string, event_type string, days int")
    writers.write_events(found, path)
    writers.rewrite_events(found.filter("days > 5"), path)
    stored = writers.read_events(spark, path, found.schema)
    assert rows_of(stored.select(*found.columns)) == [("A", "COLD", 4), ("B", "HEAT", 9)]
    plan = stored.filter("event_type = 'HEAT'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan and "HEAT" in plan.split("PartitionFilters")[1]


def test_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('STATE,YEAR,NOTE\nX,2001,"one, two"\nY,2002,\n')
    (tmp_path / "b.csv").write_text("YEAR,STATE\n2003,Z\n")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as out:
        out.write("﻿YEAR, STATE ,STATE\n2004,W,again\n")
    (tmp_path / "empty.csv").write_text("")
    frame = read_storm_events(spark, str(tmp_path))
    assert set(frame.columns) == {"STATE", "YEAR", "NOTE", "STATE_2"}
    assert rows_of(frame.select("YEAR", "STATE", "NOTE", "STATE_2")) == [
        ("2001", "X", "one, two", None), ("2002", "Y", None, None), ("2003", "Z", None, None), ("2004", "W", None, "again")]
    with pytest.raises(ValueError, match="header"):
        read_storm_events(spark, str(tmp_path / "empty.csv"))


def test_every_reject_has_file_line_and_reason(spark, tmp_path):
    good = f"{'AB000000001':<11} {1.5:8.4f} {2.5:9.4f} {3.5:6.1f} QC {'Name':<30}"
    bad = {
        "short": "line shorter than an id",
        " " * 11 + good[11:]: "no station id",
        good.replace("  1.5000", "  1.5o00"): "latitude is not a number",
        good.replace("   2.5000", " " * 9): "longitude is not a number",
        good.replace("   3.5", "  three"[:6]): "elevation is not a number",
        good.replace("  1.5000", " 91.0000"): "position outside the globe",
        "": "line shorter than an id",
    }
    (tmp_path / "one.txt").write_text("\n".join([good, *list(bad)[:3]]) + "\n")
    (tmp_path / "two.txt").write_text("\n".join([*list(bad)[3:], good.replace("001", "002")]) + "\n")
    stations, rejects = store_station_lines(spark, [str(tmp_path / "one.txt"), str(tmp_path / "two.txt")], str(tmp_path / "out"))
    assert {r["line"]: r["reason"] for r in rejects.collect()} == bad and rejects.count() == len(bad)
    assert {r["file"] for r in rejects.collect()} == {"one.txt", "two.txt"}
    assert sorted(r["station_id"] for r in stations.collect()) == ["AB000000001", "AB000000002"]
    wanted = spark.createDataFrame([("AB000000002",), ("AB000000009",)], "station_id string")
    assert rows_of(coverage_of(stations, wanted)) == [("AB000000001", "extra"), ("AB000000009", "missing")]


# ---- day bitmaps --------------------------------------------------------------------


def gappy(spark, years=(1994, 2001)):
    draw = random.Random(3)
    rows, day = [], dt.date(years[0], 1, 1)
    while day.year <= years[1]:
        for element, share in (("TMAX", 0.9), ("TMIN", 0.7), ("PRCP", 0.5), ("SNOW", 0.2)):
            if draw.random() < share:
                rows += [("A" if draw.random() < 0.8 else "B", day, element, 1.0)] * draw.choice([1, 1, 2])
            elif draw.random() < 0.1:
                rows.append(("A", day, element, None))
        day += dt.timedelta(1)
    return spark.createDataFrame(rows, "station_id string, date date, element string, value double")


@pytest.mark.parametrize("first, last", [(dt.date(1995, 1, 2), dt.date(1999, 12, 31)), (dt.date(1996, 2, 29), dt.date(1996, 12, 31)), (dt.date(1990, 1, 1), dt.date(2010, 6, 1))])
def test_bitmaps_give_the_profile_of_the_pivot(spark, first, last):
    rules = ClimateConfig(baseline_start=first, baseline_end=last)
    observations = gappy(spark)
    plain = yearly_profile(daily_wide(observations), rules)
    bits = bitmap_profile(day_bitmaps(observations), rules).select(*plain.columns)
    assert rows_of(bits) == rows_of(plain) and bits.filter("baseline_days_tmin <> baseline_days_prcp").count() > 0


def test_bitmap_plan_has_one_exchange_and_no_days(spark):
    plan = day_bitmaps(gappy(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "bit_or" in plan
    assert day_bitmaps(gappy(spark).limit(0)).count() == 0


# ---- farthest points ------------------------------------------------------------------


def km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    x = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(x)))


def plain_order(rows, limit, start):
    rows = sorted(rows)
    keep = [r for s in start for r in rows if r[0] == s] or rows[:1]
    rest = [r for r in rows if r not in keep]
    near = {r[0]: min(km(r[1:], k[1:]) for k in keep) for r in rest}
    while len(keep) < limit and rest:
        best = max(rest, key=lambda r: near[r[0]])
        keep.append(best)
        rest.remove(best)
        near |= {r[0]: min(near[r[0]], km(r[1:], best[1:])) for r in rest}
    return [k[0] for k in keep]


PLACES = {
    "globe": lambda d: (d.uniform(-90, 90), d.uniform(-180, 180)),
    "cluster": lambda d: (d.gauss(45, 6), d.gauss(10, 9)),
    "one place": lambda d: (41.0, -71.0),
    "few places": lambda d: (d.choice([-90.0, 0.0, 89.0]), d.choice([-180.0, 0.0, 180.0])),
}


@pytest.mark.parametrize("kind", PLACES)
def test_farthest_points_are_exact_in_few_passes(spark, kind):
    draw = random.Random(kind)
    rows = [(f"S{k:04d}", *PLACES[kind](draw)) for k in range(900)]
    start = ["S0007", "S0002"] if kind == "globe" else []
    frame = spark.createDataFrame(rows, "station_id string, lat double, lon double")
    picked, passes = farthest_order(frame, 120, start)
    assert picked == plain_order(rows, 120, start) and passes <= 20


# ---- staged run -----------------------------------------------------------------------


RULES = ClimateConfig(
    baseline_start=dt.date(1995, 1, 1), baseline_end=dt.date(1996, 12, 31), trend_first_year=1995, trend_last_year=1998,
    valid_year_pct=80.0, min_baseline_valid_years=2, min_trend_years=3,
)
SELECTION = SelectionConfig(first_year=1995, last_year=1998, per_cell=1, min_separation_km=1.0, max_stations=3, required=())


def screening_parts(spark, broken=()):
    """Six stations of four years, one of them with rain on every second day only; reads are counted."""
    ids = [f"AB{k:09d}" for k in range(6)]
    lines = [f"{s:<11} {10.0 * k:8.4f} {20.0 * k:9.4f} {e} 1990 2005" for k, s in enumerate(ids) for e in ("TMAX", "TMIN", "PRCP")]
    days = spark.range(4 * 365 + 1).select(F.date_add(F.lit(dt.date(1995, 1, 1)), F.col("id").cast("int")).alias("date"))
    frame = days.crossJoin(spark.createDataFrame([(s,) for s in ids], "station_id string")).select(
        "station_id", "date", F.explode(F.array(*map(F.lit, ("TMAX", "TMIN", "PRCP")))).alias("element"), F.lit(1.0).alias("value"))
    frame = frame.filter(~((F.col("station_id") == ids[4]) & (F.col("element") == "PRCP") & (F.dayofyear("date") % 2 == 0)))
    reads = []

    def observations(stations):
        reads.append(sorted(r[0] for r in stations.collect()))
        return frame.join(stations, "station_id", "left_semi")

    status = F.when(F.col("station_id") == ids[5], "not_found").when(F.col("station_id").isin(*broken), "error").otherwise("ok")
    return ids, reads, ScreeningInputs(
        spark.createDataFrame([(x,) for x in lines], "value string"),
        spark.createDataFrame([("AB", "Land", "Part")], "country_code string, country string, continent string"),
        lambda c: c.withColumn("status", status), observations)


@pytest.mark.parametrize("stop", STAGES[:-1])
def test_a_stopped_run_goes_on_where_it_ended(spark, tmp_path, stop):
    ids, reads, inputs = screening_parts(spark)
    tables, built = run_screening(spark, inputs, str(tmp_path), RULES, SELECTION, stop)
    assert list(tables) == list(STAGES[: STAGES.index(stop) + 1])
    tables, rest = run_screening(spark, inputs, str(tmp_path), RULES, SELECTION)
    assert sorted(built + rest) == sorted([*STAGES, "scoring"]) and not set(built) & set(rest)
    assert reads == [ids[:5]]
    assert {r["station_id"] for r in tables["thinned"].collect()} == {ids[0], ids[3], ids[1]}
    assert rows_of(tables["report"]) == [("Part", 5, 4, 3), ("TOTAL", 5, 4, 3)]
    assert run_screening(spark, inputs, str(tmp_path), RULES, SELECTION)[1] == [] and len(reads) == 1


def test_only_failed_stations_are_scored_again(spark, tmp_path):
    ids, reads, inputs = screening_parts(spark, broken=[f"AB{1:09d}"])
    first, _ = run_screening(spark, inputs, str(tmp_path), RULES, SELECTION)
    assert {r["station_id"]: r["status"] for r in first["results"].collect()} == dict(zip(ids, ["ok", "error", "ok", "ok", "ok", "not_found"]))
    ids, again, inputs = screening_parts(spark)
    second, built = run_screening(spark, inputs, str(tmp_path), RULES, SELECTION)
    assert again == [[ids[1]]] and built[0] == "scoring" and "inventory" not in built and "candidates" not in built
    scores = {r["station_id"]: r for r in second["results"].collect()}
    assert scores[ids[1]]["status"] == "ok" and scores[ids[5]]["baseline_eligible"] is None
    assert scores[ids[4]]["baseline_days_prcp"] == 366 and not scores[ids[4]]["baseline_eligible"] and scores[ids[0]]["baseline_eligible"]


def test_changed_rules_change_their_stage_and_all_behind_it(spark, tmp_path):
    ids, reads, inputs = screening_parts(spark)
    run_screening(spark, inputs, str(tmp_path), RULES, SELECTION)
    wider = SelectionConfig(**{**SELECTION.__dict__, "max_stations": 2})
    tables, built = run_screening(spark, inputs, str(tmp_path), RULES, wider)
    assert tables["thinned"].count() == 2 and "scoring" not in built and len(reads) == 1
    stricter = ClimateConfig(**{**RULES.__dict__, "valid_year_pct": 100.0})
    _, built = run_screening(spark, inputs, str(tmp_path), stricter, wider)
    assert "scoring" in built and "candidates" not in built and len(reads) == 2
