"""Trends, ranks and risk against plain recomputations."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationwise.config import TREND_MEASURES, ClimateConfig
from stationwise.functions.ranking import value_ranks, with_descending_rank, with_percentile_rank
from stationwise.operators import checks, risk, trends

RULES = ClimateConfig()
MEASURES = list(dict.fromkeys(TREND_MEASURES.values()))
COLUMNS = ["station_id", *trends.STATION_COLUMNS, "year", "days_present_pct", *MEASURES]


def yearly(spark, frame):
    kinds = {"station_id": "string", "year": "int", "lat": "double", "lon": "double", "days_present_pct": "double"}
    kinds |= {m: "double" for m in MEASURES}
    frame = frame.reindex(columns=COLUMNS).astype(object).where(lambda x: x.notna(), None)
    return spark.createDataFrame(frame.values.tolist(), ", ".join(f"{c} {kinds.get(c, 'string')}" for c in COLUMNS)).persist()


def plain_trend(years, values):
    """Slope per decade and two-sided p of the rank test with ties."""
    pairs = list(itertools.combinations(range(len(years)), 2))
    slope = float(np.median([(values[j] - values[i]) / (years[j] - years[i]) for i, j in pairs]))
    s = sum(np.sign(values[j] - values[i]) for i, j in pairs)
    n = len(years)
    ties = sum(t * (t - 1) * (2 * t + 5) for t in pd.Series(values).value_counts())
    variance = (n * (n - 1) * (2 * n + 5) - ties) / 18
    z = 0.0 if s == 0 or variance == 0 else (s - np.sign(s)) / math.sqrt(variance)
    return slope * 10, math.erfc(abs(z) / math.sqrt(2))


@pytest.fixture(scope="module")
def records(spark):
    rng = np.random.default_rng(41)
    frames = []
    for i in range(14):
        years = np.arange(1984 + i, 2027)
        frame = pd.DataFrame({"station_id": f"site {i:02d}", "year": years, "lat": 3.0 * i, "lon": -2.0 * i, "country": "X"})
        frame["days_present_pct"] = np.where(rng.random(len(years)) < 0.03 * i, 89.9, 90.0)
        for k, measure in enumerate(MEASURES):
            drift = (k - 2) * 0.2 * (years - 2000)
            frame[measure] = np.round(40 + drift + rng.normal(0, 3 + i, len(years)))
            frame.loc[rng.random(len(years)) < 0.02 * k, measure] = np.nan
        frames.append(frame)
    frame = pd.concat(frames, ignore_index=True)
    return frame, yearly(spark, frame)


def test_summary_equals_the_plain_trend(records):
    frame, table_a = records
    rows = {(r["station_id"], r["event_type"]): r for r in trends.station_summary(table_a, RULES).collect()}
    assert len(rows) == 14 * len(TREND_MEASURES)
    eligible = 0
    inside = frame["year"].between(RULES.trend_first_year, RULES.trend_last_year) & (frame["days_present_pct"] >= RULES.valid_year_pct)
    for (station, event_type), row in rows.items():
        own = frame[inside & (frame["station_id"] == station)].dropna(subset=[TREND_MEASURES[event_type]])
        assert row["years_used"] == len(own) and row["trend_eligible"] == (len(own) >= RULES.min_trend_years)
        if row["trend_eligible"]:
            eligible += 1
            slope, p = plain_trend(own["year"].tolist(), own[TREND_MEASURES[event_type]].tolist())
            assert row["trend_slope"] == pytest.approx(slope, abs=5.1e-4) and row["trend_p_value"] == pytest.approx(p, abs=5.1e-5)
        else:
            assert row["trend_slope"] is None and row["trend_p_value"] is None
    assert 20 < eligible < len(rows) - 10


def test_a_tie_at_the_third_decimal_goes_to_the_even_digit(spark):
    for step, slope in ((1.0, 0.312), (3.0, 0.938), (5.0, 1.562)):
        frame = pd.DataFrame({"station_id": "even", "year": [1991, 2023], "days_present_pct": 100.0} | {m: [2.0, 2.0 + step] for m in MEASURES})
        row = trends.station_summary(yearly(spark, frame), ClimateConfig(min_trend_years=2)).first()
        assert row["trend_slope"] == slope


def test_faults_of_the_summary_are_counted(records):
    _, table_a = records
    summary = trends.station_summary(table_a, RULES).persist()
    assert {r["broken"] for r in checks.summary_faults(summary, table_a, RULES).collect()} == {0}
    some = F.col("trend_eligible") & (F.col("event_type") == "cold")
    bent = summary.withColumn("trend_slope", F.when(~some, F.col("trend_slope"))).withColumn("years_used", F.col("years_used") + 30)
    bent = bent.filter("station_id <> 'site 03'").unionByName(bent.filter("station_id = 'site 00' AND event_type = 'hot_days'"))
    broken = {r["rule"]: r["broken"] for r in checks.summary_faults(bent, table_a, RULES).collect()}
    assert broken["a station and event type is one row"] == 1
    assert broken["a station has all event types"] == len(TREND_MEASURES)
    assert broken["slope and p-value come with eligibility"] == summary.filter(some & (F.col("station_id") != "site 03")).count()
    assert broken["years used fit the window"] > 0 and broken["eligibility follows the years used"] > 0


def test_a_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="days_present_pct"):
        trends.station_summary(spark.range(1).selectExpr("'a' AS station_id", "2000 AS year"), RULES)


# ---- risk and hotspots


@pytest.fixture(scope="module")
def coast(spark):
    """45 sites along a coast: warm to the east, one type without variation, two sites too short."""
    rng = np.random.default_rng(77)
    frames = []
    for i in range(47):
        first = 2010 if i >= 45 else 1991
        frame = pd.DataFrame({"station_id": f"c{i:02d}", "year": np.arange(first, 2026), "days_present_pct": 99.0})
        frame["lat"], frame["lon"] = 40 + 3 * math.sin(i / 4), -30 + 1.7 * i
        t = frame["year"] - 1991
        frame["hot_days"] = np.round(20 + i * 0.8 + rng.normal(0, 1, len(t)) + (i % 6) * 0.1 * t, 2)
        frame["heatwave_days"] = np.round(rng.normal(15, 4) + rng.normal(0, 1, len(t)), 2)
        for measure in MEASURES:
            if measure not in frame:
                frame[measure] = 6.0
        frames.append(frame)
    frame = pd.concat(frames, ignore_index=True)
    table_a = yearly(spark, frame)
    table_b = trends.station_summary(table_a, RULES).persist()
    filled, table_c = risk.risk_and_hotspots(table_a, table_b, RULES)
    return frame, table_a, table_b, filled.toPandas(), table_c.toPandas().set_index("event_type")


def test_scores_are_weighted_shares_of_ranks(coast):
    frame, _, _, filled, table_c = coast
    assert (table_c["n_stations"] == 45).all()
    for event_type in ("hot_days", "heatwave"):
        own = filled[(filled.event_type == event_type) & filled.trend_eligible].set_index("station_id")
        level = frame.groupby("station_id")[TREND_MEASURES[event_type]].mean().loc[own.index]
        parts = [(x.rank() - 1) / (len(x) - 1) for x in (level, own["trend_slope"].astype(float))]
        score = 60 * parts[0] + 40 * parts[1]
        assert np.allclose(own["risk_score"].astype(float), score, atol=0.0501)
        ranks = own["risk_rank"].astype(int)
        # Scores that differ only in the last bits may be tied on one side only.
        assert (ranks - score.round(9).rank(method="min", ascending=False)).abs().max() <= 1
        assert ranks[score.idxmax()] == 1


def test_gradient_is_found_and_noise_is_not(coast):
    _, _, _, filled, table_c = coast
    hot = filled[(filled.event_type == "hot_days") & filled.trend_eligible].sort_values("lon")
    assert hot["hotspot_class"].iloc[-5:].str.startswith("Hot spot").all() and hot["hotspot_class"].iloc[:5].str.startswith("Cold spot").all()
    assert table_c.loc["hot_days", "morans_i"] > 0.6 > 0.4 > abs(table_c.loc["heatwave", "morans_i"])
    flat = filled[~filled.event_type.isin(["hot_days", "heatwave"]) | ~filled.trend_eligible]
    assert flat[risk.RISK_COLUMNS].isna().all().all()


def test_few_or_unlocated_sites_have_scores_but_no_hotspots(spark, coast):
    frame, _, _, _, _ = coast
    few = frame[frame["station_id"] <= "c07"]
    lost = frame[frame["station_id"] <= "c30"].assign(lat=lambda x: x["lat"].where(x["station_id"] != "c11"))
    for part in (few, lost):
        table_a = yearly(spark, part)
        filled, table_c = risk.risk_and_hotspots(table_a, trends.station_summary(table_a, RULES).persist(), RULES)
        own = filled.filter("event_type = 'hot_days'").toPandas()
        assert own["risk_score"].notna().all() and own["gi_z_score"].isna().all()
        assert table_c.filter("event_type = 'hot_days'").first()["morans_i"] is None


@pytest.mark.parametrize("buckets", [None, 2, 64])
def test_ranks_with_ties_and_a_hot_value(spark, buckets):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": rng.choice(["a", "b"], 3000, p=[0.9, 0.1]), "v": rng.normal(0, 50, 3000).round(0)})
    frame.loc[:1000, "v"] = 7.0
    frame.loc[3000] = ["single", 1.0]
    frame["k"] = range(len(frame))
    sdf = spark.createDataFrame(frame)
    got = with_descending_rank(with_percentile_rank(sdf, "g", "v", "share"), "g", "v", "place").toPandas().set_index("k").sort_index()
    groups = frame.groupby("g")["v"]
    size = groups.transform("size")
    assert np.allclose(got["share"], np.where(size == 1, 0.5, (groups.rank() - 1) / (size - 1).clip(lower=1)))
    assert (got["place"] == groups.rank(method="min", ascending=False).astype(int)).all()
    below = value_ranks(sdf, "g", "v", buckets).toPandas().set_index(["g", "v"])["below"]
    assert all(below[g, v] == ((frame.g == g) & (frame.v < v)).sum() for g, v in below.index[:40])
