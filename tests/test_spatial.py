import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationwise.operators import spatial
from stationwise.operators.risk import neighbour_groups
from stationwise.operators.spatial import connected_components, gi_star, morans_i, nearest_neighbours

RADIUS = 6371.0088


def distances(lat, lon):
    phi, lam = np.radians(lat), np.radians(lon)
    h = np.sin((phi[:, None] - phi) / 2) ** 2 + np.cos(phi)[:, None] * np.cos(phi) * np.sin((lam[:, None] - lam) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def brute_neighbours(points, k):
    out = {}
    for g, part in points.groupby("g"):
        part = part.sort_values("station_id").reset_index(drop=True)
        d = distances(part["lat"].to_numpy(), part["lon"].to_numpy()).round(6)
        for i in range(len(part)):
            order = [j for j in np.lexsort((np.arange(len(part)), d[i])) if j != i][:k]
            out[g, part["station_id"][i]] = [part["station_id"][j] for j in order]
    return out


def compare(spark, points, k):
    edges = nearest_neighbours(spark.createDataFrame(points), k, "g", RADIUS).toPandas().sort_values("position")
    got = {key: list(part["j"]) for key, part in edges.groupby(["g", "i"])}
    wanted = {key: v for key, v in brute_neighbours(points, k).items() if v}
    assert got == wanted


def test_neighbours_of_mixed_density(spark):
    rng = np.random.default_rng(2)
    lat = np.concatenate([rng.uniform(-90, 90, 150), 45 + rng.normal(0, 0.001, 120), [90, -90, 0, 0]])
    lon = np.concatenate([rng.uniform(-180, 180, 150), 179.9995 + rng.normal(0, 0.001, 120), [0, 0, 180, -180]])
    lon = (lon + 180) % 360 - 180
    points = pd.DataFrame({"g": rng.choice(["a", "b"], len(lat)), "station_id": [f"P{i:04d}" for i in range(len(lat))], "lat": lat, "lon": lon})
    compare(spark, points, 5)


def test_neighbours_with_many_copies_of_one_place(spark):
    rng = np.random.default_rng(6)
    lat = np.concatenate([np.full(80, 10.0), rng.uniform(9, 11, 60)])
    lon = np.concatenate([np.full(80, 20.0), rng.uniform(19, 21, 60)])
    points = pd.DataFrame({"g": "a", "station_id": [f"P{i:04d}" for i in rng.permutation(140)], "lat": lat, "lon": lon})
    compare(spark, points, 5)


def test_groups_smaller_than_k(spark):
    points = pd.DataFrame({"g": ["a"] * 3 + ["b"], "station_id": list("PQRS"), "lat": [0.0, 10, 20, 5], "lon": [0.0, 0, 150, 5]})
    compare(spark, points, 5)


@pytest.mark.parametrize("k", [2, 5])
def test_only_pairs_within_the_bound_are_ordered(spark, monkeypatch, k):
    """A few pairs a point go to the window, also where a dense town lies amid scattered points; none is broadcast with its cubes."""
    rng = np.random.default_rng(12)
    lat = np.concatenate([rng.uniform(-60, 60, 1500), 45 + rng.normal(0, 0.001, 1500)])
    lon = np.concatenate([rng.uniform(-180, 180, 1500), 9 + rng.normal(0, 0.001, 1500)])
    points = pd.DataFrame({"g": "a", "station_id": [f"P{i:04d}" for i in range(len(lat))], "lat": lat, "lon": lon})
    compare(spark, points, k)
    seen, plain = [], spatial._nearest
    monkeypatch.setattr(spatial, "_nearest", lambda pairs, k, keys: seen.append((len(keys), pairs)) or plain(pairs, k, keys))
    edges = nearest_neighbours(spark.createDataFrame(points), k, "g", RADIUS)
    (ordered,) = [pairs.count() for keys, pairs in seen if keys == 1]
    assert k * len(points) <= ordered <= 4 * k * len(points)
    assert "BroadcastNestedLoop" not in (plan := edges._jdf.queryExecution().executedPlan().toString()) and plan.count("BroadcastHashJoin") <= 1


def unrelated_values(runs=150, sites=50):
    """Runs of values without any spatial order on scattered sites."""
    frames = []
    for run in range(runs):
        rng = np.random.default_rng([run, 606])
        frames.append(
            pd.DataFrame(
                {
                    "g": run,
                    "station_id": [f"u{i:03d}" for i in range(sites)],
                    "lat": rng.uniform(-55, 65, sites).round(3),
                    "lon": rng.uniform(-175, 175, sites).round(3),
                    "level": rng.exponential(10, sites).round(4),
                }
            )
        )
    return pd.concat(frames)


def numpy_statistics(part, k):
    part = part.sort_values("station_id").reset_index(drop=True)
    n, x = len(part), part["level"].to_numpy()
    d = distances(part["lat"].to_numpy(), part["lon"].to_numpy()).round(6)
    w = np.zeros((n, n))
    for i in range(n):
        w[i, [j for j in np.lexsort((np.arange(n), d[i])) if j != i][:k]] = 1
    star = w + np.eye(n)
    size = star.sum(1)
    z_gi = (star @ x - x.mean() * size) / (x.std() * np.sqrt((n * size - size**2) / (n - 1)))
    r, z = w / w.sum(1, keepdims=True), x - x.mean()
    s0, s1 = r.sum(), ((r + r.T) ** 2).sum() / 2
    s2 = ((r.sum(1) + r.sum(0)) ** 2).sum()
    index, e = n / s0 * (z @ r @ z) / (z @ z), -1 / (n - 1)
    b2 = (z**4).mean() / (z**2).mean() ** 2
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)) / ((n - 1) * (n - 2) * (n - 3) * s0**2) - e * e
    return dict(zip(part["station_id"], z_gi)), index, math.erfc(abs((index - e) / math.sqrt(var)) / math.sqrt(2))


def test_statistics_and_their_false_alarms(spark):
    values = unrelated_values()
    points = spark.createDataFrame(values).persist()
    edges = nearest_neighbours(points, 4, "g", RADIUS).persist()
    spots = gi_star(points, edges, "g", "level").toPandas()
    global_rows = morans_i(points, edges, "g", "level").toPandas().set_index("g")
    assert len(spots) == len(values) and len(global_rows) == values["g"].nunique()
    # About one in twenty at the five per cent level, within the spread of so many runs.
    assert 0.005 <= (global_rows["morans_p"] < 0.05).mean() <= 0.12
    assert 0.015 <= (spots["gi_p"] < 0.05).mean() <= 0.09
    for run in (4, 71, 149):
        z, index, p = numpy_statistics(values[values["g"] == run], 4)
        mine = spots[spots["g"] == run].set_index("station_id")["gi_z"]
        assert all(mine[s] == pytest.approx(z[s], abs=1e-9) for s in z)
        assert global_rows.loc[run, "morans_i"] == pytest.approx(index, abs=1e-9)
        assert global_rows.loc[run, "morans_p"] == pytest.approx(p, abs=1e-9)


def test_constant_group_has_no_statistics(spark):
    points = spark.createDataFrame([("a", f"S{i:02d}", float(i), 0.0, 4.0) for i in range(12)], "g string, station_id string, lat double, lon double, level double")
    edges = nearest_neighbours(points, 5, "g", RADIUS)
    assert gi_star(points, edges, "g", "level").isEmpty() and morans_i(points, edges, "g", "level").isEmpty()


def test_components(spark):
    rng = np.random.default_rng(9)
    n = 120
    edges = [(f"N{a:03d}", f"N{b:03d}") for a, b in rng.integers(0, n, (70, 2)).tolist()]
    edges += [(f"L{i:03d}", f"L{i + 1:03d}") for i in range(60)]
    nodes = [f"N{i:03d}" for i in range(n)] + [f"L{i:03d}" for i in range(61)]
    parent = {v: v for v in nodes}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = connected_components(spark.createDataFrame(edges, "i string, j string"), spark.createDataFrame([(v,) for v in nodes], "id string"))
    assert {r["id"]: r["component"] for r in got.collect()} == {v: root(v) for v in nodes}


def test_clusters_of_any_size_are_their_own_components(spark):
    rng = np.random.default_rng(9)
    rows = []
    for cluster, (lat, lon, n) in enumerate([(-48, -70, 9), (12, 8, 14), (61, 130, 8)]):
        rows += [(f"q{cluster}{i:02d}", float(lat + x), float(lon + y)) for i, (x, y) in enumerate(rng.normal(0, 0.5, (n, 2)))]
    stations = spark.createDataFrame(rows, "station_id string, lat double, lon double")
    labels = neighbour_groups(stations).toPandas()
    assert (labels["component"].str[:2] == labels["station_id"].str[:2]).all() and labels["component"].nunique() == 3
