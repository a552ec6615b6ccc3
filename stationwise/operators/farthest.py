"""Farthest-point choice: again and again the station farthest from those already kept.

Every choice needs the one before it, but not a pass over the stations. A pass gives,
for every grid cell, the few stations that are farthest from all picks; the worst of
them bounds the rest of the cell, and so does the distance of its centre plus its
radius to any later pick. As long as the best listed station beats all these bounds it
is the true farthest one, so a pass yields many picks. Only then the distances of all
stations are brought up to date and listed again. The choice is exact, ties included.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationwise.functions.geo import grid_cell, haversine_km
from stationwise.session import cut_lineage

#: Degrees of a cell and stations listed per cell: at most 4,050 x 16 rows reach the driver in a pass.
DEGREES = 4.0
LISTED = 16
#: Room for the rounding of distances computed by different libraries.
SLACK_KM = 1e-6


def _km(lat1, lon1, lat2, lon2, radius: float):
    lat1, lon1, lat2, lon2 = (np.radians(x) for x in (lat1, lon1, lat2, lon2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def _listed(rest: DataFrame, tie_columns: Sequence[str]) -> list:
    """The stations of every cell that are farthest from the picks, in order."""
    order = Window.partitionBy("lat_bin", "lon_bin").orderBy(F.desc("nearest"), *tie_columns)
    top = rest.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LISTED)
    rows = top.collect()
    tie = lambda r: tuple((r[c] is not None, r[c]) for c in tie_columns)
    return sorted(rows, key=lambda r: (-r["nearest"], tie(r)))


def _picks_of_pass(rows: list, wanted: int, radius: float) -> list[int]:
    """Indexes of the listed rows that are certainly the next picks."""
    lat, lon = (np.array([r[c] for r in rows]) for c in ("lat", "lon"))
    far = np.array([r["nearest"] for r in rows])
    cells = sorted({(r["lat_bin"], r["lon_bin"]) for r in rows})
    number = {c: k for k, c in enumerate(cells)}
    # The rest of a full cell comes after its last listed row: (distance, place in the whole order).
    bound, after = np.full(len(cells), -1.0), np.zeros(len(cells), np.int64)
    for k, r in enumerate(rows):
        if r["place"] == LISTED:
            bound[number[r["lat_bin"], r["lon_bin"]]], after[number[r["lat_bin"], r["lon_bin"]]] = r["nearest"], k
    low_lat, low_lon = (np.array([c[i] for c in cells]) * DEGREES for i in (0, 1))
    centre_lat, centre_lon = low_lat + DEGREES / 2, low_lon + DEGREES / 2
    corners = [_km(centre_lat, centre_lon, low_lat + a, low_lon + b, radius) for a in (0, DEGREES / 2, DEGREES) for b in (0, DEGREES)]
    size = np.max(corners, axis=0) + SLACK_KM
    picked: list[int] = []
    open_rows = np.ones(len(rows), bool)
    while len(picked) < wanted and open_rows.any():
        # Rows are in tie order, so the first of the largest distances wins.
        best = int(np.argmax(np.where(open_rows, far, -np.inf)))
        beats = (far[best] > bound) | ((far[best] == bound) & (best <= after))
        if not beats.all():
            break
        picked.append(best)
        open_rows[best] = False
        far = np.minimum(far, _km(lat, lon, lat[best], lon[best], radius))
        reach = _km(centre_lat, centre_lon, lat[best], lon[best], radius) + size
        after = np.where(reach < bound, -1, after)
        bound = np.minimum(bound, reach)
    return picked


def farthest_order(
    stations: DataFrame,
    limit: int,
    start: Sequence[str] = (),
    radius_km: float = 6371.0088,
    tie_columns: Sequence[str] = ("station_id",),
) -> tuple[list[str], int]:
    """(station ids in the order in which they are picked, passes over the stations)."""
    cell = grid_cell(F.col("lat"), F.col("lon"), DEGREES)
    names = list(dict.fromkeys(["station_id", "lat", "lon", *tie_columns]))
    places = stations.select(*names, cell["lat_cell"].alias("lat_bin"), cell["lon_cell"].alias("lon_bin"))
    places = cut_lineage(places.repartitionByRange("lat_bin", "lon_bin", "station_id"))
    position = ["station_id", "lat", "lon"]
    given = {station: place for place, station in enumerate(start)}
    found = places.filter(F.col("station_id").isin(*start)).select(*position).collect() if start else []
    found = sorted(found, key=lambda r: given[r["station_id"]])
    if not found:
        first = places.orderBy(*tie_columns).select(*position).first()
        found = [first] if first is not None else []
    picked, fresh, passes = [r["station_id"] for r in found], found, 0
    rest = places.withColumn("nearest", F.lit(float("inf")))
    while fresh and len(picked) < limit:
        away = [haversine_km(F.col("lat"), F.col("lon"), F.lit(r["lat"]), F.lit(r["lon"]), radius_km) for r in fresh]
        gone = F.col("station_id").isin(*[r["station_id"] for r in fresh])
        rest = cut_lineage(rest.filter(~gone).withColumn("nearest", F.least(F.col("nearest"), *away)))
        rows = _listed(rest, tie_columns)
        passes += 1
        fresh = [rows[k] for k in _picks_of_pass(rows, limit - len(picked), radius_km)] if rows else []
        picked += [r["station_id"] for r in fresh]
    return picked, passes
