"""Nearest neighbours, Getis-Ord Gi*, Moran's I and graph components.

Neighbours come from a density-adaptive grid on the unit sphere and equi
joins, never from all pairs. For every point the finest grid level is chosen at
which its own cube still holds k+1 points. The k-th distance inside that cube
bounds the search: only the cubes which that radius reaches are joined, and only
pairs within it are ordered, a few per point. A
cube one level finer holds at most k of the points that chose the level, so the
joins stay linear in the number of points however dense one area is. Joins onto
one row per key (values, labels) may have a hot key, for example when a third of
the points share a place; adaptive execution splits those partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationwise.functions.geo import haversine_km
from stationwise.functions.stats import hotspot_class, two_sided_p
from stationwise.session import MOST_GROUPS, cut_lineage, join_groups

FINEST_LEVEL = 26
SALTS = 16
DISTANCE_DECIMALS = 6
#: Kilometres and lengths on the unit sphere by which a search reaches beyond its bound, for rounded distances.
SLACK_KM, SLACK = 1e-5, 1e-12
#: Points of a task that puts each of them into several cubes.
POINTS_A_TASK = 10_000


def _unit_sphere(lat: Column, lon: Column) -> list[Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]


def _cube(level: Column) -> list[Column]:
    """Integer cube coordinates of the point at a level; level 0 is one cube."""
    edge = F.lit(2.0) / F.pow(F.lit(2.0), level)
    last = F.pow(F.lit(2.0), level).cast("long") - 1
    return [
        F.least(F.floor((F.col(axis) + 1.0) / edge), last).alias(f"c{axis}") for axis in ("x", "y", "z")
    ]


CUBE = ["level", "cx", "cy", "cz"]


def _reachable(axis: str) -> Column:
    """Cube coordinates that the radius ``reach`` meets on one axis."""
    edge = F.lit(2.0) / F.pow(F.lit(2.0), F.col("level"))
    last = F.pow(F.lit(2.0), F.col("level")).cast("long") - 1
    low, high = (F.floor((F.col(axis) + 1.0 + way * F.col("reach")) / edge) for way in (-1, 1))
    return F.sequence(F.least(F.greatest(low, F.lit(0)), last), F.least(high, last))


def _spread(frame: DataFrame, rows: int) -> DataFrame:
    """The frame over tasks of a bounded number of its counted rows: a few bytes that explode are else one task."""
    return frame.repartition(rows // POINTS_A_TASK + 1, "id")


def _touches_sphere() -> Column:
    """Cubes that the unit sphere can pass through; the others hold no point."""
    edge = F.lit(2.0) / F.pow(F.lit(2.0), F.col("level"))
    squares = [F.pow((F.col(axis) + 0.5) * edge - 1.0, F.lit(2.0)) for axis in ("cx", "cy", "cz")]
    return F.abs(F.sqrt(squares[0] + squares[1] + squares[2]) - 1.0) <= edge * 0.87 + 1e-9


def nearest_neighbours(
    points: DataFrame, k: int, group: str, radius_km: float, id_column: str = "station_id"
) -> DataFrame:
    """Edges (group, i, j, distance_km, position) to the k nearest points of the group.

    Distances are rounded to a millimetre and ties go to the smaller id. Points
    sharing a location need no pairs among themselves: at equal distance only
    the k+1 smallest ids of a location can be neighbours of anyone.
    """
    x, y, z = _unit_sphere(F.col("lat"), F.col("lon"))
    located = points.select(group, F.col(id_column).alias("id"), "lat", "lon").withColumns({"x": x, "y": y, "z": z})
    located = cut_lineage(located)
    rows = located.count()
    same_place = Window.partitionBy(group, "lat", "lon").orderBy("id")
    targets = located.withColumn("copy", F.row_number().over(same_place)).filter(F.col("copy") <= k + 1).drop("copy")
    targets = _spread(cut_lineage(targets), rows)
    own = cut_lineage(_own_cubes(_spread(located, rows), targets, k, group))
    return _nearest(close_pairs(own, targets, k, group, radius_km), k, [group])


def _nearest(pairs: DataFrame, k: int, keys: list[str]) -> DataFrame:
    closest = Window.partitionBy(*keys, "i").orderBy("distance_km", "j")
    return pairs.withColumn("position", F.row_number().over(closest)).filter(F.col("position") <= k)


def _own_cubes(located: DataFrame, targets: DataFrame, k: int, group: str) -> DataFrame:
    """Every point with the finest level whose cube around it holds k+1 targets; 0 where none does."""
    levels = F.sequence(F.lit(0), F.lit(FINEST_LEVEL))
    full_cubes = cut_lineage(
        targets.withColumn("level", F.explode(levels))
        .select(group, "level", *_cube(F.col("level")))
        .groupBy(group, *CUBE)
        .agg(F.count(F.lit(1)).alias("members"))
        .filter(F.col("members") >= k + 1)
    )
    # Cubes around a full one are full, so no level is left out up to the finest of them.
    counted = full_cubes.agg(F.max("level").alias("finest"), F.count(F.lit(1)).alias("cubes")).first()
    cubes = located.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(counted["finest"] or 0)))).select("*", *_cube(F.col("level")))
    if counted["cubes"] <= MOST_GROUPS:
        held = cubes.join(F.broadcast(full_cubes), [group, *CUBE], "left")
    else:
        # Coarse cubes hold most points, so this join is spread over salted keys.
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = cubes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        held = salted.hint("merge").join(full_cubes.withColumn("salt", salts), [group, *CUBE, "salt"], "left")
    return (
        # A group of at most k points has no full cube: everyone meets at level 0.
        held.filter(F.col("members").isNotNull() | (F.col("level") == 0))
        .groupBy(group, "id", "lat", "lon", "x", "y", "z")
        .agg(F.max("level").alias("level"))
    )


def close_pairs(own: DataFrame, targets: DataFrame, k: int, group: str, radius_km: float) -> DataFrame:
    """(group, i, j, distance_km) of all points with the targets up to their k-th distance inside their own cube."""
    levels = F.array(*[F.lit(r["level"]) for r in own.select("level").distinct().collect()]).cast("array<int>")
    candidates = targets.withColumn("level", F.explode(levels)).select(
        group, "level", *_cube(F.col("level")), F.col("id").alias("j"), F.col("lat").alias("lat_j"), F.col("lon").alias("lon_j")
    )
    distance = F.round(
        haversine_km(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j"), radius_km), DISTANCE_DECIMALS
    )
    searching = own.select(
        group, F.col("id").alias("i"), F.col("lat").alias("lat_i"), F.col("lon").alias("lon_i"), "x", "y", "z", "level"
    )
    # Neither side may be broadcast by the size of the rows before they are put into cubes.
    inside = searching.select("*", *_cube(F.col("level"))).hint("merge").join(candidates, [group, *CUBE])
    inside = inside.filter(F.col("i") != F.col("j")).select(group, *CUBE, "i", "j", distance.alias("distance_km"))
    # A point has one cube, so its pairs are already together.
    bounds = _nearest(inside, k, [group, *CUBE]).filter(F.col("position") == k).select(group, "i", F.col("distance_km").alias("bound"))
    half = F.least((F.col("bound") + SLACK_KM) / (2 * radius_km), F.lit(math.pi / 2))
    reach = F.coalesce(2 * F.sin(half) + SLACK, F.lit(2.0))
    nearby = searching.join(bounds, [group, "i"], "left").withColumn("reach", reach)
    for axis in ("x", "y", "z"):
        nearby = nearby.withColumn(f"c{axis}", F.explode(_reachable(axis)))
    nearby = nearby.filter(_touches_sphere()).select(group, *CUBE, "i", "lat_i", "lon_i", "bound")
    return (
        nearby.hint("merge").join(candidates, [group, *CUBE])
        .filter(F.col("i") != F.col("j"))
        .select(group, "i", "j", distance.alias("distance_km"), "bound")
        .filter(F.col("bound").isNull() | (F.col("distance_km") <= F.col("bound")))
        .drop("bound")
    )


def _group_moments(points: DataFrame, group: str, value: str) -> DataFrame:
    return points.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.var_pop(value).alias("variance"),
        (F.max(value) == F.min(value)).alias("constant"),
    )


def gi_star(points: DataFrame, edges: DataFrame, group: str, value: str, id_column: str = "station_id") -> DataFrame:
    """Gi* z, two-sided p and class with binary weights, the point itself included."""
    values = points.select(group, F.col(id_column).alias("i"), F.col(value).alias("x"))
    sources = values.withColumnsRenamed({"i": "j"})
    neighbours = (
        edges.select(group, "i", "j")
        .unionByName(values.select(group, "i", F.col("i").alias("j")))
        .join(sources, [group, "j"])
        .groupBy(group, "i")
        .agg(F.sum("x").alias("local_sum"), F.count(F.lit(1)).alias("weight"))
    )
    moments = _group_moments(points, group, value)
    spread = F.sqrt(F.col("variance") * (F.col("n") * F.col("weight") - F.col("weight") * F.col("weight")) / (F.col("n") - 1))
    z = (F.col("local_sum") - F.col("mean") * F.col("weight")) / spread
    return (
        join_groups(neighbours, moments.filter(~F.col("constant") & (F.col("n") > 1)), group)
        .withColumn("gi_z", F.when(spread > 0, z))
        .withColumn("gi_p", two_sided_p(F.col("gi_z")))
        .select(
            group,
            F.col("i").alias(id_column),
            "gi_z",
            "gi_p",
            hotspot_class(F.col("gi_z"), F.col("gi_p")).alias("hotspot_class"),
        )
    )


def morans_i(points: DataFrame, edges: DataFrame, group: str, value: str, id_column: str = "station_id") -> DataFrame:
    """Global Moran's I per group with row-standardised weights.

    The two-sided p-value uses the variance under randomisation. The weight
    sums need no second copy of the edges: S1 follows from the number of
    mutual links and S2 from the number of incoming links of each point.
    """
    moments = _group_moments(points, group, value).filter(~F.col("constant") & (F.col("n") > 3))
    deviations = (
        join_groups(points, moments.select(group, "mean"), group)
        .select(group, F.col(id_column).alias("i"), (F.col(value) - F.col("mean")).alias("z"))
    )
    degrees = edges.groupBy(group, "i").agg(F.count(F.lit(1)).alias("degree"))
    weighted = edges.select(group, "i", "j").join(degrees, [group, "i"]).withColumn("w", 1.0 / F.col("degree"))
    lag_terms = (
        weighted.join(deviations, [group, "i"])
        .join(deviations.withColumnsRenamed({"i": "j", "z": "z_j"}), [group, "j"])
        .groupBy(group)
        .agg(F.sum(F.col("w") * F.col("z") * F.col("z_j")).alias("lagged"), F.sum("w").alias("s0"))
    )
    # Sum over ordered pairs of (wij + wji)^2 / 2 = sum w^2 + sum wij wji.
    s1 = (
        weighted.groupBy(group, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
        .agg(
            F.sum(F.col("w") * F.col("w")).alias("squares"),
            F.when(F.count(F.lit(1)) == 2, 2 * F.max("w") * F.min("w")).otherwise(0.0).alias("mutual"),
        )
        .groupBy(group)
        .agg(F.sum(F.col("squares") + F.col("mutual")).alias("s1"))
    )
    incoming = weighted.select(group, F.col("j").alias("i"), "w")
    outgoing = weighted.select(group, "i", "w")
    s2 = (
        incoming.unionByName(outgoing)
        .groupBy(group, "i")
        .agg(F.sum("w").alias("weight"))
        .groupBy(group)
        .agg(F.sum(F.col("weight") * F.col("weight")).alias("s2"))
    )
    z2 = deviations.groupBy(group).agg(
        F.sum(F.col("z") * F.col("z")).alias("m2"),
        F.sum(F.pow("z", F.lit(4.0))).alias("m4"),
    )
    n, s0, s1c, s2c = F.col("n").cast("double"), F.col("s0"), F.col("s1"), F.col("s2")
    index = n / s0 * F.col("lagged") / F.col("m2")
    expected = -1.0 / (n - 1)
    kurtosis = (F.col("m4") / n) / (F.col("m2") / n * (F.col("m2") / n))
    a = n * ((n * n - 3 * n + 3) * s1c - n * s2c + 3 * s0 * s0)
    b = kurtosis * ((n * n - n) * s1c - 2 * n * s2c + 6 * s0 * s0)
    variance = (a - b) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - expected * expected
    return (
        moments.select(group, "n")
        .join(lag_terms, group)
        .join(s1, group)
        .join(s2, group)
        .join(z2, group)
        .select(
            group,
            index.alias("morans_i"),
            two_sided_p((index - expected) / F.sqrt(variance)).alias("morans_p"),
        )
    )


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest reachable id of every node, links taken in both directions.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each step
    groups links by one end and hooks them to the smallest neighbour, and the
    number of steps grows with the logarithm of the largest component. Each
    round is cut through the shared checkpoint folder.
    """

    def hook(links: DataFrame, large: bool) -> DataFrame:
        # Each node with all its links; large-star keeps the larger neighbours.
        if large:
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(lowest, "u")
        moved = joined.filter(F.col("v") > F.col("u")) if large else joined
        hooked = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            hooked = hooked.unionByName(lowest.select("u", F.col("m").alias("v")))
        return hooked.filter(F.col("u") != F.col("v")).distinct()

    links = cut_lineage(
        edges.select(F.col("i").alias("u"), F.col("j").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    )
    previous = None
    while True:
        links = cut_lineage(hook(hook(links, large=True), large=False))
        state = links.agg(
            F.count(F.lit(1)).alias("links"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")
        ).first()
        if state == previous:
            break
        previous = state
    labels = links.groupBy("u").agg(F.min("v").alias("component"))
    node = F.col("id")
    return nodes.select(node).distinct().join(labels.withColumnRenamed("u", "id"), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
