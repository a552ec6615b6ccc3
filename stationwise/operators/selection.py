"""Candidate stations, spread-out selection and farthest-point choice."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationwise.config import NETWORK_PRIOR, SelectionConfig
from stationwise.functions.geo import grid_cell, haversine_km, valid_position
from stationwise.functions.scans import with_position
from stationwise.operators.farthest import farthest_order
from stationwise.session import cut_lineage

CELL = ["lat_cell", "lon_cell"]


def with_cell(stations: DataFrame, degrees: float) -> DataFrame:
    """Add the degree-grid cell of each station."""
    cell = grid_cell(F.col("lat"), F.col("lon"), degrees)
    return stations.withColumn("cell", cell).select("*", *[f"cell.{c}" for c in CELL]).drop("cell")


def network_prior(station_id: Column) -> Column:
    pairs = [F.lit(item) for pair in NETWORK_PRIOR.items() for item in pair]
    return F.coalesce(F.create_map(*pairs)[F.substring(station_id, 3, 1)], F.lit(0))


def choose_candidates(inventory: DataFrame, config: SelectionConfig = SelectionConfig()) -> DataFrame:
    """Up to n candidates per grid cell, best network and longest record first.

    Without limits the whole pool is returned in its order within the cells. Places
    are counted over range blocks of the whole order, so a crowded cell is spread
    over many tasks. Required
    stations that are in the pool are always added; ``candidates_cut`` counts
    what the limits left out.
    """
    pool = with_cell(
        inventory.filter(
            (F.col("first_year") <= config.first_year)
            & (F.col("last_year") >= config.last_year)
            & valid_position(F.col("lat"), F.col("lon"))
        ),
        config.cell_degrees,
    )
    prior = F.desc(network_prior(F.col("station_id")))
    order = [prior, F.asc("first_year"), F.desc("last_year"), F.asc("station_id")]
    columns = ["station_id", "lat", "lon", "first_year", "last_year", *CELL, "position"]
    chosen = with_position(pool, CELL, order, "position")
    if config.candidates_per_cell is not None:
        chosen = chosen.filter(F.col("position") <= config.candidates_per_cell)
    if config.max_candidates is not None:
        chosen = chosen.orderBy("position", *CELL, "station_id").limit(config.max_candidates)
    chosen = chosen.select(*columns)
    if not config.required:
        return chosen
    required = pool.filter(F.col("station_id").isin(*config.required)).withColumn("position", F.lit(0)).select(*columns)
    return chosen.unionByName(required.join(chosen.select("station_id"), "station_id", "left_anti"))


def candidates_cut(inventory: DataFrame, config: SelectionConfig) -> DataFrame:
    """Number of candidates that the limits of the configuration leave out."""
    whole = choose_candidates(inventory, replace(config, candidates_per_cell=None, max_candidates=None))
    kept = choose_candidates(inventory, config).select("station_id")
    return whole.join(kept, "station_id", "left_anti").agg(F.count(F.lit(1)).alias("candidates_cut"))


def passing(results: DataFrame) -> DataFrame:
    """Screened stations that meet every rule."""
    return results.filter(
        (F.col("status") == "ok") & F.col("baseline_eligible") & F.col("enough_years_for_trend")
    )


def select_stations(
    results: DataFrame,
    config: SelectionConfig = SelectionConfig(),
    order_columns: Sequence[str] = ("valid_years_1991_2025", "baseline_valid_years"),
) -> DataFrame:
    """The best stations of every cell, far enough from those already chosen there.

    One round per place in a cell: the best remaining station of each cell is
    found by a map-side combined maximum, then stations too close to it leave.
    That is the greedy choice, without collecting a cell into one task.
    Required stations take their places first.
    """
    ok = with_cell(passing(results), config.cell_degrees)
    is_required = F.col("station_id").isin(*config.required) if config.required else F.lit(False)
    first = [*order_columns]
    rank_key = F.struct(*[(-F.col(c)).alias(c) for c in first], F.col("station_id").alias("id"))

    chosen = ok.filter(is_required).withColumn("place", F.row_number().over(
        Window.partitionBy(*CELL).orderBy(*[F.desc(c) for c in first], "station_id")
    ))
    taken = chosen.groupBy(*CELL).agg(F.count(F.lit(1)).alias("taken"))
    remaining = ok.filter(~is_required).join(taken, CELL, "left").fillna({"taken": 0})
    remaining = _far_from(remaining, chosen, config)
    for _ in range(config.per_cell):
        best = (
            remaining.filter(F.col("taken") < config.per_cell)
            .groupBy(*CELL)
            .agg(F.min_by(F.struct("*"), rank_key).alias("best"))
            .select("best.*")
        )
        best = cut_lineage(best)
        chosen = chosen.unionByName(
            best.withColumn("place", F.col("taken") + 1).select(*chosen.columns)
        )
        remaining = remaining.join(best.select("station_id"), "station_id", "left_anti")
        remaining = cut_lineage(_far_from(remaining, best, config).withColumn("taken", F.col("taken") + 1))
    return chosen


def _far_from(stations: DataFrame, chosen: DataFrame, config: SelectionConfig) -> DataFrame:
    """Stations at the minimum distance from every chosen station of their cell."""
    places = chosen.select(*CELL, F.col("lat").alias("lat_c"), F.col("lon").alias("lon_c"))
    distance = haversine_km(
        F.col("lat"), F.col("lon"), F.col("lat_c"), F.col("lon_c"), config.earth_radius_km
    )
    conflict = [F.col(f"s.{c}") == F.col(f"p.{c}") for c in CELL] + [distance < config.min_separation_km]
    return stations.alias("s").join(places.alias("p"), conflict, "left_anti")


def farthest_points(
    stations: DataFrame,
    limit: int,
    start: Sequence[str] = (),
    radius_km: float = 6371.0088,
    tie_columns: Sequence[str] = ("station_id",),
) -> DataFrame:
    """Repeatedly add the station farthest from those already kept, with its ``pick_order``.

    Ties go to the first station in ``tie_columns`` order. Without a start
    station the first one in that order begins.
    """
    picked, _ = farthest_order(stations, limit, start, radius_km, tie_columns)
    if not picked:
        return stations.limit(0).withColumn("pick_order", F.lit(0))
    order = stations.sparkSession.createDataFrame(
        [(station, place) for place, station in enumerate(picked, start=1)], "station_id string, pick_order int"
    )
    return stations.join(F.broadcast(order), "station_id")


def thin_selection(selected: DataFrame, config: SelectionConfig = SelectionConfig()) -> DataFrame:
    """The wanted number of stations, thinned by farthest points; all of them without a limit."""
    if config.max_stations is None:
        return selected
    kept = farthest_points(
        selected, config.max_stations, config.required, config.earth_radius_km, (*CELL, "place")
    )
    return kept.drop("pick_order")


def pilot_stations(stations: DataFrame, size: int = 100, required: Sequence[str] = SelectionConfig().required) -> DataFrame:
    """Farthest-point pilot from stations with valid positions (radius 6371.0 km)."""
    located = stations.filter(valid_position(F.col("lat"), F.col("lon")))
    found = located.filter(F.col("station_id").isin(*required)).count() if required else 0
    if found != len(required):
        raise ValueError("required stations are not among the eligible stations")
    return farthest_points(located, max(size, len(required)), required, radius_km=6371.0)


# ---- screening results ----------------------------------------------------


def merge_results(done: DataFrame, new: DataFrame) -> DataFrame:
    """Results after a run: the new row of a station replaces the older one.

    Only finished rows of earlier runs are kept, so failed stations are retried.
    """
    finished = done.filter(F.col("status").isin("ok", "not_found"))
    return finished.join(new.select("station_id"), "station_id", "left_anti").unionByName(
        new, allowMissingColumns=True
    )


def still_to_screen(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Candidates without a finished result."""
    finished = done.filter(F.col("status").isin("ok", "not_found")).select("station_id")
    return candidates.join(finished, "station_id", "left_anti")


def screening_report(results: DataFrame, selected: DataFrame) -> DataFrame:
    """Screened, passing and selected stations by continent with a TOTAL row."""
    marks = (
        results.filter(F.col("status") == "ok")
        .select("continent", "station_id", F.lit(1).alias("screened"))
        .join(passing(results).select("station_id", F.lit(1).alias("passing")), "station_id", "left")
        .join(selected.select("station_id", F.lit(1).alias("selected")), "station_id", "left")
    )
    return (
        marks.filter(F.col("continent").isNotNull())
        .rollup("continent")
        .agg(
            F.sum("screened").alias("screened"),
            F.coalesce(F.sum("passing"), F.lit(0)).alias("passing"),
            F.coalesce(F.sum("selected"), F.lit(0)).alias("selected"),
            F.grouping("continent").alias("is_total"),
        )
        .select(
            F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("continent")).alias("continent"),
            "screened",
            "passing",
            "selected",
        )
    )


COMPARED = ["meets_80_all_variables", "baseline_eligible", "enough_years_for_trend"]


def compare_results(mine: DataFrame, pipeline: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per station and column on which two eligibility tables differ."""
    columns = list(columns or ["baseline_valid_years", "valid_years_1991_2025", *COMPARED])
    both = mine.alias("a").join(pipeline.alias("b"), "station_id")
    items = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"a.{c}").cast("int").alias("screening"),
                F.col(f"b.{c}").cast("int").alias("pipeline"),
            )
            for c in columns
        ]
    )
    return (
        both.select("station_id", F.explode(items).alias("item"))
        .select("station_id", "item.*")
        .filter(~F.col("screening").eqNullSafe(F.col("pipeline")))
    )


def id_overlap(mine: DataFrame, other: DataFrame) -> DataFrame:
    """Counts of ids on both sides and on one side only."""
    sides = mine.select("station_id").distinct().withColumn("in_mine", F.lit(1)).join(
        other.select("station_id").distinct().withColumn("in_other", F.lit(1)), "station_id", "full_outer"
    )
    return sides.agg(
        F.count_if(F.col("in_mine").isNotNull() & F.col("in_other").isNotNull()).alias("common"),
        F.count_if(F.col("in_other").isNull()).alias("only_mine"),
        F.count_if(F.col("in_mine").isNull()).alias("only_other"),
    )
