"""Risk score, hotspots and global spatial statistics (Tables B and C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationwise.config import TREND_MEASURES, ClimateConfig, SpatialConfig
from stationwise.functions.ranking import with_descending_rank, with_percentile_rank
from stationwise.operators.spatial import connected_components, gi_star, morans_i, nearest_neighbours
from stationwise.operators.trends import TABLE_B_COLUMNS, counts_for_trend
from stationwise.session import cut_lineage, join_groups

GROUP = "event_type"
RISK_COLUMNS = ["risk_score", "risk_rank", "gi_z_score", "gi_p_value", "hotspot_class"]
# Hotspot classes and the columns that count them.
HOTSPOT_COLUMNS = {
    "Hot spot 99%": "hot_99",
    "Hot spot 95%": "hot_95",
    "Hot spot 90%": "hot_90",
    "Not significant": "not_significant",
    "Cold spot 90%": "cold_90",
    "Cold spot 95%": "cold_95",
    "Cold spot 99%": "cold_99",
}

TABLE_C_COLUMNS = [GROUP, "morans_i", "morans_p_value", "n_stations"]


def station_levels(table_a: DataFrame, config: ClimateConfig) -> DataFrame:
    """Mean yearly value of every measure over the valid years, in long form."""
    means = (
        table_a.filter(counts_for_trend(config))
        .groupBy("station_id")
        .agg(*[F.avg(measure).alias(event_type) for event_type, measure in TREND_MEASURES.items()])
    )
    return means.unpivot("station_id", list(TREND_MEASURES), GROUP, "level").filter(F.col("level").isNotNull())


def ranked_rows(table_a: DataFrame, table_b: DataFrame, config: ClimateConfig) -> DataFrame:
    """Trend-eligible station rows with a level: the rows that take part."""
    return (
        table_b.filter("trend_eligible")
        .select("station_id", GROUP, "lat", "lon", "trend_slope")
        .join(station_levels(table_a, config), ["station_id", GROUP])
    )


def group_profile(rows: DataFrame) -> DataFrame:
    """One row per event type: size, variation and whether all have coordinates."""
    return rows.groupBy(GROUP).agg(
        F.count(F.lit(1)).alias("n_stations"),
        (F.max("level") == F.min("level")).alias("level_constant"),
        (F.max("trend_slope") == F.min("trend_slope")).alias("slope_constant"),
        F.bool_and(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("all_located"),
    )


def risk_scores(rows: DataFrame, spatial: SpatialConfig = SpatialConfig()) -> DataFrame:
    """Weighted percentile ranks of level and slope, 0..100, and the rank.

    Event types without any variation get no score. The rank uses the score
    before rounding.
    """
    varied = group_profile(rows).filter(~(F.col("level_constant") & F.col("slope_constant"))).select(GROUP)
    rows = join_groups(rows, varied, GROUP, "left_semi")
    ranked = with_percentile_rank(rows, GROUP, "level", "level_rank")
    ranked = with_percentile_rank(ranked, GROUP, "trend_slope", "slope_rank")
    score = 100.0 * (spatial.level_weight * F.col("level_rank") + spatial.trend_weight * F.col("slope_rank"))
    scored = cut_lineage(ranked.select("station_id", GROUP, score.alias("score")))
    return with_descending_rank(scored, GROUP, "score", "risk_rank").select("station_id", GROUP, F.bround("score", 1).alias("risk_score"), "risk_rank")


def located_groups(rows: DataFrame, spatial: SpatialConfig) -> DataFrame:
    """Rows of the event types that can have hotspots."""
    possible = group_profile(rows).filter(
        F.col("all_located") & ~F.col("level_constant") & (F.col("n_stations") >= spatial.min_stations)
    )
    return join_groups(rows, possible.select(GROUP), GROUP, "left_semi")


def risk_and_hotspots(
    table_a: DataFrame,
    table_b: DataFrame,
    config: ClimateConfig,
    spatial: SpatialConfig = SpatialConfig(),
) -> tuple[DataFrame, DataFrame]:
    """Table B with its risk and hotspot columns filled, and Table C.

    The participating rows and the neighbour graph are written once: ranks,
    hotspots and Moran's I all start from them.
    """
    rows = cut_lineage(ranked_rows(table_a, table_b, config))
    placed = located_groups(rows, spatial)
    edges = cut_lineage(nearest_neighbours(placed, spatial.neighbours, GROUP, spatial.earth_radius_km))
    spots = gi_star(placed, edges, GROUP, "level").select(
        "station_id",
        GROUP,
        F.bround("gi_z", 3).alias("gi_z_score"),
        F.bround("gi_p", 4).alias("gi_p_value"),
        "hotspot_class",
    )
    keys = ["station_id", GROUP]
    summary = (
        table_b.drop(*RISK_COLUMNS)
        .join(risk_scores(rows, spatial), keys, "left")
        .join(spots, keys, "left")
        .select(*TABLE_B_COLUMNS)
    )
    spark = table_b.sparkSession
    types = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in TREND_MEASURES])).alias(GROUP))
    moran = morans_i(placed, edges, GROUP, "level").select(
        GROUP, F.bround("morans_i", 4).alias("morans_i"), F.bround("morans_p", 4).alias("morans_p_value")
    )
    table_c = (
        types.join(group_profile(rows).select(GROUP, "n_stations"), GROUP, "left")
        .join(moran, GROUP, "left")
        .fillna({"n_stations": 0})
        .select(*TABLE_C_COLUMNS)
    )
    return summary, table_c


def hotspot_counts(spots: DataFrame) -> DataFrame:
    """Number of stations by event type and hotspot class; unclassified rows are left out."""
    return (
        spots.filter(F.col("hotspot_class").isNotNull())
        .groupBy(GROUP)
        .agg(*[F.count_if(F.col("hotspot_class") == label).alias(name) for label, name in HOTSPOT_COLUMNS.items()])
    )


def neighbour_groups(stations: DataFrame, spatial: SpatialConfig = SpatialConfig()) -> DataFrame:
    """Component label of every located station in the nearest-neighbour graph."""
    located = stations.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("graph", F.lit(0))
    edges = nearest_neighbours(located, spatial.neighbours, "graph", spatial.earth_radius_km)
    return connected_components(edges, located.select(F.col("station_id").alias("id"))).withColumnRenamed(
        "id", "station_id"
    )
