"""Station-like daily observations derived from the order tables.

The test tables hold no weather, so a station is a supplier's region or nation,
a day is a ship date, TMAX and TMIN are the largest and smallest line price of
the day, and PRCP is the returned quantity of the day. All queries run over the
whole tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.config import ClimateConfig
from stationwise.operators.observations import wide_to_long
from stationwise.session import cut_lineage
from stationwise.sources.indices import SEASONS

REGION_RULES = ClimateConfig(
    baseline_start=dt.date(1995, 1, 2),
    baseline_end=dt.date(1999, 12, 31),
    trend_first_year=1995,
    trend_last_year=2001,
    min_baseline_valid_years=4,
    min_trend_years=5,
    hot_percentile=0.80,
    cold_percentile=0.20,
    rain_percentile=0.75,
    dry_min_days=3,
)

NATION_RULES = ClimateConfig(
    baseline_start=dt.date(1995, 1, 2),
    baseline_end=dt.date(1999, 12, 31),
    trend_first_year=1995,
    trend_last_year=2001,
    valid_year_pct=55.0,
    element_completeness=0.50,
    min_baseline_valid_years=4,
    min_trend_years=6,
    hot_percentile=0.70,
    cold_percentile=0.30,
    rain_percentile=0.75,
    wet_day_mm=10.0,
    dry_min_days=3,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def station_id(key: Column) -> Column:
    """At least eleven characters, like a station id of the fixed-width layouts; longer keys stay whole."""
    digits = key.cast("string")
    return F.concat(F.lit("ST"), F.repeat(F.lit("0"), F.greatest(9 - F.length(digits), F.lit(0))), digits)


def day_observations(spark: SparkSession, folder: str, grain: str = "nation") -> DataFrame:
    """Wide days of every region or nation, combined on the map side."""
    key = {"region": "n_regionkey", "nation": "s_nationkey"}[grain]
    lines = table(spark, folder, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity", "l_returnflag"
    )
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    if grain == "region":
        nations = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
        suppliers = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(station_id(F.col(key)).alias("station_id"), "date")
        .agg(
            F.max("l_extendedprice").alias("tmax"),
            F.min("l_extendedprice").alias("tmin"),
            F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("prcp"),
        )
    )


def long_observations(spark: SparkSession, folder: str, grain: str = "nation") -> DataFrame:
    return wide_to_long(day_observations(spark, folder, grain))


def reused(frame: DataFrame) -> DataFrame:
    """Write a derived station table once when a plan reads it several times.

    It has one row per station and day (or fewer), is small against the order
    lines it comes from, and sits in the shared checkpoint folder, so a lost
    executor loses nothing. A cached plan would not do: a self join of a plan
    with array lambdas gets new names and misses the cache.
    """
    return cut_lineage(frame)


def pseudo_lat(key: Column) -> Column:
    """The tables have no coordinates: a fixed rule spreads the keys over the globe, whatever their number type."""
    return (key.cast("long") * 7919 % 12000) / 100.0 - 60.0


def pseudo_lon(key: Column) -> Column:
    return (key.cast("long") * 104729 % 34000) / 100.0 - 170.0


def station_list(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as stations with position, elevation (missing for some) and geography."""
    key = F.col("n_nationkey")
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return nations.select(
        station_id(key).alias("station_id"),
        F.col("n_name").alias("station_name"),
        pseudo_lat(key).alias("lat"),
        pseudo_lon(key).alias("lon"),
        F.when(key % 7 == 0, -999.9).otherwise(key * 10.5).alias("elevation_m"),
        F.col("n_name").alias("region_name"),
        F.when(F.col("r_name") == "AMERICA", "United States").otherwise(F.col("r_name")).alias("country"),
        F.col("r_name").alias("continent"),
    )


def supplier_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as located points with one measured value, by account level."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        station_id(key).alias("station_id"),
        pseudo_lat(key).alias("lat"),
        pseudo_lon(key).alias("lon"),
        F.col("s_nationkey"),
        F.col("s_acctbal").alias("level"),
        F.when(F.col("s_acctbal") < 3000, "low").otherwise("high").alias("event_type"),
    )


def storm_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as storm records: the customer's nation, a type by priority, text dates."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    priority = F.substring("o_orderpriority", 1, 1)
    text = "dd-MMM-yy HH:mm:ss"
    long = F.when(F.col("o_orderkey") % 97 == 0, 150).otherwise(0)
    end = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 3 + long).cast("int"))
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("STATE"),
            F.when(priority == "1", "Heat")
            .when(priority == "2", "Flood")
            .when(priority == "3", "Drought")
            .when(priority == "4", "Frost/Freeze")
            .otherwise("Hail")
            .alias("EVENT_TYPE"),
            F.upper(F.date_format("o_orderdate", text)).alias("BEGIN_DATE_TIME"),
            F.upper(F.date_format(end.cast("timestamp"), text)).alias("END_DATE_TIME"),
            F.year("o_orderdate").cast("string").alias("YEAR"),
        )
    )


def monthly_index_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per month as index text: the share of finished orders as an anomaly."""
    seasons = F.array(*[F.lit(s) for s in SEASONS])
    finished = F.count_if(F.col("o_orderstatus") == "F") * 100.0 / F.count(F.lit(1))
    return (
        table(spark, folder, "orders")
        .groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
        .agg(F.round((finished - 33.0) / 2.0, 2).alias("anomaly"))
        .select(F.concat_ws(" ", seasons[F.col("month") - 1], "year", "anomaly").alias("value"))
    )


def tenths(wide: DataFrame) -> DataFrame:
    """Long observations as whole numbers that fit the fixed-width layout."""
    return wide_to_long(wide).withColumn("raw_value", F.pmod(F.floor("value"), F.lit(100_000)).cast("int"))


def inventory_lines(wide: DataFrame) -> DataFrame:
    """Year range of every station and element in the inventory layout."""
    key = F.substring("station_id", 3, 9).cast("int")
    return (
        wide_to_long(wide)
        .groupBy("station_id", "element")
        .agg(F.min(F.year("date")).alias("first_year"), F.max(F.year("date")).alias("last_year"))
        .select(
            F.format_string(
                "%-11s %8.4f %9.4f %s %4d %4d",
                "station_id", pseudo_lat(key), pseudo_lon(key), "element", "first_year", "last_year",
            ).alias("value")
        )
    )
