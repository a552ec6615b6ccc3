"""Station list, station metadata, inventory and lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.config import ELEMENTS
from stationwise.functions.geo import valid_position
from stationwise.sources.daily import number, read_lines

COUNTRY_SCHEMA = "country_code string, country string, continent string"
SUBDIVISION_SCHEMA = "country_code string, state_code string, region_name string"
METADATA_SCHEMA = "station_id string, station_name string, lat double, lon double, elevation_m double"


def read_station_ids(spark: SparkSession, path: str) -> DataFrame:
    """Station ids, one per line; blank lines are skipped."""
    ids = read_lines(spark, path).select(F.trim("value").alias("station_id"))
    return ids.filter(F.col("station_id") != "").distinct()


def parse_station_lines(lines: DataFrame) -> DataFrame:
    """All columns of the station metadata layout; unreadable numbers are NULL."""
    return lines.filter(F.length("value") >= 11).select(
        F.trim(F.substring("value", 1, 11)).alias("station_id"),
        F.trim(F.substring("value", 42, 30)).alias("station_name"),
        number(F.substring("value", 13, 8), "double").alias("lat"),
        number(F.substring("value", 22, 9), "double").alias("lon"),
        number(F.substring("value", 32, 6), "double").alias("elevation_m"),
        F.trim(F.substring("value", 39, 2)).alias("state"),
    )


def format_station_lines(stations: DataFrame) -> DataFrame:
    """The metadata layout from (station_id, lat, lon, elevation_m, state, station_name): the inverse of the parser.

    Numbers are written with the decimals of the layout, texts as they are; NULL is blank.
    """
    kinds = dict(stations.dtypes)

    def text(name: str, layout: str) -> Column:
        plain = F.col(name) if kinds[name] == "string" else F.format_string(layout, F.col(name).cast("double"))
        return F.coalesce(plain, F.lit(""))

    fields = [
        F.rpad(text("station_id", ""), 11, " "), F.lpad(text("lat", "%.4f"), 8, " "), F.lpad(text("lon", "%.4f"), 9, " "),
        F.lpad(text("elevation_m", "%.1f"), 6, " "), F.rpad(text("state", ""), 2, " "), F.rpad(text("station_name", ""), 30, " "),
    ]
    return stations.select(F.concat_ws(" ", *fields).alias("value"))


def station_line_faults() -> Column:
    """Why a station line cannot be used; NULL for a usable one. The first reason counts."""
    lat, lon = number(F.substring("value", 13, 8), "double"), number(F.substring("value", 22, 9), "double")
    elevation = number(F.substring("value", 32, 6), "double")
    return (
        F.when(F.length("value") < 11, "line shorter than an id")
        .when(F.trim(F.substring("value", 1, 11)) == "", "no station id")
        .when(lat.isNull(), "latitude is not a number")
        .when(lon.isNull(), "longitude is not a number")
        .when(elevation.isNull(), "elevation is not a number")
        .when(~valid_position(lat, lon), "position outside the globe")
    )


def store_station_lines(spark: SparkSession, paths: str | Sequence[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """(usable stations, rejects with file, line and reason), both written by one pass over the files.

    The pass writes one table in two partitions; each of the results reads one of them.
    """
    lines = spark.read.schema("value string").text(paths).select("value", F.col("_metadata.file_name").alias("file"))
    reason = station_line_faults()
    marked = lines.select("*", reason.alias("reason"), reason.isNull().alias("usable"))
    marked.write.mode("overwrite").partitionBy("usable").parquet(folder)
    stored = spark.read.schema("value string, file string, reason string, usable boolean").parquet(folder)
    good, bad = stored.filter("usable"), stored.filter("NOT usable")
    return parse_station_lines(good), bad.select("file", F.col("value").alias("line"), "reason")


def coverage_of(metadata: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids on one side only: wanted ones without metadata, and extra ones nobody asked for."""
    sides = wanted.select("station_id", F.lit(1).alias("is_wanted")).distinct().join(
        metadata.select("station_id", F.lit(1).alias("is_known")).distinct(), "station_id", "full_outer"
    )
    problem = F.when(F.col("is_known").isNull(), "missing").when(F.col("is_wanted").isNull(), "extra")
    return sides.select("station_id", problem.alias("problem")).filter("problem IS NOT NULL")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return parse_station_lines(read_lines(spark, path)).select("station_id", "state")


def station_metadata(stations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Metadata of the wanted stations whose coordinates and elevation are readable."""
    readable = stations.filter(
        F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("elevation_m").isNotNull()
    )
    return readable.join(wanted.select("station_id"), "station_id", "left_semi").select(
        "station_id", "station_name", "lat", "lon", "elevation_m"
    )


def missing_metadata(metadata: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted stations without metadata."""
    return wanted.select("station_id").join(metadata.select("station_id"), "station_id", "left_anti")


def require_metadata(metadata: DataFrame, wanted: DataFrame, shown: int = 20) -> DataFrame:
    """The metadata, or an error that names some of the missing stations."""
    missing = missing_metadata(metadata, wanted).orderBy("station_id").limit(shown).collect()
    if missing:
        raise ValueError(f"missing metadata for stations: {[r['station_id'] for r in missing]}")
    return metadata


def parse_inventory_lines(lines: DataFrame) -> DataFrame:
    """One row per station that records all three elements, with the common year range."""
    rows = lines.filter(F.substring("value", 32, 4).isin(*ELEMENTS)).select(
        F.substring("value", 1, 11).alias("station_id"),
        number(F.substring("value", 13, 8), "double").alias("lat"),
        number(F.substring("value", 22, 9), "double").alias("lon"),
        F.substring("value", 32, 4).alias("element"),
        number(F.substring("value", 37, 4)).alias("first_year"),
        number(F.substring("value", 42, 4)).alias("last_year"),
    )
    complete = F.col("first_year").isNotNull() & F.col("last_year").isNotNull() & F.col("lat").isNotNull()
    return (
        rows.filter(complete & F.col("lon").isNotNull())
        .groupBy("station_id")
        .agg(
            F.max_by(F.struct("lat", "lon"), F.struct("element", "lat", "lon")).alias("position"),
            F.max("first_year").alias("first_year"),
            F.min("last_year").alias("last_year"),
            F.count_distinct("element").alias("elements"),
        )
        .filter(F.col("elements") == len(ELEMENTS))
        .select("station_id", "position.lat", "position.lon", "first_year", "last_year")
    )


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return parse_inventory_lines(read_lines(spark, path))


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """Country code, country and continent, from the CSV the user keeps."""
    return spark.read.option("header", True).schema(COUNTRY_SCHEMA).csv(path)


def read_subdivisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(SUBDIVISION_SCHEMA).csv(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(METADATA_SCHEMA).csv(path)
