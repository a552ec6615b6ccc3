"""Region, country and continent of a station from its id, state and longitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationwise.config import CONTINENT_SPLIT, SUBDIVISION_COUNTRIES


def continent_of(code: Column, continent: Column, lon: Column) -> Column:
    """The country's continent, or the side of the dividing longitude."""
    for split_code, (boundary, west, east) in CONTINENT_SPLIT.items():
        continent = F.when(
            code == split_code, F.when(lon < boundary, west).otherwise(east)
        ).otherwise(continent)
    return continent


def station_geography(
    metadata: DataFrame, states: DataFrame, countries: DataFrame, subdivisions: DataFrame
) -> DataFrame:
    """Four-column lookup; a station with an unknown country code gets NULLs.

    The lookups are a few hundred rows; Catalyst broadcasts them from their size.
    """
    code = F.substring("station_id", 1, 2)
    known = (
        metadata.select("station_id", "lon", code.alias("country_code"))
        .join(countries.select("country_code", "country", "continent"), "country_code", "left")
        .join(states.select("station_id", F.col("state").alias("state_code")), "station_id", "left")
        .join(
            subdivisions.select("country_code", "state_code", F.col("region_name").alias("subdivision")),
            ["country_code", "state_code"],
            "left",
        )
    )
    region = F.when(
        F.col("country_code").isin(*SUBDIVISION_COUNTRIES), F.coalesce("subdivision", "country")
    ).otherwise(F.col("country"))
    return known.select(
        "station_id",
        F.when(F.col("country").isNotNull(), region).alias("region_name"),
        "country",
        F.when(
            F.col("country").isNotNull(), continent_of(F.col("country_code"), F.col("continent"), F.col("lon"))
        ).alias("continent"),
    )


def unknown_countries(geography: DataFrame) -> DataFrame:
    return geography.filter(F.col("country").isNull()).select("station_id")


def stations_by(geography: DataFrame, column: str) -> DataFrame:
    """Number of stations per continent or country, missing ones as (unknown)."""
    return geography.groupBy(F.coalesce(F.col(column), F.lit("(unknown)")).alias(column)).agg(
        F.count(F.lit(1)).alias("stations")
    )
