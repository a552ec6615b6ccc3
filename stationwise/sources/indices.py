"""Monthly ocean index text: SEAS YR [TOTAL] ANOM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.operators.checks import duplicate_keys
from stationwise.operators.phases import label_phases
from stationwise.sources.daily import read_lines

# Overlapping three-month seasons by centre month 1..12.
SEASONS = ("DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ")


def parse_index_lines(lines: DataFrame) -> DataFrame:
    """Year, month, season and anomaly (the last column); other lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    month = F.array_position(F.array(*[F.lit(s) for s in SEASONS]), parts[0]).cast("int")
    return lines.filter((F.size(parts) >= 3) & (month > 0)).select(
        parts[1].cast("int").alias("year"),
        month.alias("month"),
        parts[0].alias("season"),
        F.element_at(parts, -1).cast("double").alias("nino34_anomaly"),
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_index_lines(read_lines(spark, path))


def phase_table(monthly: DataFrame) -> DataFrame:
    """The index with phases; a repeated month is an error."""
    if not duplicate_keys(monthly, ["year", "month"]).isEmpty():
        raise ValueError("duplicate year-month rows in the index")
    return label_phases(monthly)
