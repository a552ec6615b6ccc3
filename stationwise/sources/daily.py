"""Fixed-width daily station files: one line per station, month and element."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.config import ELEMENTS
from stationwise.operators.observations import keep_valid

# Fixed values of the layout (1-based): first block column and block width.
FIRST_BLOCK = 22
BLOCK_WIDTH = 8


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The text lines of one or many files, as column ``value``."""
    return spark.read.schema("value string").text(paths)


def number(text: Column, kind: str = "int") -> Column:
    """A number from padded text; NULL when it is not one."""
    return F.trim(text).try_cast(kind)


def parse_daily_lines(lines: DataFrame) -> DataFrame:
    """Every stored day of the wanted elements, before quality filtering.

    Lines are filtered by element first. Day blocks are cut inside the row and
    only those of real days with a value are exploded, so a line never travels
    31 times.
    """
    value = F.rpad("value", FIRST_BLOCK - 1 + 31 * BLOCK_WIDTH, " ")
    header = lines.filter(F.substring("value", 18, 4).isin(*ELEMENTS)).select(
        F.substring("value", 1, 11).alias("station_id"),
        number(F.substring("value", 12, 4)).alias("year"),
        number(F.substring("value", 16, 2)).alias("month"),
        F.substring("value", 18, 4).alias("element"),
        value.alias("value"),
    )
    first_day = F.make_date("year", "month", F.lit(1))
    dated = header.filter(F.col("year").between(1, 9999) & F.col("month").between(1, 12)).withColumn(
        "first_day", first_day
    )
    blocks = F.transform(
        F.sequence(F.lit(1), F.dayofmonth(F.last_day("first_day"))),
        lambda day: F.struct(
            day.alias("day"),
            F.col("value").substr(FIRST_BLOCK + (day - 1) * BLOCK_WIDTH, F.lit(BLOCK_WIDTH)).alias("text"),
        ),
    )
    stored = F.filter(blocks, lambda b: ~F.substring(b["text"], 1, 5).isin("-9999", "     "))
    text = F.col("block.text")
    return dated.select("station_id", "element", "first_day", F.explode(stored).alias("block")).select(
        "station_id",
        F.date_add("first_day", F.col("block.day") - 1).alias("date"),
        "element",
        number(F.substring(text, 1, 5)).alias("raw_value"),
        F.substring(text, 6, 1).alias("measurement_flag"),
        F.substring(text, 7, 1).alias("quality_flag"),
        F.substring(text, 8, 1).alias("source_flag"),
    )


def clean_daily(parsed: DataFrame) -> DataFrame:
    """Valid observations in degrees C and mm."""
    return keep_valid(parsed).select(
        "station_id",
        "date",
        "element",
        (F.col("raw_value") / 10.0).alias("value"),
        F.when(F.col("element") == "PRCP", "mm").otherwise("degrees_C").alias("unit"),
        "measurement_flag",
        "source_flag",
    )


def read_daily(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Clean long observations of one or many daily station files."""
    return clean_daily(parse_daily_lines(read_lines(spark, paths)))


def fitted(text: Column, width: int) -> Column:
    """Text padded to a field's width; a longer one is an error, never cut."""
    wide = F.raise_error(F.concat(F.lit("value too wide for its field: "), text)).cast("string")
    return F.when(F.length(text) > width, wide).otherwise(F.lpad(text, width, " "))


def format_daily_lines(observations: DataFrame) -> DataFrame:
    """The same layout from (station_id, date, element, raw_value): the inverse of the parser.

    A month of one element is at most 31 values, so a line is a bounded group.
    """
    by_day = F.map_from_entries(F.collect_list(F.struct(F.dayofmonth("date"), F.col("raw_value"))))
    months = (
        observations.groupBy(
            "station_id", F.year("date").alias("year"), F.month("date").alias("month"), "element", "date"
        )
        .agg(F.max("raw_value").alias("raw_value"))
        .groupBy("station_id", "year", "month", "element")
        .agg(by_day.alias("days"))
    )
    blocks = F.transform(
        F.sequence(F.lit(1), F.lit(31)),
        lambda day: F.coalesce(
            F.concat(fitted(F.col("days")[day].cast("string"), 5), F.lit("  S")), F.lit("-9999   ")
        ),
    )
    return months.select(
        F.concat(
            F.reverse(fitted(F.reverse("station_id"), 11)),
            F.lpad(F.col("year").cast("string"), 4, "0"),
            F.lpad(F.col("month").cast("string"), 2, "0"),
            F.col("element"),
            F.array_join(blocks, ""),
        ).alias("value")
    )


def station_file_status(spark: SparkSession, folder: str, candidates: DataFrame) -> DataFrame:
    """Status of every candidate's file in a folder: ok or not_found.

    Only file names are listed; no content is read.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.dly")
        .load(folder)
        .select(F.regexp_extract("path", r"([^/]+)\.dly$", 1).alias("station_id"), F.lit("ok").alias("found"))
    )
    return candidates.join(listed, "station_id", "left").select(
        *candidates.columns, F.coalesce("found", F.lit("not_found")).alias("status")
    )
