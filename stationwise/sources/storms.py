"""Storm record files: CSV or CSV.GZ, all columns as text."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

REVISION = r"StormEvents_details-ftp_v1\.0_d(\d{4})_c(\d{8})\.csv(?:\.gz)?$"


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names from the first line of a CSV file, also a compressed one; only that line is read."""
    jvm, configuration = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(configuration).open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(configuration).getCodec(place)
        plain = stream if codec is None else codec.createInputStream(stream)
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()
    names, seen = [], {}
    for name in next(csv.reader([line or ""]), []):
        name = name.strip().lstrip("\ufeff")
        seen[name] = seen.get(name, 0) + 1
        # A name that repeats within a file keeps its columns apart.
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return tuple(names)


def files_of(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """The files that paths, folders and patterns stand for, in order."""
    found: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for match in system.globStatus(place) or []:
            inside = system.listStatus(match.getPath()) if match.isDirectory() else [match]
            found += [f.getPath().toString() for f in inside if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    return sorted(found)


def read_storm_events(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All columns as strings, by the header of their own file.

    Files are grouped by header (one line is read of each) and read group by group,
    so columns may be in another order, or missing, from file to file; a column
    that a file lacks is NULL there. Bad rows are kept permissively.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in files_of(spark, paths):
        groups.setdefault(header_of(spark, path), []).append(path)
    parts = [
        spark.read.option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
        .schema(StructType([StructField(name, StringType()) for name in names])).csv(files)
        for names, files in sorted(groups.items()) if any(names)
    ]
    if not parts:
        raise ValueError(f"no file with a header in {paths}")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union


def newest_revisions(listing: DataFrame, name: str = "filename") -> DataFrame:
    """Newest file of every year from a listing of file names."""
    file_name = F.regexp_extract(name, r"([^/]+)$", 1)
    return (
        listing.select(
            file_name.alias("filename"),
            F.regexp_extract(file_name, REVISION, 1).alias("year"),
            F.regexp_extract(file_name, REVISION, 2).alias("created"),
        )
        .filter(F.col("created") != "")
        .groupBy(F.col("year").cast("int").alias("year"))
        .agg(F.max_by("filename", F.struct("created", "filename")).alias("filename"), F.max("created").alias("created"))
    )


def valid_station_ids(ids: DataFrame) -> DataFrame:
    """Ids of eleven capital letters, digits or dashes."""
    return ids.filter(F.col("station_id").rlike("^[A-Z0-9-]{11}$"))
