"""Writers. A table written here can be read back as the start of the next step."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_parquet(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Overwrite a Parquet table and return it as read back."""
    writer = frame.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def write_events(events: DataFrame, path: str) -> DataFrame:
    """Events in one folder per event type."""
    return write_parquet(events, path, ["event_type"])


def rewrite_events(events: DataFrame, path: str) -> None:
    """Replace the stored events of the types that the frame holds; other types stay as they are."""
    writer = events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("event_type").parquet(path)


def read_events(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The event store; a filter on ``event_type`` reads only the folders of those types."""
    return spark.read.schema(schema).parquet(path)


def write_ordered_csv(frame: DataFrame, path: str, order: Sequence[str]) -> None:
    """CSV with a header in key order.

    The rows are range partitioned, so a large table becomes several files that
    are in order by name; a small one is a single file. Nothing is collected.
    """
    frame.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def require_columns(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame, or an error if its columns are not exactly these in this order."""
    if list(frame.columns) != list(columns):
        raise ValueError(f"columns {frame.columns} do not match {list(columns)}")
    return frame


def require_rows(frame: DataFrame, name: str) -> DataFrame:
    if frame.isEmpty():
        raise ValueError(f"{name} is empty")
    return frame


def gated_write(problems: Sequence[str], writes: Mapping[str, Callable[[], None]]) -> bool:
    """Run all writes, or none of them when there are problems."""
    if problems:
        return False
    for write in writes.values():
        write()
    return True


def append_results(results: DataFrame, path: str, run: int) -> None:
    """Add the results of one screening run; earlier runs stay as they are."""
    results.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def latest_results(stored: DataFrame) -> DataFrame:
    """Last result of every station over all runs."""
    columns = [c for c in stored.columns if c not in ("station_id", "run")]
    return (
        stored.groupBy("station_id")
        .agg(F.max_by(F.struct(*columns), "run").alias("last"))
        .select("station_id", "last.*")
    )
