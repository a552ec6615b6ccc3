"""Positions and runs along one long order, without sorting it, or a crowded group, in one task.

The rows are range partitioned on their whole order and stored with the number of
their block. Every block is then worked on by itself; what it has to know of earlier
blocks is a summary of a row per block (and group), which is added up on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationwise.session import cut_lineage


def range_blocks(frame: DataFrame, order: Sequence[Column], blocks: int | None = None) -> DataFrame:
    """The frame, stored, with a column ``block``: blocks follow each other in the order."""
    count = blocks or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(frame.repartitionByRange(count, *order).withColumn("block", F.spark_partition_id()))


def with_position(
    frame: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, blocks: int | None = None
) -> DataFrame:
    """Row number from 1 within the group.

    A group may fill any number of blocks; the rows that it has in earlier blocks
    are a prefix sum over at most one row per block. The order has to be total,
    else equal rows get their numbers in any order, as with a window.
    """
    keys = [F.col(g) for g in group]
    blocked = range_blocks(frame, [*keys, *order], blocks)
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocked.groupBy("block", *group).agg(F.count(F.lit(1)).alias("rows"))
    offsets = counts.select("block", *group, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("block", *group).orderBy(*order))
    numbered = blocked.withColumn("local", local).join(offsets, ["block", *group])
    return numbered.withColumn(name, (F.col("local") + F.col("offset")).cast("int")).drop("block", "local", "offset")


def with_runs(frame: DataFrame, order: Sequence[str], state: str, blocks: int | None = None) -> DataFrame:
    """Add ``run`` (from 1), ``run_rows`` and ``is_last_run``: runs of equal states along the whole order.

    Every block finds its own runs. Its first and last ones may go on in its
    neighbours: one summary row per block is read by the driver, stitched, and
    handed back as a small table. The states must not be NULL.
    """
    blocked = range_blocks(frame, [F.col(c) for c in order], blocks)
    along = Window.partitionBy("block").orderBy(*order)
    fresh = F.when(F.col(state) == F.lag(state).over(along), 0).otherwise(1)
    marked = blocked.withColumn("fresh", fresh).withColumn(
        "local_run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    found = cut_lineage(marked.drop("fresh"))
    runs = found.groupBy("block", "local_run").agg(F.first(state).alias("state"), F.count(F.lit(1)).alias("local_rows"))
    ends = runs.groupBy("block").agg(
        F.max("local_run").alias("runs"),
        F.min_by(F.struct("state", "local_rows"), "local_run").alias("first"),
        F.max_by(F.struct("state", "local_rows"), "local_run").alias("last"),
    )
    borders, last_run = _stitched(sorted(ends.collect(), key=lambda r: r["block"]))
    if not borders:
        return found.drop("block", "local_run").withColumns(
            {"run": F.lit(0).cast("long"), "run_rows": F.lit(0).cast("long"), "is_last_run": F.lit(False)}
        )
    schema = "block int, offset long, runs long, first_rows long, last_rows long"
    stitched = F.broadcast(frame.sparkSession.createDataFrame(borders, schema))
    sizes = runs.select("block", "local_run", "local_rows")
    whole = (
        F.when(F.col("local_run") == 1, F.col("first_rows"))
        .when(F.col("local_run") == F.col("runs"), F.col("last_rows"))
        .otherwise(F.col("local_rows"))
    )
    run = F.col("local_run") + F.col("offset")
    return (
        found.join(sizes, ["block", "local_run"])
        .join(stitched, "block")
        .withColumns({"run": run, "run_rows": whole, "is_last_run": run == last_run})
        .drop("block", "local_run", "local_rows", "offset", "runs", "first_rows", "last_rows")
    )


def _stitched(ends: Sequence) -> tuple[list[tuple], int]:
    """(block, run offset, runs, rows of the whole first and last run) per block, and the number of the last run."""
    rows_of: dict[int, int] = {}
    placed, last_run, previous = [], 0, None
    for e in ends:
        goes_on = previous is not None and e["first"]["state"] == previous
        offset = last_run - 1 if goes_on else last_run
        last_run = offset + e["runs"]
        rows_of[offset + 1] = rows_of.get(offset + 1, 0) + e["first"]["local_rows"]
        if e["runs"] > 1:
            rows_of[last_run] = e["last"]["local_rows"]
        placed.append((e["block"], offset, e["runs"]))
        previous = e["last"]["state"]
    return [(b, o, n, rows_of[o + 1], rows_of[o + n]) for b, o, n in placed], last_run
