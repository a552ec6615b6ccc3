"""Ranks over groups of any size, without sorting a group in one task.

The distinct values of a group are cut into buckets by approximate quantiles
(a mergeable sketch), counted, and ranked inside their bucket; a prefix over the
few bucket totals completes the rank. The cuts only balance the work: the ranks
are exact for any cuts. The counted values are written once, so a plan with
several ranks does not repeat the work before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationwise.session import cut_lineage, join_groups

#: Distinct values that a bucket, which one task sorts, holds on average.
BUCKET_VALUES = 100_000
FEWEST_BUCKETS, MOST_BUCKETS = 8, 4096


def value_ranks(frame: DataFrame, group: str, value: str, buckets: int | None = None) -> DataFrame:
    """Per distinct (group, value): rows below, equal and above, and the group size.

    The number of buckets follows the counted distinct values unless it is given.
    """
    counts = cut_lineage(
        frame.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("equal"))
    )
    buckets = buckets or min(MOST_BUCKETS, max(FEWEST_BUCKETS, counts.count() // BUCKET_VALUES))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = counts.groupBy(group).agg(F.percentile_approx(value, shares, 1000).alias("cuts"))
    bucketed = join_groups(counts, cuts, group).withColumn(
        "bucket", F.size(F.filter("cuts", lambda cut: cut < F.col(value)))
    )
    by_bucket = Window.partitionBy(group).orderBy("bucket")
    totals = (
        bucketed.groupBy(group, "bucket")
        .agg(F.sum("equal").alias("in_bucket"))
        .withColumn("through", F.sum("in_bucket").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)))
        .select(
            group,
            "bucket",
            (F.col("through") - F.col("in_bucket")).alias("before"),
            F.sum("in_bucket").over(Window.partitionBy(group)).alias("size"),
        )
    )
    inside = Window.partitionBy(group, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    below = F.col("before") + F.sum("equal").over(inside) - F.col("equal")
    return bucketed.drop("cuts").join(totals, [group, "bucket"]).select(
        group,
        value,
        below.alias("below"),
        "equal",
        "size",
    ).withColumn("above", F.col("size") - F.col("below") - F.col("equal"))


def with_percentile_rank(frame: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Average-tie rank scaled to 0..1 within the group; a single row gets 0.5."""
    ranks = value_ranks(frame, group, value)
    average_rank = F.col("below") + (F.col("equal") + 1) / 2
    scaled = F.when(F.col("size") == 1, 0.5).otherwise((average_rank - 1) / (F.col("size") - 1))
    return frame.join(ranks.select(group, value, scaled.alias(name)), [group, value], "left")


def with_descending_rank(frame: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Minimum-tie rank, 1 for the largest value of the group."""
    ranks = value_ranks(frame, group, value)
    return frame.join(
        ranks.select(group, value, (F.col("above") + 1).cast("int").alias(name)), [group, value], "left"
    )
