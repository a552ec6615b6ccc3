"""Warm and cold phases of a monthly index (Table D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationwise.functions.scans import with_runs

THRESHOLD = 0.5
MIN_RUN = 5


def label_phases(
    monthly: DataFrame,
    value: str = "nino34_anomaly",
    threshold: float = THRESHOLD,
    min_run: int = MIN_RUN,
    blocks: int | None = None,
) -> DataFrame:
    """Add ``enso_phase`` and ``provisional`` to one row per (year, month).

    Runs follow the row order, so a missing month does not end one. They are found
    block by block along the series and stitched at the borders. A month without a
    value is neutral.
    """
    sign = F.when(F.col(value) >= threshold, 1).when(F.col(value) <= -threshold, -1).otherwise(0)
    runs = with_runs(monthly.withColumn("sign", sign), ["year", "month"], "sign", blocks)
    long_enough = F.col("run_rows") >= min_run
    phase = (
        F.when(long_enough & (F.col("sign") == 1), "El Nino")
        .when(long_enough & (F.col("sign") == -1), "La Nina")
        .otherwise("Neutral")
    )
    return (
        runs.withColumn("enso_phase", phase)
        .withColumn("provisional", (F.col("sign") != 0) & ~long_enough & F.col("is_last_run"))
        .drop("sign", "run", "run_rows", "is_last_run")
    )
