"""Tables that become visible together, and only if what was measured while writing them holds.

Every table is written to a staging folder once. Its checks are aggregates that Spark
observes in that very pass, so nothing is read a second time. When all tables are
written and every rule holds, the staging folders take their places by renaming;
otherwise they are deleted and the former tables stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stationwise.sinks.files import Files

#: Residues of the fingerprint; two of them make a chance match of different tables one in 2^60.
RESIDUES = ((1 << 30) - 35, (1 << 30) - 41)


def violations(**rules: Column) -> dict[str, Column]:
    """Per rule, the rows that break it; a rule that is NULL is broken."""
    return {name: F.count_if(~F.coalesce(rule, F.lit(False))) for name, rule in rules.items()}


def fingerprint(keys: Sequence[str], amount: str | Column) -> dict[str, Column]:
    """Sums of the amounts, each times two numbers drawn from its key.

    Rows of one key may be split in any way: tables whose amounts per key add up
    to the same have the same sums, others have not (but for chance). So two tables
    are reconciled key by key without a join.
    """
    value = (F.col(amount) if isinstance(amount, str) else amount).cast("decimal(20,0)")
    return {
        f"fingerprint_{k}": F.sum(value * F.pmod(F.xxhash64(F.lit(k), *keys), F.lit(m)).cast("decimal(18,0)"))
        for k, m in enumerate(RESIDUES)
    }


@dataclass(frozen=True)
class Gated:
    """A table to write: ``measures`` must be 0 where they are named in ``zero``."""

    frame: DataFrame
    measures: Mapping[str, Column] = field(default_factory=dict)
    zero: Sequence[str] = ()
    partition_by: Sequence[str] = ()
    may_be_empty: bool = False


Across = Callable[[Mapping[str, Mapping]], Sequence[str]]


def write_together(
    spark: SparkSession, folder: str, tables: Mapping[str, Gated], across: Across = lambda measured: ()
) -> tuple[dict[str, dict], list[str]]:
    """(what was measured per table, problems). With a problem nothing changes in the folder.

    ``across`` compares the measures of several tables and names its problems.
    """
    files, mark = Files(spark, folder), uuid.uuid4().hex
    staged = f"_staging_{mark}"
    measured: dict[str, dict] = {}
    try:
        for name, t in tables.items():
            seen = Observation()
            frame = t.frame.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(m) for m, c in t.measures.items()])
            frame.write.partitionBy(*t.partition_by).parquet(files.at(f"{staged}/{name}"))
            measured[name] = seen.get
        problems = [f"{name}: {m} = {measured[name][m]}" for name, t in tables.items() for m in t.zero if measured[name][m]]
        problems += [f"{name}: no rows" for name, t in tables.items() if not t.may_be_empty and not measured[name]["rows"]]
        problems += list(across(measured))
        if not problems:
            for name in tables:
                if files.exists(name):
                    files.rename(name, f"{staged}/_old_{name}")
                if not files.rename(f"{staged}/{name}", name):
                    raise OSError(f"{name} could not take its place")
        return measured, problems
    finally:
        files.delete(staged)
