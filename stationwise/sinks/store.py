"""A table that grows by whole runs, each made visible by one small commit file.

A run writes its rows to a folder of its own and then puts a commit file with the
next free number beside them. Readers list the commit files and read only the runs
named there, so a run that broke off is never seen, and two runs that end together
get two numbers. Compaction is a run too: it writes one row per key, and its commit
says which runs it replaces.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stationwise.sinks.files import Files

COMMITS, RUNS = "commits", "runs"


@dataclass(frozen=True)
class Commit:
    version: int
    run: str
    rows: int
    replaces: tuple[int, ...]


class RunStore:
    """Rows of a fixed schema under one path, keyed by ``key`` columns."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: Sequence[str]) -> None:
        self.spark, self.schema, self.key = spark, schema, list(key)
        self.files = Files(spark, path)

    def commits(self) -> list[Commit]:
        """All commits by version; drafts are not among them."""
        names = [n for n in self.files.names(COMMITS) if n.endswith(".json")]
        stored = [self.files.get(f"{COMMITS}/{n}") for n in names]
        return [Commit(c["version"], c["run"], c["rows"], tuple(c["replaces"])) for c in stored]

    def visible(self) -> list[Commit]:
        """Commits that no later one replaces."""
        found = self.commits()
        gone = {v for c in found for v in c.replaces}
        return [c for c in found if c.version not in gone]

    def write_run(self, frame: DataFrame) -> tuple[str, int]:
        """Store rows that nobody sees yet; gives the run's name and its rows, counted in the same pass."""
        if set(frame.columns) != set(self.schema.names):
            raise ValueError(f"columns {frame.columns} are not those of the store {self.schema.names}")
        run, counted = uuid.uuid4().hex, Observation()
        rows = frame.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        rows.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(self.files.at(f"{RUNS}/{run}"))
        return run, counted.get["rows"]

    def commit(self, run: str, rows: int, replaces: Sequence[int] = ()) -> int:
        """Make a run visible under the next free version."""
        version = max([c.version for c in self.commits()], default=0)
        while True:
            version += 1
            content = {"version": version, "run": run, "rows": rows, "replaces": list(replaces)}
            if self.files.put_new(f"{COMMITS}/{version:010d}.json", content):
                return version

    def append(self, frame: DataFrame) -> int:
        return self.commit(*self.write_run(frame))

    def read(self) -> DataFrame:
        """All visible rows with the ``version`` that brought them."""
        typed = StructType(self.schema.fields)
        result = self.spark.createDataFrame([], typed).withColumn("version", F.lit(0).cast("long"))
        for c in self.visible():
            run = self.spark.read.schema(typed).parquet(self.files.at(f"{RUNS}/{c.run}"))
            result = result.unionByName(run.withColumn("version", F.lit(c.version).cast("long")))
        return result

    def latest(self) -> DataFrame:
        """The row of the last version for every key."""
        rest = [c for c in self.schema.names if c not in self.key]
        last = F.max_by(F.struct(*rest), "version").alias("last")
        return self.read().groupBy(*self.key).agg(last).select(*self.key, "last.*")

    def compact(self) -> int | None:
        """Rewrite the visible runs as one row per key; None where there is at most one run.

        Runs that end meanwhile are not replaced and win by their version only if
        it is later: the compacted rows carry the version of the compaction, so it
        is refused when another run was committed while it worked.
        """
        before = self.visible()
        if len(before) < 2:
            return None
        run, rows = self.write_run(self.latest())
        version = max(c.version for c in self.commits()) + 1
        content = {"version": version, "run": run, "rows": rows, "replaces": [c.version for c in before]}
        unchanged = self.visible() == before
        if unchanged and self.files.put_new(f"{COMMITS}/{version:010d}.json", content):
            return version
        self.files.delete(f"{RUNS}/{run}")
        return None

    def vacuum(self) -> int:
        """Delete the rows of runs that a compaction replaced; gives their number. Runs without a commit may still be written, so they stay."""
        gone = {v for c in self.commits() for v in c.replaces}
        old = [c for c in self.commits() if c.version in gone and self.files.exists(f"{RUNS}/{c.run}")]
        for c in old:
            self.files.delete(f"{RUNS}/{c.run}")
        return len(old)
