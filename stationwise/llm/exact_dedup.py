"""Operator 4, exact dedup: a tree merge of sorted digest runs.

Every input partition writes one run: its rows' digests in order. Rounds then
merge runs: in round r the runs whose numbers agree above the lowest 4 r bits
meet, so each round merges up to 16 runs, and after log16(partitions) rounds one
run is left. A merge keeps, for every digest, the number of its rows and its
smallest identifier. Rows only merge when three independent figures agree
(SHA-256, a 64-bit hash and the byte length of the normalised text), at every
level. Copies shrink to one row per run before they first travel, so a group
with a third of all rows costs no more than any other.

The answers go back down by (run, digest), whose rows are bounded by an input
partition, so no task ever holds a whole group.

Cases: null text counts as empty; null identifiers come after all others; of
rows that repeat identifier and text one stays; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import BLANK, table, written

#: Bits of the run number that one round merges away.
FAN_IN_BITS = 4

KEY = ["digest", "check", "n_bytes"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def digest_runs(rows: DataFrame, identifier: str, text: str, carry: str | None) -> DataFrame:
    """One sorted run per input partition: (run, row, id, carried, digest, check, n_bytes)."""
    carried = F.col(carry) if carry else F.lit(None)
    plain = rows.select(F.col(identifier).alias("id"), carried.cast("long").alias("carried"), normalised(F.col(text)).alias("plain"))
    runs = plain.select(
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
        "id",
        "carried",
        F.unhex(F.sha2("plain", 256)).alias("digest"),
        F.xxhash64("plain").alias("check"),
        F.octet_length("plain").alias("n_bytes"),
    )
    return written(runs.sortWithinPartitions("digest"), "runs")


def merged(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lowest level (one row per run and digest) and the root (one row per digest)."""
    first = F.struct(F.col("id").isNull().alias("missing"), "id", "row")
    lowest = runs.groupBy("run", *KEY).agg(F.min(first).alias("keep"), F.count(F.lit(1)).alias("size"))
    last = runs.agg(F.max("run")).first()[0] or 0
    level = lowest
    while last > 0:
        last >>= FAN_IN_BITS
        level = level.groupBy(F.shiftright("run", FAN_IN_BITS).alias("run"), *KEY).agg(
            F.min("keep").alias("keep"), F.sum("size").alias("size")
        )
    return lowest.select("run", *KEY), level.drop("run")


def exact_groups(rows: DataFrame, identifier: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """One row per input row: (id, carried, keep_id, group_size, kept, digest binary); ``carry`` names a long to pass on."""
    runs = digest_runs(rows, identifier, text, carry)
    lowest, root = merged(runs)
    answers = lowest.join(root, KEY)
    return runs.join(answers, ["run", *KEY]).select(
        "id",
        "carried",
        F.col("keep.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "digest",
    )


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_groups(table(spark, folder, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP4_SQL = r"""
WITH plain AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents),
groups AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM plain JOIN groups USING (text_sha256)
"""
