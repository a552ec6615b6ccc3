"""Operator 3, mixing sources to target weights: capped water-filling.

Weights share the wanted total. Sources above ``max_epochs`` times their size are
clamped there and their excess is shared anew by weight, round after round, until
no source is above. The state of a round is one number, the level: words per unit
of weight. It only rises, so the rounds end; each is one aggregate over the table
of sources.

A source with rate target / size gives every document floor(rate) whole
repetitions. The rest of the target goes, in the order of a seeded hash, to one
more repetition each until it is used up; the document at the border gives a part
of its words. So every source meets its target to the word. The border is found
by a histogram per part of the hash, not by sorting a source in one task. Rows with
one repeated identifier share that hash and are ordered by the hash of a stored row number.

Cases: null text has size 0; null source is a source of its own, last in order;
sources without words get target 0; rows without an identifier are ordered by the
hash of their row number; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationwise.llm.common import table, with_row_key, with_small, word_count, written


@dataclass(frozen=True)
class MixConfig:
    """``weights`` go to the sources in order, repeating; ``digit_bits`` is the width of a histogram."""

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    max_epochs: float = 3.0
    seed: int = 20_260
    digit_bits: int = 10


def ordered_sources(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """(source, source_size, weight, cap): sources by code point, null last."""
    ordered = sizes.orderBy(F.col("source").asc_nulls_last())
    schema = T.StructType([*ordered.schema.fields, T.StructField("place", T.LongType())])
    placed = sizes.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)
    weights = F.array(*[F.lit(float(w)) for w in config.weights])
    weight = F.element_at(weights, (F.col("place") % len(config.weights) + 1).cast("int"))
    return placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * config.max_epochs).alias("cap"))


def fill_level(sources: DataFrame) -> float:
    """Words per unit of weight at which the clamped shares add up to all words."""
    level, clamped = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("cap")
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, F.col("cap"))).alias("capped"),
            F.sum(F.when(~full, F.col("weight"))).alias("free"),
            F.count(F.when(full, 1)).alias("clamped"),
        ).first()
        if row.clamped == clamped or not row.free:
            return level
        level, clamped = ((row.total or 0) - (row.capped or 0.0)) / row.free, row.clamped


def source_targets(sized: DataFrame, config: MixConfig) -> DataFrame:
    """(source, source_size, target, whole, extra): whole repetitions and the words still wanted."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(ordered_sources(sizes, config), "sources")
    target = F.least(F.col("weight") * fill_level(sources), F.col("cap"))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor(F.col("rate") + 1e-12)
    return (
        sources.select("source", "source_size", target.alias("target"))
        .withColumn("rate", rate)
        .withColumn("whole", whole)
        .withColumn("extra", F.greatest(F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"), F.lit(0)))
        .drop("rate")
    )


#: Parts of a row's place in the order of its source, most significant first: the seeded hash of ``order_by`` in three
#: parts, then the hash of the row key, which tells rows with one repeated ``order_by`` apart.
LEVELS = ("digit1", "digit2", "rest", "tie1", "tie2")


def with_places(rows: DataFrame, key: str, config: MixConfig) -> DataFrame:
    """(key, source, no_source, size, LEVELS): rows without ``order_by`` are placed by their key."""
    bits = config.digit_bits
    mask = (1 << bits) - 1
    lone = F.when(F.col("order_by").isNull(), F.col(key))
    order, tie = F.xxhash64(F.lit(config.seed), F.col("order_by"), lone), F.xxhash64(F.lit(config.seed), F.col(key))
    return rows.select(
        F.col(key).alias("key"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.col("source").isNull().alias("no_source"),
        "size",
        F.shiftrightunsigned(order, 64 - bits).alias("digit1"),
        F.shiftrightunsigned(order, 64 - 2 * bits).bitwiseAND(mask).alias("digit2"),
        order.bitwiseAND((1 << (64 - 2 * bits)) - 1).alias("rest"),
        F.shiftrightunsigned(tie, 64 - bits).alias("tie1"),
        F.shiftrightunsigned(tie, 64 - 2 * bits).bitwiseAND(mask).alias("tie2"),
    )


def border(cells: DataFrame, keys: list[str], digit: str) -> DataFrame:
    """The cell of each group of keys in which its extra words run out, and what is left for it."""
    order = Window.partitionBy(*keys).orderBy(digit)
    cells = cells.withColumn("upto", F.sum("words").over(order))
    crossing = (F.col("upto") - F.col("words") < F.col("extra")) & (F.col("extra") <= F.col("upto"))
    return cells.where(crossing).select(*keys, digit, (F.col("extra") - F.col("upto") + F.col("words")).alias("extra"))


def border_cells(sized: DataFrame, wanted: DataFrame, source: list[str]) -> DataFrame:
    """(source, LEVELS, extra): of each source the smallest cell in which its words run out, found level by level."""
    cells = wanted
    for i, level in enumerate(LEVELS):
        keys = [*source, *LEVELS[:i]]
        counted = with_small(sized, cells, keys).groupBy(*keys, "extra", level).agg(F.sum("size").alias("words"))
        cells = written(border(counted, keys, level), "border")
    return cells


def mixed(rows: DataFrame, key: str, config: MixConfig = MixConfig()) -> DataFrame:
    """(key, size, source_size, target, whole, extra_words): what the mix takes of every row.

    ``rows`` has a unique column ``key``, a source and a size, and is read several times.
    """
    sized = with_places(rows, key, config)
    named = F.when(~F.col("no_source"), F.col("source")).alias("source")
    targets = source_targets(sized.select(named, "size"), config)
    source = ["no_source", "source"]
    targets = written(targets.withColumn("no_source", F.col("source").isNull()).fillna("", ["source"]), "targets")
    cells = border_cells(sized, targets.select(*source, "extra"), source)
    renamed = {**{d: f"{d}_mark" for d in LEVELS}, "extra": "left_over"}
    marks = written(targets.join(cells.withColumnsRenamed(renamed), source, "left"), "marks")

    placed = with_small(sized, marks, source)
    here, mark = F.struct(*LEVELS), F.struct(*[F.col(f"{d}_mark").alias(d) for d in LEVELS])
    known = F.col("left_over").isNotNull()
    before, at = known & (here < mark), known & (here == mark)
    upto = F.sum("size").over(Window.partitionBy(*source).orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    taken = ["key", "size", "source_size", "target", "whole"]
    part = F.least(F.col("size"), F.greatest(F.col("left_over") - upto + F.col("size"), F.lit(0)))
    return placed.where(~at).select(*taken, F.when(before, F.col("size")).otherwise(0).cast("long").alias("extra_words")).union(
        placed.where(at).select(*taken, part.cast("long").alias("extra_words"))
    )


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.col("doc_id").alias("order_by")
    )
    rows, key = with_row_key(documents, "sized")
    mix = mixed(rows, key).withColumnRenamed("key", key)
    return rows.select("doc_id", key).join(mix, key).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("extra_words")).alias("taken"),
        F.col("whole").alias("whole_copies"),
        "extra_words",
    )
