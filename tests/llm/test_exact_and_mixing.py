"""Exact dedup and source mixing against brute-force versions on small, awkward tables."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stationwise.llm.common import with_row_key, word_count
from stationwise.llm.exact_dedup import exact_groups
from stationwise.llm.mixing import LEVELS, MixConfig, border_cells, fill_level, mixed, with_places

ROWS = [
    (4, "one  two", "b"),
    (2, "one two", "b"),
    (2, "one two", "b"),
    (9, None, None),
    (7, "", "a"),
    (5, "\t", "a"),
    (None, "one\ttwo", "c"),
    (None, "alone", "c"),
    (11, "x " * 30_000, "a"),
    (12, "One two", "c"),
    (13, "one two", None),
]
SCHEMA = "doc_id long, text string, source string"


def documents(spark, rows=ROWS):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5, "text", "doc_id")
    return frame.withColumns({"run": F.lit("x"), "digest": F.lit(1), "size": F.lit(-1), "row_key": F.lit("k")})


def test_equal_texts_keep_their_smallest_row(spark):
    found = exact_groups(documents(spark)).collect()
    groups = defaultdict(list)
    for doc_id, text, _ in ROWS:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    expected = []
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        keep = min((i for i in ids if i is not None), default=None)
        expected += [(i, keep, len(ids), digest) for i in ids]
    assert sorted(((r.id, r.keep_id, r.group_size, r.digest.hex()) for r in found), key=str) == sorted(expected, key=str)
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.id == r.keep_id for r in found if r.kept)


def test_exact_groups_of_many_runs_and_of_none(spark):
    frame = spark.range(0, 4000, 1, 40).select((3999 - F.col("id")).alias("doc_id"), (F.col("id") % 7).cast("string").alias("text"))
    found = exact_groups(frame).groupBy("digest").agg(F.first("keep_id").alias("k"), F.count_if("kept").alias("n")).collect()
    assert sorted(r.k for r in found) == sorted(min(3999 - i for i in range(4000) if i % 7 == m) for m in range(7))
    assert [r.n for r in found] == [1] * 7
    assert exact_groups(frame.limit(0)).count() == 0


def water_fill(sizes, weights, most):
    total, level_of = sum(sizes.values()), {}
    open_ = set(sizes)
    left = float(total)
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level >= most * sizes[s]}
        if not over:
            level_of.update({s: weights[s] * level for s in open_})
            break
        for s in over:
            level_of[s] = most * sizes[s]
            left -= most * sizes[s]
        open_ -= over
    return level_of


@pytest.mark.parametrize("most", [3.0, 1.4])
def test_mix_meets_capped_targets(spark, most):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 9 if i % 3 else 0}") for i in range(900)] + ROWS + [(1000, "tiny", "zz")]
    keyed, key = with_row_key(documents(spark, rows).drop("size").withColumn("size", word_count(F.col("text"))))
    config = MixConfig(max_epochs=most)
    ordered = keyed.withColumn("order_by", F.col("doc_id"))
    found = ordered.select(key, "source").join(mixed(ordered, key, config).withColumnRenamed("key", key), key).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: config.weights[i % 3] for i, s in enumerate(order)}
    targets = water_fill(sizes, weights, most)
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        words = r.whole * r["size"] + r.extra_words
        assert 0 <= words <= math.ceil(most) * r["size"]
        taken[r.source] += words
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    again = mixed(ordered, key, config).collect()
    assert sorted((r.key, r.whole, r.extra_words) for r in again) == sorted((r[key], r.whole, r.extra_words) for r in found)


@pytest.mark.parametrize("same", [None, 7])
def test_mix_of_rows_with_one_identifier(spark, same):
    """Rows without an identifier, or with one that repeats, do not meet in one cell, and their source gets its words."""
    size = (1 + F.col("id") % 9).cast("long").alias("size")
    source = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source")
    rows = spark.range(12_000).select(F.col("id").alias("key"), source, size, F.lit(same).cast("long").alias("order_by"))
    found = mixed(rows, "key")
    totals = found.groupBy("target").agg(F.sum(F.col("whole") * F.col("size") + F.col("extra_words")).alias("n")).collect()
    assert len(totals) == 3 and all(abs(r.n - r.target) <= 1 for r in totals)
    assert sorted(found.collect()) == sorted(mixed(rows.repartition(5), "key").collect())
    sized = with_places(rows, "key", MixConfig())
    wanted = sized.groupBy("no_source", "source").agg((F.sum("size") / 2).cast("long").alias("extra"))
    cells = border_cells(sized, wanted, ["no_source", "source"])
    assert cells.count() == 3
    assert sized.join(cells, ["no_source", "source", *LEVELS], "left_semi").count() <= 12


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "key long, source string, size long, order_by long")
    assert mixed(empty, "key").count() == 0
    assert fill_level(spark.createDataFrame([], "source_size long, weight double, cap double")) == 0.0
