"""Operator 11 against a plain search for windows of words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stationwise.llm.decontamination import (
    DecontaminationConfig,
    Windows,
    decontaminated,
    op11_decontamination,
    plain_words,
    with_contamination,
)

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_report(texts, items, window=10):
    """(words, hit words, ids) of every text, window by window."""
    owners = {}
    for name, text in items:
        found = words(text)
        size = min(window, len(found))
        for k in range(len(found) - size + 1 if found else 0):
            owners.setdefault(tuple(found[k : k + size]), set()).add(name)
    report = []
    for text in texts:
        found, hit, own = words(text), set(), set()
        for size in {len(k) for k in owners}:
            for k in range(len(found) - size + 1):
                if names := owners.get(tuple(found[k : k + size])):
                    hit |= set(range(k, k + size))
                    own |= names
        report.append((len(found), len(hit), sorted(n for n in own if n is not None)))
    return report


def mixture(seed):
    draw = random.Random(seed)
    vocabulary = ["a", "b", "Ab", "É", "x1", "longword", "ünïcode", "日本", "z" * draw.randint(1, 80)]

    def text(n):
        return draw.choice([" ", ", ", "\x00", "\n"]).join(draw.choice(vocabulary) for _ in range(n))

    items = [(draw.choice([None, "1", "2", "10"]), text(draw.choice([0, 1, 2, 3, 9, 10, 11, 14]))) for _ in range(6)]
    texts = [None, "", " - "]
    for _ in range(8):
        inner = f" {draw.choice(items)[1]} " if draw.random() < 0.7 else " "
        texts.append(text(draw.randint(0, 60)) + inner + text(draw.randint(0, 9)))
    return texts, items


@pytest.mark.parametrize("seed", range(60))
def test_search_equals_the_plain_one(seed):
    texts, items = mixture(seed)
    config = DecontaminationConfig(lane_bytes=37, candidates_at_once=11)
    found = Windows([(name, plain_words(text)) for name, text in items], config).search(texts)
    assert [(n, sum(e - b for b, e in zip(begins, ends)), ids) for n, begins, ends, ids in found] == plain_report(texts, items)


def report(frame):
    return [
        (r.doc_id, r.found.n_words, sum(e - b for b, e in zip(r.found.hit_begins, r.found.hit_ends)), list(r.found["items"]))
        for r in frame.collect()
    ]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_blocks_and_pieces_change_nothing(spark, block_bytes):
    texts, items = mixture(99)
    long_item = " ".join(f"w{k % 17}x{k % 5}" for k in range(90))
    items += [("7", long_item), ("7", long_item), (None, "only one"), ("8", None)]
    texts += [long_item * 30, "and " + long_item[20:90] + " or", "only one", "x" * 200_000 + " only one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.withColumn("items", F.lit(1)).withColumn("row_key", F.lit(2)).withColumn("found_", F.lit(3))
    benchmark = spark.createDataFrame(items, "item_id string, text string").withColumn("name", F.lit("clash"))
    config = DecontaminationConfig(block_bytes=block_bytes, piece_words=13)
    found = with_contamination(docs, benchmark, config=config)
    assert found.columns == [*docs.columns, "found"]
    expected = plain_report(texts, items)
    assert sorted(report(found)) == [(k, *row) for k, row in enumerate(expected)]


def test_a_passage_in_every_third_document(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    docs = spark.range(3_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, f"x {passage} y").otherwise("clean words").alias("text")
    )
    benchmark = spark.range(900).select(F.col("id").alias("item_id"), F.lit(passage).alias("text"))
    rows = with_contamination(docs, benchmark).groupBy("found.n_words", F.size("found.items").alias("n")).count().collect()
    assert sorted((r.n_words, r.n, r["count"]) for r in rows) == [(2, 0, 2_000), (27, 900, 1_000)]
    assert decontaminated(docs, benchmark).count() == 2_000


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert sorted(report(with_contamination(docs, benchmark.limit(0))), key=str) == [(1, 2, 0, []), (None, 0, 0, [])]
    assert with_contamination(docs.limit(0), benchmark).count() == 0


def test_query_has_the_columns_of_its_contract(spark):
    frame = op11_decontamination(spark, "/root/testdata/sf0.001")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert [c for c, _ in frame.dtypes] == names and frame.where("contaminated").count() > 0
