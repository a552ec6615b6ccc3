"""The training-data pipeline: language filter, exact and near dedup, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's documents. All stages but the last
return the columns of the documents they get.

Cases, for all stages: null texts count as empty and go with the language filter;
null identifiers are allowed; rows that repeat are told apart by their place in
the stage's files, or by a stored row number where the documents are no plain read
of Parquet; columns of any other name pass through; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import fresh_name, new_path, scratch, table, with_place_key, with_small, without_rows, word_count, written
from stationwise.llm.exact_dedup import exact_groups
from stationwise.llm.language_id import with_language
from stationwise.llm.mixing import mixed
from stationwise.llm.near_dedup import NearConfig, later_rows, near_groups
from stationwise.llm.packing import default_config, packed


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; without a letter or with a narrow margin they go."""
    name = fresh_name(docs, "language")
    found = with_language(docs, docs.select("doc_id", "text", "lang"), name)
    return found.where(~F.col(f"{name}.rejected")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the first stays."""
    keyed, key = with_place_key(docs)
    later = new_path(spark, "later")
    with scratch(spark):
        exact_groups(keyed, carry=key).where(~F.col("kept")).select("carried").write.parquet(later)
    return without_rows(keyed, key, spark.read.schema("carried long").parquet(later)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by 80 per cent of their 5-word shingles, the first stays."""
    keyed, key = with_place_key(docs)
    later = new_path(spark, "later")
    with scratch(spark):
        groups = written(near_groups(keyed, NearConfig(), carry=key), "groups")
        later_rows(groups).write.parquet(later)
    return without_rows(keyed, key, spark.read.schema("carried long").parquet(later)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole: the one at a source's border if at least half of it is taken."""
    keyed, key = with_place_key(docs)
    rows = keyed.select(key, "source", word_count(F.col("text")).alias("size"), F.col("doc_id").alias("order_by"))
    more = (2 * F.col("extra_words") >= F.col("size")) & (F.col("extra_words") > 0)
    copies = fresh_name(docs, "copies")
    path = new_path(spark, "taken")
    with scratch(spark):
        taken = mixed(written(rows, "sized"), key).select(
            F.col("key").alias(key), (F.col("whole") + more.cast("long")).cast("int").alias(copies)
        )
        taken.where(F.col(copies) > 0).write.parquet(path)
    repeated = with_small(keyed, spark.read.schema(taken.schema).parquet(path), [key])
    each = fresh_name(docs, "each")
    return repeated.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(each)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, with their ids."""
    return packed(docs.select("doc_id", "text"), default_config())


STAGES = [
    ("language_id", language_filter),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages' models cannot be written in SQL; the tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
