"""Operator 5, MinHash near-dedup with odd sketches.

A text's shingle set gives MinHash samples. Bands of samples name buckets, in
which documents with similar sets meet. All samples are also folded into a bitmap
of parities, the odd sketch; the population count of two sketches' exclusive-or
estimates how many samples differ, which holds well for high similarities. A pair
whose estimate is far too low is dropped; every other is verified on the full
sets. Texts with equal sets are one node from the start, so groups of copies cost
one row, and groups of near copies are linked without their pairs (see links.py).

Cases: null or wordless texts have an empty set, are linked with nothing and
kept; texts with fewer words than a shingle are one shingle; a null identifier
never names a component that has another; of rows that repeat identifier and
text all have the same component; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import bounded_batches, give_back, table, with_small, written
from stationwise.llm.links import NoBound, linked_components, shared_buckets


@dataclass(frozen=True)
class NearConfig:
    """Texts are linked from ``per_cent`` similarity of their sets of ``words``-word shingles on.

    At 80 per cent a pair shares none of the 24 bands of 4 samples with probability 3e-6, at 85 with 2e-8.
    Pairs estimated ``slack`` below the threshold (over six standard deviations) are not verified.
    """

    words: int = 5
    per_cent: int = 80
    bands: int = 24
    rows: int = 4
    sketch_words: int = 4
    slack: float = 0.35

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def sketch_bits(self) -> int:
        return 64 * self.sketch_words

    def most_bits(self) -> int:
        """Differing sketch bits up to which a pair is verified: each differing sample toggles two bits."""
        toggles = 2 * self.samples * (1 - max(0.0, self.per_cent / 100 - self.slack))
        return math.ceil(self.sketch_bits / 2 * (1 - math.exp(-2 * toggles / self.sketch_bits)))


#: Multipliers of the mixing steps and of the samples: odd numbers from a seeded generator.
MULTIPLIERS = np.random.default_rng(20_260).integers(1 << 62, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 4096


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * MULTIPLIERS[0]
    values = (values ^ (values >> np.uint64(29))) * MULTIPLIERS[1]
    return values ^ (values >> np.uint64(32))


#: Words whose hash a worker remembers.
KEPT_WORDS = 50_000


class WordHashes(dict):
    """Word -> 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in A-Z lower case."""
    found = text.encode().lower().split() if isinstance(text, str) else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(hashes) > KEPT_WORDS:
        hashes.clear()
    values = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(values))
    joined = np.zeros(len(values) - width + 1, dtype=np.uint64)
    for i in range(width):
        joined = mix(joined + values[i : i + len(joined)] * MULTIPLIERS[2] + MULTIPLIERS[8 + width])
    return np.unique(joined)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray, config: NearConfig) -> tuple[list[int], list[int]]:
    """Band keys and odd sketch of a set that isn't empty."""
    least = np.full(config.samples, np.iinfo(np.uint64).max, dtype=np.uint64)
    factors = MULTIPLIERS[64 : 64 + config.samples, None]
    for i in range(0, len(shingles), STEP):
        np.minimum(least, (shingles[None, i : i + STEP] * factors).min(axis=1), out=least)
    place = np.arange(config.samples, dtype=np.uint64)
    tagged = mix(least + place * MULTIPLIERS[3])
    bits = np.bincount((tagged % np.uint64(config.sketch_bits)).astype(np.int64), minlength=config.sketch_bits) & 1
    sketch = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)
    keys = np.zeros(config.bands, dtype=np.uint64)
    for column in tagged.reshape(config.bands, config.rows).T:
        keys = mix(keys + column)
    return keys.view(np.int64).tolist(), sketch.tolist()


SIGNATURE = "n_shingles long, digest binary, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame, config: NearConfig, carry: str | None) -> DataFrame:
    """One written row per document: (row, doc_id, carried, n_shingles, digest, bands, sketch); no digest for an empty set."""

    @F.pandas_udf(SIGNATURE)
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for text in batch:
                shingles = shingle_set(text, config.words, hashes)
                found = (set_digest(shingles), *signature(shingles, config)) if len(shingles) else (None, None, None)
                rows.append((len(shingles), *found))
            yield pd.DataFrame(rows, columns=["n_shingles", "digest", "bands", "sketch"])
            del batch, rows
        del hashes
        give_back()

    carried = (F.col(carry) if carry else F.lit(None)).cast("long").alias("carried")
    found = docs.select("doc_id", carried, signed("text").alias("found"))
    return written(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "carried", "found.*"), "signatures")


def distinct_sets(signed: DataFrame) -> DataFrame:
    """One written row per distinct set: (node, doc_id, digest, n_shingles, bands, sketch)."""
    same = ["n_shingles", "bands", "sketch"]
    sets = signed.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in same]
    )
    return written(sets, "sets")


def full_sets(docs: DataFrame, wanted: DataFrame, config: NearConfig) -> DataFrame:
    """(node, shingles binary) of the wanted nodes (node, doc_id, digest), from the texts of one of their documents each."""
    ids = written(wanted.select("doc_id").distinct(), "ids")
    small = ids.count() <= 100_000
    texts = docs.select("doc_id", "text")
    texts = texts.join(F.broadcast(ids) if small else ids, texts.doc_id.eqNullSafe(ids.doc_id), "left_semi")

    @F.pandas_udf("digest binary, shingles binary")
    def gathered(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(text, config.words, hashes) for text in batch]
            yield pd.DataFrame({"digest": [set_digest(s) for s in sets], "shingles": [s.tobytes() for s in sets]})
            del sets
        del hashes
        give_back()

    # Declared as changing, else the join's null check runs the function a second time, in workers of its own.
    found = texts.select(gathered.asNondeterministic()("text").alias("found")).select("found.*")
    named = with_small(found, wanted.select("node", "digest"), ["digest"])
    return written(named.select("node", "shingles").dropDuplicates(["node"]), "full_sets")


#: Words of the bitmap of a set difference.
DIFFERENCE_WORDS = 8


def difference_bits(shingles: np.ndarray) -> list[int]:
    """A bitmap of hashed shingles; different ones may share a bit."""
    places = (mix(shingles) % np.uint64(64 * DIFFERENCE_WORDS)).astype(np.int64)
    bits = np.zeros(64 * DIFFERENCE_WORDS, dtype=np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


class SetBounds(NoBound):
    """Rules out links by two bounds that never rule out a true one.

    A node's ``private`` shingles occur in no other open component, so a node of
    another component lacks them: the intersection is at most n - private, the
    union at least n + the other's private. Nodes whose bound stays below the
    threshold even against the least private node of the other components leave.

    Of two nodes whose sets differ from their bucket's centre in ``apart``
    shingles each, the sets differ in the sum of both less twice what the two
    differences share. Bitmaps of the differences bound what they share: the
    bits in common, and those shingles that collided in the bitmap.
    """

    columns = ("n", "private", "centre", "apart", "bits")

    def __init__(self, sizes: DataFrame, full: DataFrame, config: NearConfig) -> None:
        self.sizes, self.full, self.per_cent = sizes, full, config.per_cent

    def _reaches(self, n: Column, private: Column, others: Column) -> Column:
        return 100 * (n - private) >= self.per_cent * (n + others)

    def possible(self, left: str, right: str) -> Column:
        (n, private, centre, apart, bits), (n2, private2, centre2, apart2, bits2) = (
            [F.col(f"{side}.{c}") for c in self.columns] for side in (left, right)
        )
        common = sum(F.bit_count(bits[i].bitwiseAND(bits2[i])) for i in range(DIFFERENCE_WORDS))
        set_bits, set_bits2 = (sum(F.bit_count(x[i]) for i in range(DIFFERENCE_WORDS)) for x in (bits, bits2))
        shared = common + F.least(apart - set_bits, apart2 - set_bits2)
        near = (100 + self.per_cent) * (apart + apart2 - 2 * shared) <= (100 - self.per_cent) * (n + n2)
        by_centre = F.coalesce(~centre.eqNullSafe(centre2) | near, F.lit(True))
        return self._reaches(n, private, private2) & self._reaches(n2, private2, private) & by_centre

    def measured(self, members: DataFrame, centres: DataFrame, found: DataFrame) -> DataFrame:
        if "centre" in members.columns:
            # The first centre is the one in the midst of the bucket, from which others differ least.
            return members
        known = with_small(members, centres.select("bucket", "centre"), ["bucket"])
        ends = {"a": F.least("node", "centre"), "b": F.greatest("node", "centre")}
        return with_small(known.withColumns(ends), found.select("a", "b", "apart", "bits"), ["a", "b"], "left").drop("a", "b")

    def narrowed(self, members: DataFrame) -> DataFrame:
        members = members.drop("n", "private")
        if "centre" not in members.columns:
            nothing = {"centre": F.lit(None).cast("long"), "apart": F.lit(None).cast("long")}
            members = members.withColumns(nothing | {"bits": F.lit(None).cast("array<long>")})
        nodes = written(members.select("node", "component").distinct(), "open_nodes")
        sets = with_small(self.full, nodes, ["node"])

        def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    shingles = np.frombuffer(row.shingles, np.int64)
                    yield pd.DataFrame({"node": row.node, "component": row.component, "shingle": shingles})
            give_back()

        shingles = written(sets.mapInPandas(listed, "node long, component long, shingle long"), "shingles")
        span = shingles.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        own = written(span.where("low = high").select("shingle"), "private")
        counts = with_small(shingles.select("node", "shingle"), own, ["shingle"]).groupBy("node").agg(
            F.count(F.lit(1)).alias("private")
        )
        sized = with_small(nodes.select("node"), self.sizes, ["node"]).join(counts, "node", "left").fillna(0, ["private"])
        rows = written(with_small(members, written(sized, "bounds"), ["node"]), "bounded")
        least = F.min(F.struct("private", "component")).alias("least")
        first = written(rows.groupBy("bucket").agg(least), "least")
        rows = with_small(rows, first, ["bucket"])
        foreign = rows.where(F.col("component") != F.col("least.component"))
        second = written(foreign.groupBy("bucket").agg(F.min("private").alias("second")), "second")
        rows = with_small(rows, second, ["bucket"])
        others = F.when(F.col("component") == F.col("least.component"), F.col("second")).otherwise(F.col("least.private"))
        return rows.where(self._reaches(F.col("n"), F.col("private"), others)).select(*members.columns, "n", "private")


class Verifier:
    """Checks candidate pairs: sizes, then the sketches' estimate, then the full sets."""

    def __init__(self, docs: DataFrame, sets: DataFrame, nodes: DataFrame, config: NearConfig) -> None:
        self.config = config
        self.slim = written(with_small(sets.select("node", "n_shingles", "sketch"), nodes, ["node"]), "sketches")
        self.full = full_sets(docs, with_small(sets.select("node", "doc_id", "digest"), nodes, ["node"]), config)
        self.bound = SetBounds(self.slim.select("node", F.col("n_shingles").alias("n")), self.full, config)

    def __call__(self, pairs: DataFrame) -> DataFrame:
        config = self.config

        @F.pandas_udf("linked boolean, apart long, bits array<long>")
        def compared(left: pd.Series, right: pd.Series) -> pd.DataFrame:
            rows = []
            for a, b in zip(left, right):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                apart = np.setxor1d(a, b, assume_unique=True)
                both = (len(a) + len(b) - len(apart)) // 2
                linked = 100 * both >= config.per_cent * (len(a) + len(b) - both)
                rows.append((linked, len(apart), difference_bits(apart)))
            return pd.DataFrame(rows, columns=["linked", "apart", "bits"])

        def side(frame: DataFrame, end: str) -> DataFrame:
            return frame.toDF(end, *[f"{c}_{end}" for c in frame.columns[1:]])

        pairs = written(pairs, "pairs")
        near = with_small(with_small(pairs, side(self.slim, "a"), ["a"]), side(self.slim, "b"), ["b"])
        smaller, larger = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
        differing = sum(
            F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(config.sketch_words)
        )
        near = near.where((100 * smaller >= config.per_cent * larger) & (differing <= config.most_bits()))
        near = written(near.select("a", "b"), "near")
        joined = near.join(side(self.full, "a"), "a").join(side(self.full, "b"), "b")
        return joined.select("a", "b", compared("shingles_a", "shingles_b").alias("found")).select("a", "b", "found.*")


def near_groups(docs: DataFrame, config: NearConfig = NearConfig(), carry: str | None = None) -> DataFrame:
    """One row per document: (row, doc_id, carried, n_shingles, component_id, component_row).

    ``component_row`` names the component also where identifiers are null or repeat; it is null for empty sets.
    """
    bounded_batches(docs.sparkSession)
    signed = signatures(docs, config, carry)
    sets = distinct_sets(signed)
    members = shared_buckets(sets.select("node", F.explode("bands").alias("bucket")))
    nodes = written(members.select("node").distinct(), "candidates")
    verify = Verifier(docs, sets, nodes, config)
    labels = linked_components(members, verify, verify.bound)
    own = sets.select("node", "digest", "doc_id")
    if labels is None:
        grouped = own.withColumn("component", F.col("node"))
    else:
        grouped = with_small(own, labels, ["node"], "left").withColumn("component", F.coalesce("component", "node"))
    grouped = written(grouped, "grouped")
    names = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = written(with_small(grouped, names, ["component"]).select("digest", "component", "component_id"), "named")
    slim = signed.select("row", "doc_id", "carried", "n_shingles", "digest")
    return slim.join(named, "digest", "left").select(
        "row",
        "doc_id",
        "carried",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("component").alias("component_row"),
    )


def later_rows(groups: DataFrame) -> DataFrame:
    """(carried) of all rows but the first of every component, by identifier (null last), then by carried number."""
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "carried")
    several = groups.where("component_row IS NOT NULL").select("component_row", order.alias("order"))
    firsts = several.groupBy("component_row").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = with_small(several, written(firsts.select("component_row", "first"), "firsts"), ["component_row"])
    return later.where(F.col("order.carried") != F.col("first.carried")).select(F.col("order.carried").alias("carried"))


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_groups(table(spark, folder, "documents"), NearConfig(words=3, per_cent=85))
    return groups.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


OP5_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[i:i + 2], ' ') for i in range(1, len(words) - 1)] END) AS shingle FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach AS (SELECT x AS doc_id, x AS other FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x),
named AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN named USING (doc_id)
"""
