"""Operator 8, language-model scoring with a sharded Elias-Fano n-gram trie.

The model is an interpolated bigram model with absolute discounting; its lower
order is a discounted unigram model that leaves mass for unknown words. Contexts
are dealt to shards by fingerprint. Work moves in blocks of about a million
tokens, not in rows per token:

1. documents are cut into blocks (a word list and the words' numbers);
2. every block sends each shard the distinct (context, successor) pairs of its
   contexts with their training counts, as packed fingerprints;
3. a shard merges them, a few blocks at a time, and counts how many pairs occur
   once and twice; the sums over all shards give the one discount of the corpus;
4. every block sends its distinct pairs again, and a shard answers them from the
   trie of its merged counts;
5. answers return to their blocks, where the scores of documents are added up.

A shard's size is bounded by choosing their number from the bytes of all texts.
A context's distinct successors have to fit a task, however often it occurs.

Cases: null text counts as empty, which is the end token alone; a null
identifier is never held out; without training documents the score is that of
uniform unknown words; rows repeat as they come; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import bounded_batches, held_out, table, written
from stationwise.llm.ngram_trie import SUCCESSOR_BITS, VALUES, Trie, pair_discount

#: Fingerprints of the start and the end of a document; words never have them.
START, END = 0, 1


@dataclass(frozen=True)
class ModelConfig:
    block_tokens: int = 1_000_000
    shard_tokens: int = 1_500_000


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def squeezed(values: np.ndarray) -> bytes:
    """Bytes of numbers, those of equal weight together, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def released(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


BLOCK = (
    "block long, doc_ids array<{id}>, held array<boolean>, sizes array<int>, words binary, numbers binary, "
    "train_tokens long, train_docs long"
)


def blocks_of(docs: DataFrame, config: ModelConfig) -> DataFrame:
    """Written blocks of documents (doc_id, text, held_out)."""
    schema = BLOCK.format(id=docs.schema["doc_id"].dataType.simpleString())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        made, known, parts, rows, tokens = 0, Numbers(), [], [], 0

        def block() -> pd.DataFrame:
            held = [r[1] for r in rows]
            sizes = [r[2] for r in rows]
            train = [s + 1 for s, h in zip(sizes, held) if not h]
            numbers = np.concatenate(parts).astype("<u4")
            words = zstandard.compress(b"\n".join(known), 1)
            row = [first + made, [r[0] for r in rows], held, sizes, words, squeezed(numbers), sum(train), len(train)]
            return pd.DataFrame([row], columns=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            for doc_id, text, held in zip(batch["doc_id"].astype(object), batch["text"], batch["held_out"]):
                words = text.encode().lower().split() if isinstance(text, str) else []
                parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                rows.append((None if pd.isna(doc_id) else doc_id, bool(held), len(words)))
                tokens += len(words) + 1
                if tokens >= config.block_tokens:
                    yield block()
                    made, known, parts, rows, tokens = made + 1, Numbers(), [], [], 0
        if rows:
            yield block()

    return written(docs.select("doc_id", "text", "held_out").mapInPandas(cut, schema), "blocks")


class Block:
    """The pairs of a block, in an order that both ways of the trip share."""

    def __init__(self, row, shards: int) -> None:
        words = zstandard.decompress(row.words).split(b"\n")
        words = [] if words == [b""] else words
        prints = np.fromiter((max(2, xxhash.xxh64_intdigest(w)) for w in words), np.uint64, len(words))
        self.prints = np.concatenate((prints, np.array([END, START], dtype=np.uint64)))
        self.end, self.start = len(words), len(words) + 1
        self.sizes = np.array(row.sizes, dtype=np.int64) + 1
        self.held = np.array(row.held, dtype=bool)
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        self.current = np.full(int(ends[-1]), self.end, dtype=np.int64)
        inside = np.ones(len(self.current), dtype=bool)
        inside[ends - 1] = False
        self.current[inside] = released(row.numbers, "<u4") if len(words) else []
        before = np.roll(self.current, 1)
        before[self.starts] = self.start
        span = len(self.prints)
        pairs, self.which = np.unique(before * span + self.current, return_inverse=True)
        train = np.repeat(~self.held, self.sizes)
        self.counts = np.bincount(self.which, train, len(pairs)).astype("<u4")
        contexts, self.owner, kinds = np.unique(pairs // span, return_inverse=True, return_counts=True)
        self.contexts, self.kinds = contexts, kinds.astype("<u4")
        self.successors = (self.prints[pairs % span] >> np.uint64(64 - SUCCESSOR_BITS)).astype("<u4")
        shard = (self.prints[contexts] % np.uint64(shards)).astype(np.int64)
        self.context_order = np.argsort(shard, kind="stable")
        self.pair_order = np.argsort(shard[self.owner], kind="stable")
        self.shards, self.context_counts = np.unique(shard, return_counts=True)
        self.pair_counts = np.bincount(shard[self.owner], minlength=shards)[self.shards]

    def letters(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """(shard, contexts, successors per context, successors, training counts)"""
        contexts, pairs = np.cumsum(self.context_counts), np.cumsum(self.pair_counts)
        for shard, c, nc, p, np_ in zip(self.shards, contexts, self.context_counts, pairs, self.pair_counts):
            own, ours = self.context_order[c - nc : c], self.pair_order[p - np_ : p]
            yield (
                int(shard),
                self.prints[self.contexts[own]].tobytes(),
                squeezed(self.kinds[own]),
                self.successors[ours].tobytes(),
                squeezed(self.counts[ours]),
            )

    def scores(self, answers: list, model: dict) -> pd.DataFrame:
        """Sums per document from the shards' answers, given in the order of shards."""
        codes = np.zeros(len(self.counts), dtype=np.uint8)
        codes[self.pair_order] = np.concatenate([released(a.codes, "u1") for a in answers])
        backoff = np.zeros(len(self.prints), dtype=np.uint8)
        totals = np.zeros(len(self.prints))
        own = self.contexts[self.context_order]
        backoff[own] = np.concatenate([released(a.backoffs, "u1") for a in answers])
        totals[own] = np.concatenate([released(a.totals, "<u8") for a in answers])
        totals[self.end], totals[self.start] = model["train_docs"], 0
        unigram = lower_order(totals, model)
        weight = np.where(backoff > 0, VALUES[backoff], 1.0)
        before = np.roll(self.current, 1)
        before[self.starts] = self.start
        chance = VALUES[codes][self.which] + weight[before] * unigram[self.current]
        counts = totals[self.current]
        return pd.DataFrame(
            {
                "n_tokens": self.sizes,
                "n_known": np.add.reduceat((counts > 0).astype(np.int64), self.starts),
                "counted": np.add.reduceat(np.log10(counts + 1), self.starts),
                "score": np.add.reduceat(np.log10(np.minimum(chance, 1.0)), self.starts),
            }
        )


def lower_order(counts: np.ndarray, model: dict) -> np.ndarray:
    """Discounted unigram chances; the discounts of all known words go to all words and the unknown one alike."""
    kinds, tokens, discount = model["kinds"], model["train_tokens"], model["discount"]
    if not tokens:
        return np.full(len(counts), 1.0)
    return (np.maximum(counts - discount, 0) + discount * kinds / (kinds + 1)) / tokens


class Merged:
    """Counts of (context, successor) pairs, merged whenever as many have come as there are."""

    LEAST = 500_000

    def __init__(self) -> None:
        self.contexts = np.zeros(0, dtype=np.uint64)
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, owners: np.ndarray, successors: np.ndarray, counts: np.ndarray) -> None:
        if len(owners):
            self.waiting.append((owners, successors, counts))
        self.size += len(owners)
        if self.size > max(self.LEAST, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        owners, successors, counts = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.size = [], 0
        known = np.union1d(self.contexts, owners)
        bits = np.uint64(SUCCESSOR_BITS)
        moved = np.searchsorted(known, self.contexts).astype(np.uint64)
        low = np.uint64((1 << SUCCESSOR_BITS) - 1)
        before = (moved[(self.keys >> bits).astype(np.int64)] << bits) | (self.keys & low)
        keys = np.concatenate((before, (np.searchsorted(known, owners).astype(np.uint64) << bits) | successors))
        counts = np.concatenate((self.counts, counts.astype(np.int64)))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.contexts, self.keys, self.counts = known, keys[first], np.add.reduceat(counts, first)


def owners_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A letter's contexts, the number of successors of each, and the successors."""
    contexts, kinds = np.frombuffer(row.contexts, np.uint64), released(row.kinds, "<u4").astype(np.int64)
    return contexts, kinds, np.frombuffer(row.successors, "<u4").astype(np.uint64)


LETTER = "shard int, contexts binary, kinds binary, successors binary, counts binary, block long"
MODEL = LETTER + ", words long, once long, twice long, pairs_once long, pairs_twice long"


def model_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Letters in the order of shards -> one row of merged counts per shard, with its counts of counts."""

    def row(shard: int, merged: Merged) -> pd.DataFrame:
        """Empty for a shard without training pairs."""
        merged.merge()
        if not len(merged.keys):
            return pd.DataFrame([], columns=[c.split()[0] for c in MODEL.split(", ")])
        owner = (merged.keys >> np.uint64(SUCCESSOR_BITS)).astype(np.int64)
        kinds = np.bincount(owner, minlength=len(merged.contexts)).astype("<u4")
        words = np.bincount(owner, merged.counts, len(merged.contexts))[merged.contexts != START]
        successors = (merged.keys & np.uint64((1 << SUCCESSOR_BITS) - 1)).astype("<u4")
        values = (shard, merged.contexts.tobytes(), squeezed(kinds), successors.tobytes(), squeezed(merged.counts.astype("<u8")), -1)
        sums = [len(words), *(int((x == n).sum()) for x in (words, merged.counts) for n in (1, 2))]
        return pd.DataFrame([[*values, *sums]], columns=[c.split()[0] for c in MODEL.split(", ")])

    shard, merged = None, Merged()
    for batch in batches:
        for letter in batch.itertuples():
            if shard is not None and letter.shard != shard:
                yield row(shard, merged)
                merged = Merged()
            shard = letter.shard
            contexts, kinds, successors = owners_of(letter)
            counts = released(letter.counts, "<u4")
            seen = counts > 0
            merged.add(np.repeat(contexts, kinds)[seen], successors[seen], counts[seen])
    if shard is not None:
        yield row(shard, merged)


ANSWER = "block long, shard int, codes binary, backoffs binary, totals binary"


def answers_of(discount: float):
    """Per shard its merged counts, then letters -> an answer per letter from the shard's trie."""

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, trie = None, None
        for batch in batches:
            for row in batch.itertuples():
                own, per, following = owners_of(row)
                if row.block < 0:
                    shard, trie = row.shard, None
                    trie = Trie.built(np.repeat(own, per), following, released(row.counts, "<u8"), discount)
                    continue
                if row.shard != shard:  # a shard without training pairs
                    shard, trie = row.shard, Trie.built(own[:0], following[:0], following[:0].astype(np.int64), discount)
                places = trie.find_contexts(own)
                known = places >= 0
                backoffs, totals = np.zeros(len(own), dtype=np.uint8), np.zeros(len(own), dtype="<u8")
                backoffs[known], totals[known] = trie.backoffs[places[known]], trie.totals[places[known]]
                codes = trie.find_successors(np.repeat(places, per), following)
                values = (row.block, row.shard, squeezed(codes), squeezed(backoffs), squeezed(totals))
                yield pd.DataFrame([values], columns=[c.split()[0] for c in ANSWER.split(", ")])

    return answered


SCORES = "doc_id {id}, held_out boolean, n_tokens long, n_known long, counted double, score double"


def scored(docs: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """One row per document (doc_id, text, held_out): token counts, base score and model score."""
    bounded_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, math.ceil(size / 6 / config.shard_tokens))
    blocks = blocks_of(docs, config)

    def sent(counted: bool):
        def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = ["shard", "contexts", "kinds", "successors", "counts"]
            for batch in batches:
                for row in batch.itertuples():
                    found = pd.DataFrame(Block(row, shards).letters(), columns=names).assign(block=row.block)
                    yield found if counted else found.assign(counts=b"")

        return blocks.select("block", "held", "sizes", "words", "numbers").mapInPandas(letters, LETTER)

    dealt = sent(True).repartition("shard").sortWithinPartitions("shard")
    model = written(dealt.mapInPandas(model_of, MODEL), "model")
    totals = blocks.agg(F.sum("train_tokens").alias("tokens"), F.sum("train_docs").alias("docs")).first()
    words = model.agg(*[F.sum(x).alias(x) for x in ("words", "once", "twice", "pairs_once", "pairs_twice")]).first()
    discount = pair_discount(words.pairs_once or 0, words.pairs_twice or 0)
    asked = model.select(*[c.split()[0] for c in LETTER.split(", ")]).unionByName(sent(False))
    dealt = asked.repartition("shard").sortWithinPartitions("shard", "block")
    answers = written(dealt.mapInPandas(answers_of(discount), ANSWER), "answers")

    once, twice = words.once or 0, words.twice or 0
    model = {
        "train_tokens": totals.tokens or 0,
        "train_docs": totals.docs or 0,
        "kinds": (words.words or 0) + (1 if totals.docs else 0),
        "discount": once / (once + 2 * twice) if once else 0.75,
    }

    def added(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        row = next(own.itertuples())
        found = Block(row, shards).scores(list(back.sort_values("shard").itertuples()), model)
        return found.assign(doc_id=pd.Series(list(row.doc_ids), dtype=object), held_out=row.held)[
            ["doc_id", "held_out", "n_tokens", "n_known", "counted", "score"]
        ]

    schema = SCORES.format(id=docs.schema["doc_id"].dataType.simpleString())
    sums = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(added, schema)
    base = F.col("counted") - F.col("n_tokens") * math.log10(max(1, model["train_tokens"] + model["kinds"] + 1))
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model["train_tokens"]).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return scored(docs.withColumn("held_out", held_out(F.col("doc_id"), 7, 2)))
