"""Operator 7, packing by shortest-pack-first over the length histogram.

Documents are tokenised and cut into full sequences and one rest. Only the
histogram of the rests' lengths (at most ``capacity`` bins, whatever the data)
goes to the driver. There lengths are placed longest first; each goes to the
packs that are shortest so far and have room, whole groups of equal packs at a
time, so the state is a few thousand patterns with counts. A pattern's slots for
a length are ranges of ranks. Pieces get their rank among equal lengths from
counts per input partition, not from one sort per length, and look their slot up.
Pieces carry their ids; ``sequences`` lays those of a sequence end to end.

Tokenising keeps a bounded dictionary from space-separated chunks to ids, whose
most used part a worker takes along to its next task: where
no other white space is near, the tokeniser splits before every space, so a
chunk's ids do not depend on its neighbours. All other texts go to it whole, also
those that spell an added token, such as the end of a text.

Cases: null and empty texts have one token, the end; a document that fills its
sequences exactly has no rest; rows that repeat are packed as often as they come;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationwise.llm.common import bounded_batches, give_back, table, with_small, written


@dataclass(frozen=True)
class PackingConfig:
    """``vocabulary`` is the tokeniser's file; ``end_id`` follows every document."""

    vocabulary: str
    capacity: int = 2048
    end_id: int = 1
    cached_chunks: int = 600_000
    kept_chunks: int = 200_000
    group_chars: int = 1_500_000


def default_config() -> PackingConfig:
    import public_tokenizers

    return PackingConfig(vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


# White space other than space and line feed, and the places where a space has white space on both sides.
OTHER_BLANK = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
INNER_SPACE = ("   ", "\n  ", "  \n", "\n \n")


def splits_at_spaces(text: str) -> bool:
    """True where the tokeniser treats every space as the start of a piece of its own."""
    return not (OTHER_BLANK.search(text) or any(x in text for x in INNER_SPACE) or text[-2:] in ("  ", "\n "))


#: Letters of some scripts, digits, and marks but the apostrophe: the byte-level rule cuts a chunk of these, and of single line
#: feeds, into line feeds and runs of one kind, the first run with the space before it.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u04ff"
MARKS = r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(f" ?[{LETTERS}0-9{MARKS}]+(?:\n[{LETTERS}0-9{MARKS}]+)*\n?")
PIECES = re.compile(f" ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+|\n")

#: The pre-tokeniser whose rule that is.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_letters() -> dict[int, str]:
    """The character with which a byte-level vocabulary spells a byte: a printing one itself, others from U+0100 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printing else chr(next(others)) for b in range(256)}


#: So many chunks are tokenised end to end.
JOINED = 4096


class ChunkIds(dict):
    """Chunk -> place of its ids. A key without a space stands for a space and the key; else for the key without its first space."""

    def __init__(self, vocabulary: str, limit: int, kept: int = 0) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # Chunks laid end to end must not spell an added token either.
        self.spaced = any(" " in x for x in self.added)
        # A byte-level token is spelt with one character per byte.
        names = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(names.values()) + 1, dtype=np.int64)
        for name, number in names.items():
            self.token_bytes[number] = len(name)
        # Whether plain chunks may be cut into pieces here: by the rule of this pre-tokeniser, without dropout.
        form = json.loads(vocabulary)
        rule, model = form["pre_tokenizer"] or {}, form["model"]
        self.cuts = BYTE_LEVEL.items() <= rule.items() and not form["normalizer"] and model["type"] == "BPE" and not model["dropout"]
        self.letters = byte_letters()
        self.limit, self.kept = limit, kept
        self.new: list[str] = []
        self.ids = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int64)
        self.resting: pa.LargeStringArray | None = None

    def shrink(self) -> None:
        """Forget all chunks but the ``kept`` most used, and those of them used once; older uses count half."""
        most = np.argsort(-self.uses, kind="stable")[: self.kept]
        most = most[self.uses[most] > 1]
        # Places are in the order in which chunks were met, as are the keys; now the most used come first.
        keys = list(self)
        self.clear()
        self.update(zip([keys[i] for i in most], range(len(most))))
        counts = self.counts[most]
        starts = np.cumsum(counts) - counts
        self.ids = self.ids[np.repeat(self.starts[most] - starts, counts) + np.arange(counts.sum())]
        self.starts, self.counts, self.uses = starts, counts, self.uses[most] // 2

    def rest(self) -> None:
        """Shrink and lay the chunks end to end until the next text comes.

        As single strings, strewn over the memory of all those forgotten, they would keep that from being given back.
        """
        if self.resting is None:
            self.shrink()
            self.resting = pa.array(self, pa.large_string())
            self.clear()

    def wake(self) -> None:
        if self.resting is not None:
            self.update(zip(self.resting.to_numpy(zero_copy_only=False), range(len(self.resting))))
            self.resting = None

    def __missing__(self, key: str) -> int:
        self[key] = place = len(self)
        self.new.append(key[1:] if key[:1] == " " else " " + key)
        return place

    def pieces(self) -> tuple[list[int], list[int], list[int]]:
        """Of the plain chunks among the new ones: their numbers, the counts of their ids, and these ids end to end.

        A piece that is a chunk learnt before is looked up; others go to the tokeniser's model by themselves.
        """
        letters, model, known = self.letters, self.tokenizer.model, len(self.counts)
        places, starts, ends, ids = [], self.starts, self.starts + self.counts, self.ids
        counts, found = [], []
        for n, chunk in enumerate(self.new):
            if not PLAIN.fullmatch(chunk):
                continue
            before = len(found)
            parts = PIECES.findall(chunk)
            for part in parts:
                # The chunk itself is in the dictionary too, but not known.
                place = self.get(part[1:] if part[0] == " " else " " + part, known) if len(parts) > 1 else known
                if place < known:
                    found.extend(ids[starts[place] : ends[place]].tolist())
                else:
                    spelt = part.replace(" ", "\u0120").replace("\n", "\u010a") if part.isascii() else part.encode().decode("latin-1").translate(letters)
                    found.extend([x.id for x in model.tokenize(spelt)])
            places.append(n)
            counts.append(len(found) - before)
        return places, counts, found

    def learn(self) -> None:
        """Tokenise the chunks met since the last call.

        Plain ones are cut into pieces here. Most others are tokenised end to end, as they split where they meet, and told
        apart by the tokens' bytes.
        """
        if not self.new:
            return
        plain, plain_counts, plain_ids = self.pieces() if self.cuts else ([], [], [])
        counts = np.zeros(len(self.new), dtype=np.int64)
        counts[plain] = plain_counts
        left = np.ones(len(self.new), dtype=bool)
        left[plain] = False
        apart = left & np.fromiter((self.spaced or x[:1] != " " or x[-1:].isspace() for x in self.new), bool, len(self.new))
        parts = [np.array(plain_ids, dtype=np.uint32)]
        # The places of chunks in the order of ``parts``.
        ending = np.flatnonzero(left & ~apart)
        order = np.concatenate((np.array(plain, dtype=np.int64), ending, np.flatnonzero(apart)))
        joined = [self.new[i] for i in ending]
        for i in range(0, len(joined), JOINED):
            some = joined[i : i + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.cumsum(np.fromiter((len(x.encode()) for x in some), np.int64, len(some)))
            upto = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends, side="right")
            counts[ending[i : i + len(some)]] = np.diff(upto, prepend=0)
            parts.append(ids)
        for i in np.flatnonzero(apart):
            ids = self.whole(self.new[i])
            counts[i] = len(ids)
            parts.append(ids)
        starts = np.zeros(len(counts), dtype=np.int64)
        starts[order] = len(self.ids) + np.cumsum(counts[order]) - counts[order]
        self.ids = np.concatenate((self.ids, *parts))
        self.starts = np.concatenate((self.starts, starts))
        self.counts = np.concatenate((self.counts, counts))
        self.new = []

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        self.wake()
        if len(self) > self.limit:
            self.shrink()
        split = [splits_at_spaces(text) and not any(x in text for x in self.added) for text in texts]
        chunks = pc.split_pattern(pa.array((x for x, s in zip(texts, split) if s), pa.large_string()), " ")
        ends = chunks.offsets.to_numpy().astype(np.int64)
        later = np.ones(ends[-1], dtype=bool)
        later[ends[:-1]] = False
        # Equal chunks of the texts are looked up once. Those that begin a text have no space before them.
        coded = chunks.values.filter(pa.array(later)).dictionary_encode()
        different = np.fromiter(map(self.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        places = np.zeros(len(later), dtype=np.int64)
        places[later] = different[coded.indices.to_numpy()]
        firsts = (" " + text.partition(" ")[0] for text, s in zip(texts, split) if s)
        places[~later] = np.fromiter(map(self.__getitem__, firsts), np.int64, len(ends) - 1)
        self.learn()
        self.uses = np.bincount(places, minlength=len(self)) + np.pad(self.uses, (0, len(self) - len(self.uses)))
        counts = self.counts[places]
        upto = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(self.starts[places] - upto[:-1], counts) + np.arange(upto[-1])]
        parts = iter(np.split(ids, upto[ends[1:-1]]))
        return [next(parts) if s else self.whole(text) for text, s in zip(texts, split)]

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text, by the tokeniser alone."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=1)
def worker_coder(vocabulary: str, limit: int, kept: int) -> ChunkIds:
    """The coder of this Python worker: its frequent chunks need not be learnt again in every task."""
    return ChunkIds(vocabulary, limit, kept)


def grouped(texts: Iterable[str], chars: int) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text) + 1
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def tokenised(docs: DataFrame, config: PackingConfig) -> DataFrame:
    """(row, doc_id, doc_tokens, pieces): every piece's ids (4 bytes each, lowest first) and its rank among those of its length.

    Ranks count the pieces of one written partition, in the order of rows.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(config.vocabulary).read_text(encoding="utf-8"))

    @F.pandas_udf("doc_tokens long, ids array<binary>, inside array<long>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = worker_coder(vocabulary.value, config.cached_chunks, config.kept_chunks)
        end = np.array([config.end_id], dtype=np.uint32)
        seen = np.zeros(config.capacity + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for group in grouped((x if isinstance(x, str) else "" for x in batch), config.group_chars):
                for ids in coder.many(group):
                    ids = np.concatenate((ids, end)).astype("<u4")
                    pieces = [ids[i : i + config.capacity] for i in range(0, len(ids), config.capacity)]
                    inside = []
                    for piece in pieces:
                        inside.append(int(seen[len(piece)]))
                        seen[len(piece)] += 1
                    rows.append((len(ids), [x.tobytes() for x in pieces], inside))
            yield pd.DataFrame(rows, columns=["doc_tokens", "ids", "inside"])
        coder.rest()
        give_back()

    found = docs.select("doc_id", counted("text").alias("found"))
    found = found.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "found.doc_tokens", F.arrays_zip("found.ids", "found.inside").alias("pieces")
    )
    return written(found, "tokenised", codec="zstd")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in the order placed) with the number of packs of each."""
    groups: dict[int, list[tuple[int, list[int]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(groups, default=0)
            if room < length:
                groups.setdefault(capacity - length, []).append((left, [length]))
                break
            count, pattern = groups[room].pop()
            if not groups[room]:
                del groups[room]
            if count > left:
                groups.setdefault(room, []).append((count - left, pattern))
            used = min(count, left)
            left -= used
            groups.setdefault(room - length, []).append((used, [*pattern, length]))
    return [(pattern, count) for room in sorted(groups) for count, pattern in groups[room]]


#: Ranks and lengths share one search key.
RANK_BITS = 44


def slots(patterns: list[tuple[list[int], int]]) -> pd.DataFrame:
    """(key, rank, sequence, offset): where the ranks of a length start in a pattern's slot, sorted by key."""
    rows, sequence, seen = [], 0, {}
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = seen.get(length, 0)
            rows.append(((length << RANK_BITS) + rank, rank, sequence, offset))
            seen[length] = rank + count
            offset += length
        sequence += count
    frame = pd.DataFrame(rows, columns=["key", "rank", "sequence", "offset"], dtype=np.int64)
    return frame.sort_values("key", ignore_index=True)


def ranked_pieces(documents: DataFrame, config: PackingConfig) -> tuple[DataFrame, dict[int, int]]:
    """Pieces with their rank among equal lengths, and the histogram of lengths."""
    start = F.col("piece") * config.capacity
    pieces = documents.select("row", "doc_id", "doc_tokens", F.posexplode("pieces").alias("piece", "found")).select(
        "doc_id",
        "doc_tokens",
        "found.ids",
        "found.inside",
        start.cast("long").alias("start"),
        F.least(F.lit(config.capacity), F.col("doc_tokens") - start).cast("long").alias("length"),
        # The part of a row number that names its written partition.
        F.shiftright("row", 33).alias("shard"),
    )
    counts = written(pieces.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")
    offsets = written(counts.select("length", "shard", before.alias("before")), "piece_offsets")
    numbered = with_small(pieces, offsets, ["length", "shard"])
    return numbered.withColumn("rank", F.col("before") + F.col("inside")), histogram


def packed(docs: DataFrame, config: PackingConfig) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    ``ids`` has the piece's token ids, 4 bytes each, lowest first.
    """
    pieces, histogram = ranked_pieces(tokenised(docs, config), config)
    full = histogram.pop(config.capacity, 0)
    found = [([config.capacity], full)] * (full > 0) + shortest_pack_first(histogram, config.capacity)
    places = docs.sparkSession.sparkContext.broadcast(slots(found))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        table = places.value
        lengths, ranks = lengths.to_numpy(), ranks.to_numpy()
        at = np.searchsorted(table["key"].to_numpy(), (lengths << RANK_BITS) + ranks, side="right") - 1
        sequence = table["sequence"].to_numpy()[at] + ranks - table["rank"].to_numpy()[at]
        return pd.DataFrame({"sequence_id": sequence, "offset": table["offset"].to_numpy()[at]})

    return pieces.withColumn("place", placed("length", "rank")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "place.sequence_id", "place.offset", "ids"
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences of the pieces, whose ids lie end to end."""
    found = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.reduce(found, F.lit(b""), lambda ids, piece: F.concat(ids, piece["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packed(table(spark, folder, "documents").select("doc_id", "text"), default_config())
    return pieces.drop("ids")
