"""Operator 11, benchmark decontamination: a Wu-Manber search for benchmark windows.

A text becomes its words in lower case with one space between, before and after
them, so a window of words is a plain string and its occurrences are substrings.
Windows are classed by length in powers of two, since the shortest one of a class
bounds every jump. For each class

- a *shift table* says, for the hash of the block of bytes under the cursor, how
  far the cursor may jump without passing an occurrence,
- where it says 0, the *bucket* of that suffix hash names windows, and those whose
  first bytes agree are compared directly, eight bytes at a time.

Many cursors run side by side over one stretch of texts, as NumPy columns. The
benchmark is read in blocks of a bounded size; one block, the usual case, is one
pass over the documents without any shuffle; each further one is a pass of its own
whose hits are stored, and hits of all passes are united per document.

Cases: null texts and texts without a word have no words and no hits; an item
without a word has no window; equal items count once per id; windows of items
whose id is null mark words, but no item is listed for them; an empty benchmark
hits nothing; words and texts of any length are searched whole; further columns
are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import bounded_batches, fresh_name, table, with_row_key, written

WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
#: Lower-cases A-Z and turns everything between words into spaces.
PLAIN = bytes(c if c in WORD_BYTES else 32 for c in (b + 32 if 65 <= b <= 90 else b for b in range(256)))
SPACE = 32
#: Bytes before the first text, so that eight bytes end at every position.
FRONT = 8
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

FOUND = "n_words long, hit_begins array<long>, hit_ends array<long>, items array<string>"


@dataclass(frozen=True)
class DecontaminationConfig:
    """``block_bytes``: bytes of item text searched for in one pass; ``piece_words``: windows that start in one piece of an item."""

    window: int = 10
    block_bytes: int = 2 << 20
    piece_words: int = 4_096
    lane_bytes: int = 2_048
    #: Only so many bytes of a window enter the shift table.
    most_shift: int = 256
    candidates_at_once: int = 1 << 18


def plain_words(text: str | None) -> bytes:
    """The words with a space before, between and after them; empty without words."""
    words = text.encode().translate(PLAIN).split() if isinstance(text, str) else []
    return b" " + b" ".join(words) + b" " if words else b""


def eights(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number; the buffer ends in eight more bytes."""
    return np.lib.stride_tricks.as_strided(buffer[:8].view(np.uint64), shape=(len(buffer) - 7,), strides=(1,), writeable=False)


class ShiftClass:
    """Shift table and suffix buckets of the windows of one length class."""

    def __init__(self, windows: "Windows", members: np.ndarray, config: DecontaminationConfig) -> None:
        length = windows.length[members]
        self.reach = int(min(length.min(), config.most_shift))
        # Text carries about three bits a byte: blocks long enough to be rarely in the table, short enough to jump.
        load = 2 * self.reach * len(members)
        self.block = int(max(min(3, self.reach), min(8, self.reach // 2, -(-int(load).bit_length() // 3))))
        self.bits = int(min(22, max(12, (2 * load).bit_length())))
        at = eights(windows.buffer)
        first = windows.start[members]
        self.shift = np.full(1 << self.bits, self.reach - self.block + 1, np.int32)
        for end in range(self.block, self.reach + 1):
            self.shift[self.hashed(at[first + end - 8])] = self.reach - end
        suffix = self.hashed(at[first + self.reach - 8])
        order = np.argsort(suffix, kind="stable")
        self.members = members[order]
        self.bucket = np.searchsorted(suffix[order], np.arange((1 << self.bits) + 1)).astype(np.int64)

    def hashed(self, last_eight: np.ndarray) -> np.ndarray:
        """The hash of the last ``block`` of eight bytes; the latest byte is the highest."""
        block = last_eight >> np.uint64(8 * (8 - self.block))
        return ((block * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, at: np.ndarray, size: int, lane_bytes: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose shift is 0, as (first byte of the window, hash)."""
        cursor = np.arange(FRONT + self.reach - 1, FRONT + size, lane_bytes, dtype=np.int64)
        end = np.minimum(cursor + lane_bytes, FRONT + size)
        places, hashes = [], []
        while len(cursor):
            value = self.hashed(at[cursor - 7])
            shift = self.shift[value]
            if not shift.all():
                zero = shift == 0
                places.append(cursor[zero])
                hashes.append(value[zero])
                shift = np.maximum(shift, 1)
            cursor = cursor + shift
            alive = cursor < end
            if not alive.all():
                cursor, end = cursor[alive], end[alive]
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(places) - self.reach + 1, np.concatenate(hashes)


class Windows:
    """The distinct windows of a block of benchmark items, ready to be searched for."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], config: DecontaminationConfig) -> None:
        self.config = config
        self.buffer = np.frombuffer(b" " * FRONT + b"".join(words for _, words in pieces) + b" " * 8, np.uint8)
        self.names = sorted({name for name, _ in pieces if name is not None})
        number = {name: k for k, name in enumerate(self.names)}
        known: dict[bytes, int] = {}
        starts, lengths, owners, offset = [], [], [], FRONT
        for name, words in pieces:
            spaces = [offset + k for k in np.flatnonzero(np.frombuffer(words, np.uint8) == SPACE).tolist()]
            size = min(config.window, len(spaces) - 1)
            for begin, end in zip(spaces, spaces[size:] if size else []):
                place = known.setdefault(words[begin - offset : end - offset + 1], len(known))
                if place == len(starts):
                    starts.append(begin)
                    lengths.append(end - begin + 1)
                if name is not None:
                    owners.append((place, number[name]))
            offset += len(words)
        self.start, self.length = np.array(starts, np.int64), np.array(lengths, np.int64)
        pairs = np.unique(np.array(owners, np.int64).reshape(-1, 2), axis=0)
        self.owner = pairs[:, 1]
        self.owned = np.searchsorted(pairs[:, 0], np.arange(len(starts) + 1))
        kinds = np.frexp(self.length.astype(float))[1]
        self.classes = [ShiftClass(self, np.flatnonzero(kinds == k), config) for k in np.unique(kinds)]

    def matches(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences in a text with eight bytes before and behind it, as (first byte, window)."""
        at, own = eights(text), eights(self.buffer)
        size = len(text) - FRONT - 8
        starts, found = [], []
        for kind in self.classes:
            place, value = kind.candidates(at, size, self.config.lane_bytes)
            low, count = kind.bucket[value], kind.bucket[value + 1] - kind.bucket[value]
            total = np.cumsum(count)
            done = 0
            while done < len(place):
                upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + self.config.candidates_at_once, "right")))
                many = count[done:upto]
                first = np.repeat(place[done:upto], many)
                within = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
                window = kind.members[np.repeat(low[done:upto], many) + within]
                same = self.same(at, own, first, window, FRONT + size)
                starts.append(first[same])
                found.append(window[same])
                done = upto
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(starts), np.concatenate(found)

    def same(self, at: np.ndarray, own: np.ndarray, first: np.ndarray, window: np.ndarray, end: int) -> np.ndarray:
        """Which candidates are occurrences: eight bytes at a time, the last eight end with the window."""
        length = self.length[window]
        left = np.flatnonzero(first + length <= end)
        good = np.zeros(len(first), bool)
        step = 0
        while len(left):
            rest = length[left] - 8 * step
            # The last bytes are compared together with those before them; a short window's first bytes are cut off.
            back = np.maximum(0, 8 - rest)
            cut = (8 * np.maximum(0, 8 - length[left])).astype(np.uint64)
            offset = 8 * step - back
            agree = (at[first[left] + offset] >> cut) == (own[self.start[window[left]] + offset] >> cut)
            left, rest = left[agree], rest[agree]
            good[left[rest <= 8]] = True
            left = left[rest > 8]
            step += 1
        return good

    def search(self, texts: list[str | None]) -> list[tuple[int, list[int], list[int], list[str]]]:
        """(words, begins and ends of the hit runs of words, ids of the items) of every text."""
        plain = [plain_words(x) for x in texts]
        result = [(x.count(b" ") - 1 if x else 0, [], [], []) for x in plain]
        buffer = np.frombuffer(b" " * FRONT + b"".join(plain) + b" " * 8, np.uint8)
        starts, window = self.matches(buffer)
        if not len(starts):
            return result
        bounds = FRONT + np.concatenate([[0], np.cumsum([len(x) for x in plain])])
        spaces = np.flatnonzero(buffer == SPACE)
        doc = np.searchsorted(bounds, starts, "right") - 1
        order = np.lexsort((starts, doc))
        doc, starts, window = doc[order], starts[order], window[order]
        zero = np.searchsorted(spaces, bounds[doc])
        begin = np.searchsorted(spaces, starts) - zero
        end = np.searchsorted(spaces, starts + self.length[window] - 1) - zero
        edges = np.flatnonzero(np.diff(doc, prepend=-1))
        for low, high in zip(edges, np.append(edges[1:], len(doc))):
            own = np.unique(window[low:high])
            owners = np.unique(np.concatenate([self.owner[self.owned[w] : self.owned[w + 1]] for w in own]))
            begins, ends = united(begin[low:high], end[low:high])
            k = doc[low]
            result[k] = (result[k][0], begins, ends, [self.names[x] for x in owners])
        return result


def united(begin: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """The union of runs [begin, end) as runs that neither meet nor overlap."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > reach[:-1])
    return begin[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)].tolist()


def item_pieces(benchmark: DataFrame, item: str, text: str, config: DecontaminationConfig) -> DataFrame:
    """The distinct (name, words) of the items; long items are cut where windows start."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, value in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                words = plain_words(value).split()
                for k in range(0, max(min(1, len(words)), len(words) - config.window + 1), config.piece_words):
                    rows.append((name, b" " + b" ".join(words[k : k + config.piece_words + config.window - 1]) + b" "))
            yield pd.DataFrame(rows, columns=["name", "words"])

    named = benchmark.select(F.col(item).cast("string"), F.col(text))
    return named.mapInPandas(cut, "name string, words binary").distinct()


def search_pass(docs: DataFrame, text: str, name: str, pieces: list, config: DecontaminationConfig) -> DataFrame:
    """One pass over the documents for one block of pieces."""
    windows = docs.sparkSession.sparkContext.broadcast(Windows([(p.name, bytes(p.words)) for p in pieces], config))

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(windows.value.search(list(batch)), columns=["n_words", "hit_begins", "hit_ends", "items"])

    return docs.withColumn(name, found(F.col(text)))


def united_runs(begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
    runs = [united(np.array(b), np.array(e)) if len(b) else ([], []) for b, e in zip(begins, ends)]
    return pd.DataFrame(runs, columns=["begins", "ends"])


def with_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    name: str = "found",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    config: DecontaminationConfig = DecontaminationConfig(),
) -> DataFrame:
    """The documents with a struct column of that name: words, runs of hit words (end exclusive) and the items' ids, sorted as strings."""
    bounded_batches(docs.sparkSession)
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    pieces = item_pieces(benchmark, item, item_text, config)
    n_blocks = -(-size // config.block_bytes)
    if n_blocks <= 1:
        return search_pass(docs, text, name, pieces.collect(), config)
    pieces = written(pieces.withColumn("block", F.pmod(F.xxhash64("name", "words"), F.lit(n_blocks))), "pieces")
    keyed, key = with_row_key(docs, "searched")
    column = fresh_name(keyed, "hits_of_block")
    parts = []
    for block in range(n_blocks):
        hits = search_pass(keyed, text, column, pieces.where(F.col("block") == block).collect(), config)
        hits = hits.where(F.size(f"{column}.hit_begins") > 0) if block else hits
        parts.append(written(hits.select(F.col(key), F.col(f"{column}.*")), "hits"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    lists = union.groupBy(key).agg(
        F.max("n_words").alias("n_words"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("hit_begins", "hit_ends", "items")],
    )
    runs = F.pandas_udf(united_runs, "begins array<long>, ends array<long>")("hit_begins", "hit_ends")
    whole = lists.select(
        key,
        F.struct(
            "n_words",
            runs["begins"].alias("hit_begins"),
            runs["ends"].alias("hit_ends"),
            F.array_sort(F.array_distinct("items")).alias("items"),
        ).alias(name),
    )
    return keyed.join(whole, key).drop(key)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """The documents, all columns, in which no benchmark window occurs."""
    name = fresh_name(docs, "contamination")
    return with_contamination(docs, benchmark, name, **names).where(F.size(f"{name}.hit_begins") == 0).drop(name)


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = with_contamination(docs, table(spark, folder, "benchmark"))
    lengths = F.zip_with("found.hit_begins", "found.hit_ends", lambda begin, end: end - begin)
    n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda total, x: total + x)
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        (F.size("found.hit_begins") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size,
    array_to_string(words[k : k + least(len(words), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, words, unnest(generate_series(1, greatest(1, len(words) - 9))) AS k FROM item WHERE len(words) > 0)),
doc_window AS (
  SELECT row_id, k, size, array_to_string(words[k : k + size - 1], ' ') AS phrase
  FROM (
    SELECT row_id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS k
    FROM doc CROSS JOIN (SELECT DISTINCT size FROM item_window) WHERE len(words) >= size)),
hit AS (
  SELECT row_id, k, d.size, item_id FROM doc_window d JOIN item_window i ON d.size = i.size AND d.phrase = i.phrase),
hit_words AS (
  SELECT row_id, count(DISTINCT word) AS n_hit
  FROM (SELECT row_id, unnest(generate_series(k, k + size - 1)) AS word FROM (SELECT DISTINCT row_id, k, size FROM hit))
  GROUP BY row_id),
hit_items AS (
  SELECT row_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS name FROM hit WHERE item_id IS NOT NULL) GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (row_id) LEFT JOIN hit_items USING (row_id)
"""
