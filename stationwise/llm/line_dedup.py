"""Operator 9, near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Two lines within ``max_edits`` edits share, when one is cut into max_edits + 1
segments, at least one segment as a substring at a place that the edits left and
right of it allow. Every line is indexed by its own segments under (length,
segment number, text) and probes the indexes of its own and the next shorter
lengths with the few substrings that the multi-match rule leaves. Lines that meet
under a key are verified with the built-in edit distance, whose threshold makes
it a banded computation. Segments of lines under ``deep_below`` characters say
little, so what lies left and right of one, which have at most i and max_edits - i
edits for segment i, is cut again in the same way, and a key has three texts. Equal lines are one node, and the pairs of crowded keys
are not made (see links.py), so one very common line or segment does no harm.

Lines are compared with runs of white space as one space, without those at the
ends. Of every class of lines (all that links reach) the first in the order of
(doc_id, row, line number) stays, the others are dropped. Lines of any length are
compared (the theorem also holds for empty segments); only a caller's
``least_chars`` leaves shorter ones to exact comparison.

Cases: null texts have no line; lines without a word belong to no class and are
not counted; a null identifier comes last; rows that repeat come one after the
other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import BLANK, SLIM_ROWS, table, with_small, written
from stationwise.llm.links import NoBound, linked_components, shared_buckets


@dataclass(frozen=True)
class LineConfig:
    max_edits: int = 2
    least_chars: int = 1
    deep_below: int = 40


def plain_line(line: Column) -> Column:
    """The line with runs of white space as one space and none at the ends; most lines need no pattern for that."""
    several = F.lit(False)
    for sign in ("  ", "\t", "\x0b", "\x0c", "\r"):
        several = several | F.contains(line, F.lit(sign))
    return F.trim(F.when(several, F.regexp_replace(line, BLANK, " ")).otherwise(line))


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


def lines_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line_no, line): every line of numbered documents with a word; documents without one keep a null line."""
    split = docs.select("row", "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    return split.select("row", "doc_id", "line_no", F.nullif(plain_line(F.col("line")), F.lit("")).alias("line"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line_no, key, node, own, line): written, so lines are cut and cleaned once.

    The key is a digest of the line, null without a word; ``own`` is its length.
    """
    key, node = F.unhex(F.md5("line")).alias("key"), node_of(F.col("line")).alias("node")
    own = F.char_length("line").alias("own")
    return written(lines_of(docs).select("row", "doc_id", "line_no", key, node, own, "line"), "occurrences", codec="zstd")


def node_of(line: Column) -> Column:
    """A line's number in the edit join: 64 bits of hash. Classes are keyed by the whole digest."""
    return F.xxhash64(line)


def segments(length: Column, number: Column, count: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of a segment: segments differ by one character at most, the longer ones last."""
    base, longer = F.floor(length / count).cast("int"), (length % count).cast("int")
    shorter = count - longer
    start = 1 + number * base + F.greatest(F.lit(0), number - shorter)
    return start, base + (number >= shorter).cast("int")


def with_segments(frame: DataFrame, name: str, edits: Column, by: Column, length: Column) -> DataFrame:
    """Add a segment of an indexed text and its place in one that is ``by`` characters longer, as a struct of this name.

    One row per segment number and shift that the edits left and right of it allow: (i, start, size, shift).
    Rows are made step by step. One expression with all kinds of keys would be a method too large for the JVM's compiler.
    """
    number = F.col(f"{name}_i")
    numbered = frame.withColumn(f"{name}_i", F.explode(F.sequence(F.lit(0), edits)))
    start, size = segments(length, number, edits + 1)
    least, most = F.greatest(-number, by - (edits - number)), F.least(number, by + (edits - number))
    shifted = numbered.withColumns({f"{name}_start": start, f"{name}_size": size})
    shifted = shifted.withColumn(f"{name}_shift", F.explode(F.sequence(least, most)))
    parts = ("i", "start", "size", "shift")
    whole = F.struct(*[F.col(f"{name}_{p}").alias(p) for p in parts])
    return shifted.withColumn(name, whole).drop(*[f"{name}_{p}" for p in parts])


def keyed_lengths(lines: DataFrame, config: LineConfig) -> DataFrame:
    """The lines (node, own, wide) once per indexed length: their own and the next shorter ones.

    Texts are cut in a form of four bytes a character, where a place is found without counting from the start.
    """
    wide = lines.select("node", "own", F.encode("line", "UTF-32").alias("wide"))
    by = F.explode(F.sequence(F.lit(0), F.lit(config.max_edits))).alias("by")
    return wide.select("*", by).withColumn("length", F.col("own") - F.col("by")).where("length > 0")


def cut(at: Column, size: Column) -> Column:
    return F.col("wide").substr(4 * at - 3, 4 * size)


def flat_keys(lines: DataFrame, config: LineConfig) -> DataFrame:
    """(node, bucket) of (node, line, own), for indexed lengths from ``deep_below`` on: length, segment number, segment text."""
    keyed = keyed_lengths(lines, config).where(F.col("length") >= config.deep_below)
    keyed = with_segments(keyed, "main", F.lit(config.max_edits), F.col("by"), F.col("length"))
    at, size = F.col("main.start") + F.col("main.shift"), F.col("main.size")
    inside = keyed.where((at >= 1) & (at + size - 1 <= F.col("own")))
    return inside.select("node", F.xxhash64("length", "main.i", cut(at, size)).alias("bucket"))


def segment_keys(found: DataFrame, config: LineConfig) -> DataFrame:
    """(node, bucket): all index and probe keys of the lines of stored occurrences.

    Deep keys, of lengths under ``deep_below``, say also a segment on the left and one on the right.
    """
    lines = found.where(F.col("own") >= config.least_chars).select("node", "line", "own")
    short = lines.where(F.col("own") < config.deep_below + config.max_edits)
    return flat_keys(lines.where(F.col("own") >= config.deep_below), config).unionByName(deep_keys(short, config))


def deep_keys(lines: DataFrame, config: LineConfig) -> DataFrame:
    """(node, bucket) of (node, line, own), for indexed lengths under ``deep_below``; equal lines are one first."""
    edits = F.lit(config.max_edits)
    lines = lines.groupBy("node").agg(F.first("line").alias("line"), F.first("own").alias("own"))
    keyed = keyed_lengths(lines, config).where(F.col("length") < config.deep_below)
    keyed = with_segments(keyed, "main", edits, F.col("by"), F.col("length"))
    at, size = F.col("main.start") + F.col("main.shift"), F.col("main.size")
    inside = keyed.where((at >= 1) & (at + size - 1 <= F.col("own")))
    # Left and right of the segment: what the indexed line has there, and where this line's parts begin and end.
    before, after = F.col("main.start") - 1, F.col("length") - F.col("main.start") - size + 1
    sides = with_segments(inside, "left", F.col("main.i"), F.col("main.shift"), before)
    left_at, left_size = F.col("left.start") + F.col("left.shift"), F.col("left.size")
    sides = sides.where((left_at >= 1) & (left_at + left_size <= at))
    sides = with_segments(sides, "right", edits - F.col("main.i"), F.col("by") - F.col("main.shift"), after)
    right_at, right_size = at + size - 1 + F.col("right.start") + F.col("right.shift"), F.col("right.size")
    sides = sides.where((right_at >= at + size) & (right_at + right_size - 1 <= F.col("own")))
    name = ["length", "main.i", cut(at, size), "left.i", cut(left_at, left_size), "right.i", cut(right_at, right_size)]
    return sides.select("node", F.xxhash64(*name).alias("bucket"))


def line_texts(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line): written, the text of the wanted nodes."""
    lines = found.where("line IS NOT NULL").select("node", "line")
    return written(with_small(lines, nodes, ["node"], most=SLIM_ROWS).groupBy("node").agg(F.first("line").alias("line")), "lines")


#: A line with a word, from the first character of the word.
LINE = r"[^\x20\x09-\x0D][^\n]*"

GRAM = 3
PARITY = ("parity_0", "parity_1", "parity_2", "parity_3")


def gram_parity(lines: DataFrame) -> DataFrame:
    """(node, parity words) of (node, line): 256 bits that say which hashes of GRAM characters occur an odd number of times.

    An edit replaces GRAM of them at most, so it turns 2 * GRAM bits at most.
    """
    wide = lines.select("node", "line", F.encode("line", "UTF-32").alias("wide"))
    last = F.char_length("line") - GRAM + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array(F.lit(1)))
    wide = wide.withColumn("place", F.explode(places))
    grams = wide.select("node", F.xxhash64(F.col("wide").substr(4 * F.col("place") - 3, F.lit(4 * GRAM))).alias("h"))
    word, bit = F.shiftrightunsigned("h", 62), F.expr("shiftleft(1L, cast(h & 63 AS INT))")
    words = [F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(p) for i, p in enumerate(PARITY)]
    return grams.groupBy("node").agg(*words)


class EditBound(NoBound):
    """Open pairs meet only within the edit distance, which the join itself computes in its band.

    Before that, the parities of their short substrings must not differ by more than the edits can change.
    """

    columns = ("line", *PARITY)

    def __init__(self, texts: DataFrame, max_edits: int) -> None:
        self.texts, self.max_edits = texts, max_edits

    def narrowed(self, members: DataFrame) -> DataFrame:
        members = members.drop(*self.columns)
        nodes = written(members.select("node").distinct(), "open_nodes")
        texts = with_small(self.texts, nodes, ["node"], most=SLIM_ROWS)
        parities = with_small(texts, written(gram_parity(texts), "parities"), ["node"])
        return with_small(members, written(parities, "open_lines"), ["node"])

    def possible(self, left: str, right: str) -> Column:
        one, two = F.col(f"{left}.line"), F.col(f"{right}.line")
        apart = F.abs(F.char_length(one) - F.char_length(two))
        turned = sum(F.bit_count(F.col(f"{left}.{p}").bitwiseXOR(F.col(f"{right}.{p}"))) for p in PARITY)
        near = F.levenshtein(one, two, self.max_edits) >= 0
        return (turned <= 2 * GRAM * self.max_edits) & (apart <= self.max_edits) & near


def close_lines(found: DataFrame, config: LineConfig) -> DataFrame | None:
    """(node, component) of the lines that edits link to others."""
    members = shared_buckets(segment_keys(found, config))
    texts = line_texts(found, written(members.select("node").distinct(), "nodes"))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        left = texts.select(F.col("node").alias("a"), F.col("line").alias("left"))
        right = texts.select(F.col("node").alias("b"), F.col("line").alias("right"))
        both = with_small(with_small(pairs, left, ["a"]), right, ["b"])
        apart = F.abs(F.char_length("left") - F.char_length("right"))
        near = F.levenshtein("left", "right", config.max_edits) >= 0
        return both.where((apart <= config.max_edits) & near).select("a", "b", F.lit(True).alias("linked"))

    return linked_components(members, verify, EditBound(texts, config.max_edits))


def line_classes(docs: DataFrame, config: LineConfig = LineConfig()) -> tuple[DataFrame, DataFrame]:
    """The occurrences in numbered documents, and the classes of lines that occur more than once.

    Classes: (key, own_first, class_first), the place of the first equal line and of the first of the class.
    """
    found = occurrences(docs)
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row", "line_no")
    groups = found.where("key IS NOT NULL").groupBy("key").agg(F.min(place).alias("own_first"), F.count(F.lit(1)).alias("n"))
    labels = close_lines(found, config)
    if labels is None:
        classes = groups.where("n > 1").select("key", "own_first", F.col("own_first").alias("class_first"))
        return found, written(classes, "classes")
    known = with_small(found.select("node", "key").where("key IS NOT NULL"), labels, ["node"], most=SLIM_ROWS)
    near = written(known.select("key", "component").distinct(), "near")
    groups = written(with_small(groups, near, ["key"], "left").where("n > 1 OR component IS NOT NULL"), "groups")
    firsts = groups.where("component IS NOT NULL").groupBy("component").agg(F.min("own_first").alias("class_first"))
    classes = with_small(groups, written(firsts, "firsts"), ["component"], "left")
    return found, written(classes.select("key", "own_first", F.coalesce("class_first", "own_first").alias("class_first")), "classes")


def dropped_lines(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(row, line_no, exact): the occurrences that are not the first of their class; exact if an equal line came first."""
    later = with_small(found.where("key IS NOT NULL"), classes, ["key"])

    def here(first: str) -> Column:
        return (F.col("row") == F.col(f"{first}.row")) & (F.col("line_no") == F.col(f"{first}.line_no"))

    return later.where(~here("class_first")).select("row", "line_no", (~here("own_first")).alias("exact"))


def cleaned(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """One row per document: (doc_id, text, n_lines, n_kept, n_exact_dup, n_near_dup, dropped).

    The text has the lines that stay, as they were, with those without a word; null stays null. ``dropped`` has the
    numbers (from 0) of the others.
    """
    docs = written(numbered(docs.select("doc_id", "text")), "numbered", codec="zstd")
    found, classes = line_classes(docs, config)
    dropped = dropped_lines(found, classes).groupBy("row").agg(
        F.count_if(F.col("exact")).alias("n_exact_dup"),
        F.count_if(~F.col("exact")).alias("n_near_dup"),
        F.sort_array(F.collect_list("line_no")).alias("gone"),
    )
    rows = with_small(docs, written(dropped, "dropped"), ["row"], "left").fillna(0, ["n_exact_dup", "n_near_dup"])
    n_lines = F.coalesce(F.regexp_count("text", F.lit(LINE)), F.lit(0)).cast("long")
    rows = rows.withColumn("n_lines", n_lines)
    stay = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", i))
    return rows.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text"),
        "n_lines",
        (F.col("n_lines") - F.col("n_exact_dup") - F.col("n_near_dup")).alias("n_kept"),
        "n_exact_dup",
        "n_near_dup",
        F.coalesce(F.array_join(F.transform("gone", lambda x: x.cast("string")), ","), F.lit("")).alias("dropped"),
    )


def line_report(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """One row per document: its lines, how many stay, and the numbers (from 0) of those dropped."""
    return cleaned(docs, config).drop("text")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = cleaned(table(spark, folder, "documents"))
    return found.select(*[c for c in found.columns if c != "text"], F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
