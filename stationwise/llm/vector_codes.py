"""Operator 13, vector code compression: a product codebook fitted with Drake and Hamerly's adaptive bounds.

Vectors are cut into equal parts; each part position has a codebook of its own. A
round assigns every part to the nearest entry of its codebook and moves each entry to
the floor of its parts' mean. For every row and part the engine stores

- the entry it is assigned to, with an upper bound of the distance,
- the ``b`` next closest entries in order, each with a lower bound,
- one outer bound below the distances of all others.

When entries move, the bounds give way by the distance moved, so a pass computes
distances only where bounds cannot decide: where the upper bound does not lie
strictly below every lower bound. Such uncertain cases are settled in whole numbers,
ties included; where the outer bound fails, all entries are compared. Bounds are
stored in two bytes, rounded outward, so they never claim too much. ``b`` adapts:
after every pass each part position takes the depth that its rows really needed,
between an eighth and a quarter of the entries.

Rows stay where they are: a pass maps the stored rows to the next stored rows, and
sums per task (at most parts x entries of them) give the new entries. Only codebooks
go through the driver.

Cases: rows whose vector is null or holds a null or non-finite component are left
out; a shorter vector counts as filled up with zeros, as do all where the length is
no multiple of the parts; components beyond 2^28 in size count as 2^28; with fewer
rows than entries the codebooks are smaller; null ids come last in the choice of the
first entries, equal ids are ordered by their vectors; equal entries may stay, the
lower index wins; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationwise.llm.common import BROADCAST_ROWS, bounded_batches, discard, table, written, written_at
from stationwise.llm.whitening import usable, whole_numbers


@dataclass(frozen=True)
class CodesConfig:
    """``bounds``: the kept lower bounds at first; ``least_bounds`` at least later on; None: a quarter and an eighth of the entries."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    bounds: int | None = None
    least_bounds: int | None = None


def lower(values: np.ndarray) -> np.ndarray:
    """Two-byte numbers not above the values."""
    short = np.minimum(values, 65504.0).astype(np.float16)
    return np.where(short > values, np.nextafter(short, np.float16(-np.inf)), short)


def upper(values: np.ndarray) -> np.ndarray:
    """Two-byte numbers not below the values."""
    with np.errstate(over="ignore"):
        short = values.astype(np.float16)
        return np.where(short < values, np.nextafter(short, np.float16(np.inf)), short)


#: Room for the rounding of a square root and of two sums.
SLACK = 1e-12


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    total = (x[..., 0] - y[..., 0]) ** 2
    for d in range(1, x.shape[-1]):
        total += (x[..., d] - y[..., d]) ** 2
    return total


class Bounds:
    """Assignments and bounds of many rows at one part position."""

    def __init__(self, entry: np.ndarray, above: np.ndarray, others: np.ndarray, below: np.ndarray, outer: np.ndarray) -> None:
        self.entry, self.above, self.others, self.below, self.outer = entry, above, others, below, outer

    @classmethod
    def fresh(cls, x: np.ndarray, book: np.ndarray, kept: int) -> "Bounds":
        """By all distances."""
        distance = squared(x[:, None, :], book[None, :, :])
        entry = distance.argmin(1)
        rows = np.arange(len(x))
        nearest = np.sqrt(distance[rows, entry].astype(float))
        distance[rows, entry] = np.iinfo(np.int64).max
        kept = min(kept, len(book) - 1)
        near = np.argpartition(distance, min(kept, len(book) - 1), 1)[:, : kept + 1]
        order = np.take_along_axis(near, np.argsort(np.take_along_axis(distance, near, 1), 1), 1)
        root = np.sqrt(np.take_along_axis(distance, order, 1).astype(float)) * (1 - SLACK)
        outer = root[:, kept] if kept < len(book) - 1 else np.full(len(x), np.inf)
        return cls(entry, nearest * (1 + SLACK), order[:, :kept], root[:, :kept], outer)

    def moved(self, drift: np.ndarray) -> None:
        """The bounds after the entries moved by these distances."""
        self.above = (self.above + drift[self.entry]) * (1 + SLACK)
        self.below = np.maximum(0.0, self.below - drift[self.others] * (1 + SLACK)) * (1 - SLACK)
        self.outer = np.where(np.isinf(self.outer), self.outer, np.maximum(0.0, self.outer - drift.max() * (1 + SLACK)) * (1 - SLACK))
        order = np.argsort(self.below, 1, kind="stable")
        self.others, self.below = np.take_along_axis(self.others, order, 1), np.take_along_axis(self.below, order, 1)

    def cut(self, kept: int) -> None:
        """Keep fewer lower bounds; the outer bound takes over the rest."""
        if kept < self.below.shape[1]:
            self.outer = np.minimum(self.outer, self.below[:, kept])
            self.others, self.below = self.others[:, :kept], self.below[:, :kept]

    def assign(self, x: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Settle every row; gives the depth that each needed (kept + 1: all entries)."""
        depth = np.zeros(len(x), np.int64)
        kept = self.below.shape[1]
        nearest_other = np.minimum(self.below[:, 0], self.outer) if kept else self.outer
        open_rows = np.flatnonzero(~(self.above < nearest_other))
        if not len(open_rows):
            return depth
        # A tight upper bound first: often it is enough.
        own = squared(x[open_rows], book[self.entry[open_rows]])
        root = np.sqrt(own.astype(float))
        self.above[open_rows] = root * (1 + SLACK)
        still = ~(self.above[open_rows] < nearest_other[open_rows])
        open_rows, own = open_rows[still], own[still]
        everything = ~(self.above[open_rows] < self.outer[open_rows])
        self.some(x, book, open_rows[~everything], own[~everything], depth)
        again = open_rows[everything]
        if len(again):
            new = Bounds.fresh(x[again], book, kept)
            self.entry[again], self.above[again], self.outer[again] = new.entry, new.above, new.outer
            self.others[again], self.below[again] = new.others, new.below
            depth[again] = kept + 1
        return depth

    def some(self, x: np.ndarray, book: np.ndarray, rows: np.ndarray, own: np.ndarray, depth: np.ndarray) -> None:
        """Compare the kept entries whose bound is not above the upper bound, in whole numbers."""
        if not len(rows):
            return
        asked = self.below[rows] <= self.above[rows][:, None]
        depth[rows] = asked.sum(1)
        most = int(depth[rows].max())
        others, asked = self.others[rows][:, :most], asked[:, :most]
        distance = squared(x[rows][:, None, :], book[others])
        # Own entry and asked ones compete; the lower index wins ties.
        found = np.where(asked, distance, np.iinfo(np.int64).max)
        least = np.minimum(found.min(1), own)
        index = np.where(found == least[:, None], others, len(book)).min(1)
        entry = np.where(own == least, np.minimum(self.entry[rows], index), index)
        # The old entry takes the place of the new one in the list.
        place = others == entry[:, None]
        others = np.where(place, self.entry[rows][:, None], others)
        below = np.where(asked, np.sqrt(distance.astype(float)) * (1 - SLACK), self.below[rows][:, :most])
        below = np.where(place, (np.sqrt(own.astype(float)) * (1 - SLACK))[:, None], below)
        all_others, all_below = self.others[rows], self.below[rows]
        all_others[:, :most], all_below[:, :most] = others, below
        order = np.argsort(all_below, 1, kind="stable")
        self.others[rows], self.below[rows] = np.take_along_axis(all_others, order, 1), np.take_along_axis(all_below, order, 1)
        self.entry[rows], self.above[rows] = entry, np.sqrt(least.astype(float)) * (1 + SLACK)


#: The stored form of a row's bounds: entries as bytes, bounds as two-byte numbers, part by part.
BOUNDS = "entries binary, above binary, others binary, below binary, outer binary, depths binary"


def matrix_of(column: pd.Series, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), width)


def packed(values: np.ndarray, kind: type) -> list[bytes]:
    """One byte string per row."""
    values = np.ascontiguousarray(values, kind)
    width = values.shape[1] * values.itemsize
    whole = values.tobytes()
    return [whole[i : i + width] for i in range(0, width * len(values), width)] if width else [b""] * len(values)


class Fit:
    """One pass: codebooks, how far they moved, and how many bounds the stored rows have and shall keep, per part."""

    def __init__(self, books: np.ndarray, drift: np.ndarray | None, stored: list[int], kept: list[int]) -> None:
        self.books, self.drift, self.stored, self.kept = books, drift, stored, kept
        self.index = np.uint8 if books.shape[1] <= 256 else np.uint16

    def parts(self, x: pd.Series) -> np.ndarray:
        return np.stack(x.to_numpy()).astype(np.int64).reshape(len(x), len(self.books), -1)

    def read(self, state: pd.DataFrame) -> list[Bounds]:
        n, ends = len(self.books), np.cumsum([0, *self.stored])
        entries, above = matrix_of(state["entries"], self.index, n), matrix_of(state["above"], np.float16, n)
        others, below = matrix_of(state["others"], self.index, ends[-1]), matrix_of(state["below"], np.float16, ends[-1])
        outer = matrix_of(state["outer"], np.float16, n)
        return [
            Bounds(
                entries[:, p].astype(np.int64),
                above[:, p].astype(float),
                others[:, ends[p] : ends[p + 1]].astype(np.int64),
                below[:, ends[p] : ends[p + 1]].astype(float),
                outer[:, p].astype(float),
            )
            for p in range(n)
        ]

    def assigned(self, x: np.ndarray, state: pd.DataFrame | None) -> tuple[list[Bounds], np.ndarray]:
        """The bounds of all parts after this pass, and the depths needed."""
        if state is None:
            return [Bounds.fresh(x[:, p], self.books[p], self.kept[p]) for p in range(len(self.books))], np.zeros(x.shape[:2], int)
        bounds, depths = self.read(state), []
        for p, b in enumerate(bounds):
            b.moved(self.drift[p])
            depths.append(b.assign(x[:, p], self.books[p]))
            b.cut(self.kept[p])
        return bounds, np.stack(depths, 1)

    def stored_rows(self, bounds: list[Bounds], depths: np.ndarray) -> pd.DataFrame:
        columns = lambda name: np.stack([getattr(b, name) for b in bounds], 1)
        outer = columns("outer")
        return pd.DataFrame(
            {
                "entries": packed(columns("entry"), self.index),
                "above": packed(upper(columns("above")), np.float16),
                "others": packed(np.concatenate([b.others for b in bounds], 1), self.index),
                "below": packed(lower(np.concatenate([b.below for b in bounds], 1)), np.float16),
                "outer": packed(np.where(np.isinf(outer), np.float16(np.inf), lower(outer)), np.float16),
                "depths": packed(depths, np.uint16),
            }
        )


def bound_pass(rows: DataFrame, fit: Fit) -> DataFrame:
    """The rows with the struct column ``state`` of this pass; other columns never leave the JVM."""
    shared = rows.sparkSession.sparkContext.broadcast(fit)

    def run(x: pd.Series, state: pd.DataFrame | None) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame(columns=[c.split()[0] for c in BOUNDS.split(", ")])
        return shared.value.stored_rows(*shared.value.assigned(shared.value.parts(x), state))

    if fit.drift is None:

        @F.pandas_udf(BOUNDS)
        def first(x: pd.Series) -> pd.DataFrame:
            return run(x, None)

        return rows.withColumn("state", first("x"))

    @F.pandas_udf(BOUNDS)
    def later(x: pd.Series, state: pd.DataFrame) -> pd.DataFrame:
        return run(x, state)

    return rows.withColumn("state", later("x", "state"))


def entry_sums(rows: DataFrame, fit: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and sums of every entry's parts, and how often each depth was needed, added up per task first."""
    parts, size, width = fit.books.shape
    most = max(fit.stored) + 2
    index = fit.index

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        depth = np.zeros((parts, most), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy()).astype(np.int64).reshape(len(batch), parts, width)
            entries, depths = matrix_of(batch["entries"], index, parts), matrix_of(batch["depths"], np.uint16, parts)
            for p in range(parts):
                np.add.at(count[p], entries[:, p], 1)
                np.add.at(total[p], entries[:, p], x[:, p])
                np.add.at(depth[p], depths[:, p], 1)
        # Entries from 0 on, depths as -1, -2 and so on.
        keys = [(p, e) for p in range(parts) for e in range(size) if count[p, e]]
        frame = pd.DataFrame(keys, columns=["part", "entry"])
        frame["n"] = [count[k] for k in keys]
        for d in range(width):
            frame[f"sum{d}"] = [total[k][d] for k in keys]
        needed = pd.DataFrame([(p, -1 - k, depth[p, k]) for p in range(parts) for k in range(most) if depth[p, k]], columns=["part", "entry", "n"])
        yield pd.concat([frame, needed.reindex(columns=frame.columns, fill_value=0)]).astype(np.int64)

    names = ["part", "entry", "n", *[f"sum{d}" for d in range(width)]]
    partial = rows.select("x", "state.entries", "state.depths").mapInPandas(per_task, ", ".join(f"{c} long" for c in names))
    count, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
    depth = np.zeros((parts, most), np.int64)
    for r in partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]]).collect():
        if r.entry < 0:
            depth[r.part, -1 - r.entry] = r.n
        else:
            count[r.part, r.entry], total[r.part, r.entry] = r.n, r[3:]
    return count, total, depth


def next_fit(fit: Fit, count: np.ndarray, total: np.ndarray, depth: np.ndarray, least: int) -> Fit:
    """Entries moved to the floor of their parts' mean, and the bounds that the next pass shall keep."""
    books = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], fit.books)
    drift = np.sqrt(squared(books, fit.books).astype(float)) * (1 + SLACK)
    kept = list(fit.kept)
    if fit.drift is not None:
        # The depth that suffices for 99 rows in 100.
        share = np.cumsum(depth, 1) / np.maximum(1, depth.sum(1, keepdims=True))
        kept = [int(min(b, max(least, np.searchsorted(s, 0.99)))) for b, s in zip(fit.kept, share)]
    return Fit(books, drift, list(fit.kept), kept)


def fit_codes(
    rows: DataFrame, identifier: str, vector: str, config: CodesConfig, carry: tuple[str, ...] = ()
) -> tuple[DataFrame, np.ndarray] | None:
    """The kept rows (id, x, carried columns, code binary, error long) and the codebooks; None without rows."""
    spark = rows.sparkSession
    bounded_batches(spark)
    x = whole_numbers(F.col(vector))
    kept = rows.where(usable(F.col(vector))).select(F.col(identifier).alias("id"), x.alias("x"), *carry)
    n_rows, longest, most = kept.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if not n_rows:
        return None
    width = max(1, -(-longest // config.parts))
    if width * (2 * (most or 0)) ** 2 >= 1 << 63:
        raise ValueError("squared distances of such vectors pass 64 bits")
    padding = F.array_repeat(F.lit(0).cast("long"), F.lit(width * config.parts) - F.size("x"))
    kept = kept.withColumn("x", F.concat("x", padding))
    smallest = kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(config.entries).select("x").collect()
    books = np.array([r.x for r in smallest], np.int64).reshape(len(smallest), config.parts, width).transpose(1, 0, 2)
    others = len(smallest) - 1
    first = min(others, config.bounds if config.bounds is not None else -(-config.entries // 4))
    least = min(others, config.least_bounds if config.least_bounds is not None else -(-config.entries // 8))
    fit = Fit(books, None, [first] * config.parts, [first] * config.parts)
    rows, path = kept, None
    for _ in range(config.rounds):
        rows, new_path = written_at(bound_pass(rows, fit), "bounds")
        if path:
            discard(spark, path)
        path = new_path
        fit = next_fit(fit, *entry_sums(rows, fit), least)
    return coded(rows, fit), fit.books


def coded(rows: DataFrame, fit: Fit) -> DataFrame:
    """The last assignment: (id, x, carried columns, code, error)."""
    shared = rows.sparkSession.sparkContext.broadcast(fit)

    def run(x: pd.Series, state: pd.DataFrame | None) -> pd.DataFrame:
        fit = shared.value
        if not len(x):
            return pd.DataFrame(columns=["code", "error"])
        parts = fit.parts(x)
        bounds, _ = fit.assigned(parts, state)
        entries = np.stack([b.entry for b in bounds], 1)
        error = sum(squared(parts[:, p], fit.books[p][entries[:, p]]) for p in range(len(fit.books)))
        return pd.DataFrame({"code": packed(entries, fit.index), "error": error})

    if fit.drift is None:

        @F.pandas_udf("code binary, error long")
        def only(x: pd.Series) -> pd.DataFrame:
            return run(x, None)

        return rows.withColumn("last", only("x")).select("*", "last.*").drop("last")

    @F.pandas_udf("code binary, error long")
    def last(x: pd.Series, state: pd.DataFrame) -> pd.DataFrame:
        return run(x, state)

    return rows.withColumn("last", last("x", "state")).select("*", "last.*").drop("last", "state")


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(
    rows: DataFrame,
    identifier: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    config: CodesConfig = CodesConfig(),
) -> DataFrame:
    """One row per kept row: (id, code as hex, error, label_error, codebooks_sha256)."""
    found = fit_codes(rows.withColumn("own_label", F.col(label)), identifier, vector, config, ("own_label",))
    if found is None:
        kind = rows.schema[identifier].dataType.simpleString()
        columns = f"{identifier} {kind}, code string, error long, label_error long, codebooks_sha256 string"
        return rows.sparkSession.createDataFrame([], columns)
    codes, books = found
    codes = written(codes.select("id", "own_label", F.lower(F.hex("code")).alias("code"), "error"), "codes")
    sums = codes.groupBy(F.col("own_label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("own_label").eqNullSafe(F.col("of_label"))).select(
        F.col("id").alias(identifier), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return compressed(table(spark, folder, "embeddings"))
