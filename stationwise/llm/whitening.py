"""Operator 12, embedding whitening with MLlib's distributed block matrices.

Every entry c becomes the whole number x = floor(256 c). The *fit list* holds each
distinct vector once. Its rows, less their mean, are indexed into a ``BlockMatrix``;
the transpose times the matrix is the scatter matrix (dimension by dimension, so
its size follows the vectors' length, not their number), whose eigenvectors are
found on the driver. All rows, centred alike, become a second block matrix, and its
product with the whitening matrix (unit eigenvectors over the roots of their
eigenvalues) projects them. A third product checks the result: the covariance of
the whitened fit list against the identity.

The middle dimension of each transposed product is split over tasks, so that none
of them reads all rows. Rows find their result by their row number, not by their
vector, so a vector that fills a third of the table is no hot key.

Cases: rows whose vector is null or holds a null or non-finite entry are left out;
shorter vectors count as filled up with zeros; entries beyond 2^28 in size count as
2^28; directions without variance (eigenvalue 0 within rounding) cannot be whitened
and give no component, so a single distinct vector, an empty vector or an empty
table give no rows; repeated rows and null ids stay; further columns are ignored.
The deviation is exact; where it passes a long it is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from stationwise.llm.common import new_path, table, with_small, written

SCALE = 256
#: Entries count as at most so large.
MOST = 1 << 28
#: Bits of a row number that count within a partition.
PLACE_BITS = 33


@dataclass(frozen=True)
class WhiteningConfig:
    """``components``: how many, at most; blocks have at least ``block_rows`` rows, more on long tables, and at most ``block_bytes``."""

    components: int = 4
    block_rows: int = 1_024
    block_cols: int = 1_024
    most_blocks: int = 20_000
    block_bytes: int = 64 << 20
    #: Eigenvalues up to this share of the largest, times the dimension, count as 0.
    least_share: float = 1e-13


def whole_numbers(vector: Column) -> Column:
    """floor(256 c) of every entry, as a long."""
    scaled = lambda c: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c.cast("double") * SCALE))
    return F.transform(vector, lambda c: F.floor(scaled(c)).cast("long"))


def usable(vector: Column) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, lambda c: F.coalesce(bad(c), F.lit(True)))


def dense_index(rows: DataFrame, name: str) -> DataFrame:
    """A written copy with a column ``index`` that counts the rows from 0 without gaps.

    Only one number per partition, its rows, goes through the driver.
    """
    stored = written(rows.withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", PLACE_BITS)
    counts = sorted(stored.groupBy(part.alias("part")).count().collect())
    before = np.concatenate([[0], np.cumsum([c["count"] for c in counts])]).tolist()
    firsts = rows.sparkSession.createDataFrame(
        [(c.part, first) for c, first in zip(counts, before)], "part long, first long"
    )
    numbered = with_small(stored.withColumn("part", part), firsts, ["part"])
    within = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return numbered.withColumn("index", F.col("first") + within).drop("place", "part", "first")


#: The columns that MLlib's matrices have in a stored table.
STORED_MATRIX = (
    "struct<type: tinyint, numRows: int, numCols: int, colPtrs: array<int>, rowIndices: array<int>, "
    "values: array<double>, isTransposed: boolean>"
)


def stored_as(frame: DataFrame, kind: StructType, name: str) -> DataFrame:
    """The frame, stored, with its columns read as another type of the same stored form."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(kind).parquet(path)


def block_type(matrix: DataType) -> StructType:
    return StructType([StructField("_1", StructType([StructField(c, LongType()) for c in ("_1", "_2")])), StructField("_2", matrix)])


class Blocks:
    """Block matrices of rows, their products, and rows again; the rows stay in the JVM."""

    def __init__(self, n_rows: int, n_cols: int, config: WhiteningConfig) -> None:
        self.n_rows, self.n_cols = n_rows, n_cols
        self.cols = min(n_cols, config.block_cols)
        self.rows = min(max(config.block_rows, n_rows // config.most_blocks), max(1, config.block_bytes // (8 * self.cols)))

    def of(self, rows: DataFrame, mean: list[float], n_rows: int) -> BlockMatrix:
        """The centred rows (index, x) as stored dense blocks, row by row."""
        centred = F.zip_with("x", F.array(*map(F.lit, mean)), lambda x, m: x - m)
        at = F.explode(F.sequence(F.lit(0), F.lit((self.n_cols - 1) // self.cols))).alias("at")
        pieces = rows.select("index", centred.alias("x"), at).select(
            F.floor(F.col("index") / self.rows).alias("block"),
            "at",
            F.struct("index", F.slice("x", F.col("at") * self.cols + 1, self.cols).alias("x")).alias("row"),
        )
        grouped = pieces.groupBy("block", "at").agg(F.array_sort(F.collect_list("row")).alias("rows"))
        size = F.size("rows")
        matrix = F.struct(
            F.lit(1).cast("tinyint").alias("type"),
            size.alias("numRows"),
            F.size(F.element_at("rows", 1)["x"]).alias("numCols"),
            *[F.lit(None).cast("array<int>").alias(c) for c in ("colPtrs", "rowIndices")],
            F.flatten(F.transform("rows", lambda r: r["x"])).alias("values"),
            F.lit(True).alias("isTransposed"),
        )
        keys = F.struct(F.col("block").alias("_1"), F.col("at").cast("long").alias("_2"))
        blocks = stored_as(grouped.select(keys.alias("_1"), matrix.alias("_2")), block_type(MatrixUDT()), "blocks")
        sizes = (self.rows, self.cols, n_rows, self.n_cols)
        return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, *sizes), self.rows, self.cols)

    def scatter(self, matrix: BlockMatrix, cols: int) -> np.ndarray:
        """The transpose times the matrix, which is as large as its columns squared."""
        splits = max(1, min(matrix.numRowBlocks, matrix.blocks.getNumPartitions()))
        product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
        return BlockMatrix(product, cols, cols).toLocalMatrix().toArray()

    def projected(self, matrix: BlockMatrix, by: np.ndarray, spark: SparkSession) -> BlockMatrix:
        pieces = [
            ((k, 0), Matrices.dense(len(part), by.shape[1], part.flatten(order="F").tolist()))
            for k, part in enumerate(by[i : i + self.cols] for i in range(0, len(by), self.cols))
        ]
        right = BlockMatrix(spark.sparkContext.parallelize(pieces, 1), self.cols, by.shape[1], len(by), by.shape[1])
        return matrix.multiply(right)

    def rows_of(self, matrix: BlockMatrix, k: int) -> DataFrame:
        """The rows of a matrix of one column of blocks, as (index, whitened)."""
        plain = block_type(StructType.fromDDL(f"m {STORED_MATRIX}")["m"].dataType)
        blocks = stored_as(callMLlibFunc("getMatrixBlocks", matrix._java_matrix_wrapper._java_model), plain, "projected")
        size, values = F.col("_2.numRows"), F.col("_2.values")

        def row(r: Column) -> Column:
            cells = [F.get(values, F.when(F.col("_2.isTransposed"), r * k + c).otherwise(size * c + r)) for c in range(k)]
            return F.struct((F.col("_1._1") * self.rows + r).alias("index"), F.array(*cells).alias("whitened"))

        return blocks.select(F.inline(F.transform(F.sequence(F.lit(0), size - 1), row)))


def eigenpairs(covariance: np.ndarray, config: WhiteningConfig) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues falling, unit eigenvectors as columns whose largest entry is positive; without directions of no variance."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = int((values > max(0.0, values[0]) * len(values) * config.least_share).sum()) if values[0] > 0 else 0
    keep = min(keep, config.components)
    vectors = vectors[:, :keep]
    return values[:keep], vectors * np.where(vectors[np.abs(vectors).argmax(0), range(keep)] < 0, -1.0, 1.0)


def deviation(n: int, sums: list[int], most: int) -> Column:
    """The exact sum of (n x - S)^2, in longs where they are sure to hold it."""
    kind = "long" if len(sums) * (2 * n * max(1, most)) ** 2 < 1 << 63 else "decimal(38,0)"
    count = F.lit(n).cast(kind)
    # Plain numbers: a long array literal of the sums.
    parts = F.zip_with("x", F.array(*[F.lit(s).cast(kind) for s in sums]), lambda x, s: count * x.cast(kind) - s)
    if kind == "long":
        return F.aggregate(parts, F.lit(0).cast(kind), lambda total, p: total + p * p)
    total = F.aggregate(parts, F.lit(0).cast(kind), lambda t, p: F.try_add(t, F.try_multiply(p, p)).cast(kind))
    return total.try_cast("long")


RESULT = "{id} {type}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(
    rows: DataFrame, identifier: str = "vec_id", vector: str = "embedding", config: WhiteningConfig = WhiteningConfig()
) -> DataFrame:
    """One row per kept row and component: (id, component from 1, n, deviation, whitened, explained, identity_error)."""
    spark = rows.sparkSession
    x = whole_numbers(F.col(vector))
    kept = rows.where(usable(F.col(vector))).select(F.col(identifier).alias("id"), x.alias("x"))
    kept = dense_index(kept, "whole_numbers")
    n_rows, n_cols = kept.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    empty = spark.createDataFrame([], RESULT.format(id=identifier, type=rows.schema[identifier].dataType.simpleString()))
    if not n_rows or not n_cols:
        return empty
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(n_cols) - F.size("x")))
    kept = kept.withColumn("x", padded)
    fit = dense_index(kept.select("x").distinct(), "fit_list")
    columns = fit.select(F.posexplode("x").alias("at", "x")).groupBy("at")
    totals = sorted(columns.agg(F.sum("x"), F.count("x"), F.max(F.abs("x"))).collect())
    sums, n, most = [t[1] for t in totals], totals[0][2], max(t[3] for t in totals)
    mean = [s / n for s in sums]
    blocks = Blocks(n_rows, n_cols, config)
    fit_matrix = blocks.of(fit, mean, n)
    covariance = blocks.scatter(fit_matrix, blocks.cols) / n
    values, vectors = eigenpairs(covariance, config)
    k = len(values)
    if not k:
        return empty
    whitening = vectors / np.sqrt(values)
    check = blocks.scatter(blocks.projected(fit_matrix, whitening, spark), k) / n
    identity_error = float(np.abs(check - np.eye(k)).max())
    found = blocks.rows_of(blocks.projected(blocks.of(kept, mean, n_rows), whitening, spark), k)
    explained = F.array(*[F.lit(float(v)) for v in values / np.trace(covariance)])
    numbered = kept.select("index", "id", deviation(n, sums, most).alias("deviation")).join(found, "index")
    return numbered.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("id").alias(identifier),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(identity_error).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(table(spark, folder, "embeddings"))
