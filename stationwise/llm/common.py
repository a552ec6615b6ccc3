"""Shared helpers: input tables, written tables in the shared folder, row keys and size-checked joins."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all operators, as a character class of regular expressions.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a batch that goes to Python.
ARROW_BYTES = 4 << 20

#: A table is broadcast only up to so many (slim) rows.
BROADCAST_ROWS = 250_000
#: The same for tables of one or two numbers.
SLIM_ROWS = 1_000_000
#: A written table whose rows are bounded by a count is written by tasks of so many rows, not by one per shuffle partition.
ROWS_A_TASK = 10_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python by bytes, since texts differ a thousandfold in length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def give_back() -> None:
    """Return freed memory of a Python worker to the system, Arrow's pool too; workers wait between tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="llm-work-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


#: Paths named since the innermost ``scratch`` began; None outside.
SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table of this application uses."""
    path = f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if (paths := SCRATCH.get()) is not None:
        paths.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at its end: whatever reads them must be done by then."""
    paths: list[str] = []
    token = SCRATCH.set(paths)
    try:
        yield
    finally:
        SCRATCH.reset(token)
        for path in paths:
            discard(spark, path)


def written(frame: DataFrame, name: str, most: int | None = None, codec: str = "snappy") -> DataFrame:
    """Write the frame as Parquet to the shared folder and read it back, which cuts its lineage.

    ``most`` is a counted bound of the rows of the frame and of what its last stage reads; small tables then come in few files.
    """
    path = new_path(frame.sparkSession, name)
    if most is not None:
        frame = frame.coalesce(most // ROWS_A_TASK + 1)
    frame.write.option("compression", codec).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def written_at(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, with the path, for tables that are discarded before the end."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table whose last reader is done."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear_work(spark: SparkSession) -> None:
    """Delete the written tables of this application; results that read them must have been used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(frame: DataFrame, stem: str) -> str:
    """A column name starting with the stem that the frame lacks, in any letter case."""
    taken = {c.lower() for c in frame.columns}
    name = stem
    while name in taken:
        name += "_"
    return name


def with_row_key(frame: DataFrame, name: str = "rows") -> tuple[DataFrame, str]:
    """A written copy of the frame with a unique row number, and that column's name.

    Row numbers tell repeated rows apart; they are stable because they are stored. By zstd texts take two thirds of the room.
    """
    key = fresh_name(frame, "row_key")
    return written(frame.withColumn(key, F.monotonically_increasing_id()), name, codec="zstd"), key


#: Bits of a row's index in its file; the file's number lies above.
INDEX_BITS = 40


def is_plain_read(frame: DataFrame) -> bool:
    """True for a frame that is a folder of Parquet files or one such file, read as it is.

    Spark tells paths and schemas that were given in different ways apart; of a frame it finds no equal for, nothing is known.
    """
    spark, files = frame.sparkSession, frame.inputFiles()
    roots = {f.rpartition("/")[0] for f in files} if len(files) != 1 else {files[0], files[0].rpartition("/")[0]}
    for root in roots if len(files) == 1 or len(roots) == 1 else ():
        bare = urlsplit(root).path
        for path in (root, bare, f"file:{bare}"):
            # A path that cannot be read by its listed name counts as no plain read.
            with contextlib.suppress(AnalysisException):
                if any(frame.sameSemantics(x.parquet(path)) for x in (spark.read.schema(frame.schema), spark.read)):
                    return True
    return False


def with_place_key(frame: DataFrame) -> tuple[DataFrame, str]:
    """The frame with a unique row number, and that column's name, without a copy where Parquet files hold the rows already.

    A plain read returns the same rows at the same places each time, so a file's number and the index of the row in it
    name the row. Any other frame may change from one reading to the next and is stored by ``with_row_key``.
    """
    if "_metadata" in {c.lower() for c in frame.columns} or not is_plain_read(frame):
        return with_row_key(frame)
    key, file, index = (fresh_name(frame, x) for x in ("row_key", "row_file", "row_index"))
    placed = frame.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(index))
    found = placed.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.max(index).alias("last")).collect()
    if any(r.n != r.last + 1 for r in found):
        # A file that is read twice has two rows at every place.
        return with_row_key(frame)
    numbers = frame.sparkSession.createDataFrame(list(enumerate(sorted(r[file] for r in found))), f"{key} long, {file} string")
    keyed = placed.join(F.broadcast(numbers), file).withColumn(key, F.shiftleft(key, INDEX_BITS) + F.col(index))
    return keyed.select(*frame.columns, key), key


def with_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table of one row per key: broadcast when its counted rows allow, else shuffled.

    The shuffled form leaves hot keys of the big side to adaptive skew splitting.
    """
    if small.count() <= most:
        small = F.broadcast(small)
    return big.join(small, on, how)


def without_rows(frame: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in the one column of ``gone``; broadcast when its counted rows allow, else shuffled."""
    gone = written(gone.toDF(key), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return frame.join(gone, key, "left_anti")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows set apart; a null doc_id is never set apart."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
