"""Session helpers: a local session for tests and benchmarks, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups up to which their table is broadcast.
MOST_GROUPS = 50_000


def local_session(cpus: int | str = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    cores = "*" if cpus == "*" else str(int(cpus))
    shuffle = partitions or (8 if cpus == "*" else int(cpus))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stationwise")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without one gets a temporary folder; on a cluster a machine-local folder
    would not survive a lost executor, so a missing setting is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="stationwise-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def work_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    return f"{ensure_checkpoint_dir(spark)}/stationwise/{spark.sparkContext.applicationId}"


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write the frame as Parquet to the shared folder and read it back.

    Later plans prune columns and push filters into the written table.
    """
    spark = frame.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def clear_work(spark: SparkSession) -> None:
    """Delete the intermediate tables; results that read them must have been used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_groups(frame: DataFrame, groups: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join one row per group without shuffling the rows by group.

    The group table is written and counted; up to a fixed number of rows it is
    broadcast, beyond it there are so many groups that a plain join is spread.
    """
    groups = cut_lineage(groups)
    return frame.join(F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups, on, how)
