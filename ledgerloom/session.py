"""Session settings for local runs, and the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "ledgerloom", **conf: str) -> SparkSession:
    """Session for tests and benches. On a cluster the caller's own session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder named by the session; only a local session may fall back to its own folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Tables that are opened within have their folders listed by a few tasks per core.

    With a folder per institution Spark would else start a task for each, up to 10,000, and a task takes far longer to
    start than a folder to list. The session's own setting holds again afterwards.
    """
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, min(int(before), max(32, 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


_made: list[str] = []


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written by this run."""
    _made.append(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove_intermediate(spark: SparkSession) -> int:
    """Delete all tables that this process has stored on the way, once no result that reads them is needed any more.

    Returns how many there were.
    """
    hadoop, n = spark._jvm.org.apache.hadoop.fs, 0
    while _made:
        path = hadoop.Path(_made.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a result once below the shared folder and read it back, where several jobs need it."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
