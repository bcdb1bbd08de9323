"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators count on; all are ordinary Spark options.
#  * adaptive execution: splits an oversized key of a shuffled join, joins small tables by
#    broadcast once their size is known, merges small partitions
#  * small input files: a low open cost packs thousands of tiny JSON files in one task
#  * listing many paths: a task for some of them each; by default every path has its own
#  * duplicate JSON keys: the last one wins
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.files.openCostInBytes": str(64 * 1024),
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Temporary folders of local sessions that come without spark.checkpoint.dir, by application.
_LOCAL_FOLDERS: dict[str, str] = {}

# The folder of the job that runs now, below the shared one; see ``job_folder``.
_JOB: ContextVar[str] = ContextVar("job", default="")


def configure(spark: SparkSession) -> SparkSession:
    """Set CLUSTER_CONF on a running session; all of it may be changed at run time."""
    for key, value in CLUSTER_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the benchmark, with a staging folder of its own; clusters bring
    their own session and folder."""
    extra.setdefault("spark.checkpoint.dir", tempfile.mkdtemp(prefix="paperloom-"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("paperloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local master without the setting, as in a notebook, gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="paperloom-")
    return _LOCAL_FOLDERS[app]


#: Bytes of a source's files that one task gets when its rows are dealt out. Parquet packs some
#: hundred thousand rows in them, and what a task holds of its rows grows with their number.
DEALT_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a source with few files, dealt out evenly: to every core, and to more tasks the
    larger the files are, so that no task's share grows with the source.

    A source with a file for each of these tasks is returned as it is: its scan is split
    already, and it is never shuffled for this.
    """
    found = df.inputFiles()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-_file_bytes(df.sparkSession, found) // DEALT_BYTES))
    return df.repartition(tasks) if len(found) < tasks else df


def shuffles(table: DataFrame) -> bool:
    """True when ``table``'s files are too large for Spark to send them to each task of a join,
    even if only a quarter of their columns is asked for."""
    spark = table.sparkSession
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(limit[-1:], 1)
    limit = int(limit.rstrip("kmg")) * unit
    return _file_bytes(spark, table.inputFiles()) > 4 * max(limit, 0)


def _file_bytes(spark: SparkSession, listed: list[str]) -> int:
    """The size of files by Spark's own listing, which opens none of them."""
    paths = [re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(f)) for f in listed]
    if not paths:
        return 0
    return spark.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0] or 0


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/paperloom/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{_JOB.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """Stages below a folder of their own, which is removed at the end, when the caller has
    written its results."""
    name = f"job-{uuid.uuid4().hex}/"
    token = _JOB.set(name)
    try:
        yield name
    finally:
        _JOB.reset(token)
        _remove(f"{_own_folder(spark)}/{name}")


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several later steps read one expensive result: lineage ends at files
    that outlive any executor, and the reader knows their true size, so later joins
    are planned from sizes instead of guesses. Texts and hexadecimal digests take about half
    the disk with ``zstd``.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Largest list, in bytes of its key, that is sent to every task.
MAX_BROADCAST = 8 * 1024 * 1024


def fits_in_broadcast(listed: DataFrame, key: str) -> bool:
    """True when the measured size of ``listed`` allows to send it to every task.

    Runs one small aggregate, so ``listed`` should be a written table or cheap to compute.
    """
    row_overhead = 32
    measured = listed.agg(F.sum(F.octet_length(key) + row_overhead).alias("bytes"))
    return (measured.first()["bytes"] or 0) <= MAX_BROADCAST


def drop_staged(spark: SparkSession) -> None:
    """Remove this application's staged tables. Call when no result that reads them is left."""
    _remove(_own_folder(spark))


def _remove(folder: str) -> None:
    where, path = (
        fs.FileSystem.from_uri(folder) if ":" in folder.partition("/")[0] else (fs.LocalFileSystem(), folder)
    )
    if where.get_file_info(path).type == fs.FileType.Directory:
        where.delete_dir(path)
