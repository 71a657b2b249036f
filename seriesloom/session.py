"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import partial
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CHECKPOINT_SETTING = "spark.checkpoint.dir"
FOLDER_SETTING = "spark.seriesloom.dir"


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC time and adaptive execution; everything else is the cluster's choice."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    merged = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **settings,
    }
    for name, value in merged.items():
        builder = builder.config(name, value)
    return use_utc(builder.getOrCreate())


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC, so that casts between the two timestamp types are exact."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    What ``spark.checkpoint.dir`` names, else what ``spark.seriesloom.dir`` names. Without
    either only a local master gets a new folder of its own, as in tests; a cluster is refused,
    because its executors would each write to their own disk.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get(CHECKPOINT_SETTING) or spark.conf.get(FOLDER_SETTING, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {CHECKPOINT_SETTING} or {FOLDER_SETTING} to a folder all executors share")
    if not getattr(spark, "_seriesloom_dir", None):
        spark._seriesloom_dir = tempfile.mkdtemp(prefix="seriesloom-")
        spark.sparkContext.setCheckpointDir(spark._seriesloom_dir)
    return spark._seriesloom_dir


def use_checkpoints(spark: SparkSession) -> None:
    """Name the shared folder to what cuts its lineage by itself, as boosting does."""
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


def together(
    spark: SparkSession, tasks: Sequence[Callable[[], T]], label: str, at_once: int | None = None
) -> list[T]:
    """Results of tasks that run jobs, each submitted from a thread of its own, in their order.

    Meant for a few tasks whose jobs are too short to fill the cluster. The threads have the
    caller's job properties and a scheduler pool each: with ``spark.scheduler.mode=FAIR`` they
    share the executors evenly, else in the order of their jobs. A failed task is raised when
    those that had begun have ended; no other is begun.
    """
    failed = threading.Event()

    def run(number: int) -> T | None:
        if failed.is_set():
            return None
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{label}-{number}")
        try:
            return tasks[number]()
        except BaseException:
            failed.set()
            raise
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(at_once or max(1, len(tasks))) as threads:
        futures = [threads.submit(inheritable_thread_target(spark)(partial(run, i))) for i in range(len(tasks))]
    return [f.result() for f in futures]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_writes: dict[SparkSession, tuple[int, str]] = {}
_writes_lock = threading.Lock()


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes begun in this block drop their shuffle files at their end, when nothing needs them.

    Blocks of several threads may overlap; the last one restores the session's own setting.
    """
    with _writes_lock:
        count, own = _writes.get(spark, (0, spark.conf.get(CLEANUP_SETTING, "false")))
        _writes[spark] = count + 1, own
        spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        with _writes_lock:
            count, own = _writes.pop(spark)
            if count > 1:
                _writes[spark] = count - 1, own
            else:
                spark.conf.set(CLEANUP_SETTING, own)


def written(df, label: str):
    """Write ``df`` once below the shared folder and read it back.

    Runs a job. Cuts the lineage with files that outlive any executor.
    """
    path = fresh_path(df.sparkSession, label)
    with _freeing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made, wherever its file system is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[Callable]:
    """A ``written`` whose tables are deleted at the end of the block."""
    made: list[str] = []

    def write(df, label: str):
        path = fresh_path(spark, label)
        made.append(path)
        with _freeing_shuffles(spark):
            df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield write
    finally:
        for path in made:
            delete_path(spark, path)
