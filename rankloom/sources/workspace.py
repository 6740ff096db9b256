"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: list[str] = []
_STAGED: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that setting is missing, a local folder of our own stands in if all tasks run on this
    machine; on a cluster, where they would not find it, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append("file://" + tempfile.mkdtemp(prefix="spark-rankloom-"))
    return _OWN_ROOT[0]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later steps neither repeat its work nor depend on the
    executors that did it."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    _STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession):
    """What is staged within goes at the end, and what a step has shuffled goes when the step is done, not when the driver happens to collect its garbage."""
    before, key = len(_STAGED), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if kept is None else spark.conf.set(key, kept)
        while len(_STAGED) > before:
            remove(spark, _STAGED.pop())


def _path(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    fs, own = _path(spark, path)
    return fs.exists(own)


def remove(spark: SparkSession, path: str) -> None:
    """A folder that is no longer needed, on whatever store it lies; none there is no error."""
    fs, own = _path(spark, path)
    fs.delete(own, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder; none if it isn't there."""
    fs, own = _path(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(own) if s.isDirectory()) if fs.exists(own) else []


def contents(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a folder from another: names, sizes and times in it, and the number and size of all files below."""
    fs, own = _path(spark, path)
    if not fs.exists(own):
        return ()
    below = fs.getContentSummary(own)
    return below.getFileCount(), below.getLength(), *sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(own))


def release(spark: SparkSession) -> int:
    """Removes all folders that this process has staged, once nothing that was made from them is needed any more; their number."""
    n = len(_STAGED)
    while _STAGED:
        remove(spark, _STAGED.pop())
    return n
