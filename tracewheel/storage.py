"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of at most so many rows are broadcast; larger ones are joined by a salted shuffle.
SMALL_ROWS = 100_000
SALTS = 32

#: Application -> the folder of its tables, deleted when the process ends.
_FOLDERS: dict[str, str] = {}
#: Paths made inside each open ``scratch``.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a new local one if all of Spark is in this process.

    On a cluster without that setting there is no folder that all executors share: an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tracewheel-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_all(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        _delete(spark, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted with the innermost ``scratch``, or when the process ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_dir(spark)}/tracewheel-{app}"
        atexit.register(_delete_all, spark, _FOLDERS[app])
    path = f"{_FOLDERS[app]}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside are deleted at the end: read or write the result before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read back: the lineage ends here, and statistics are known.

    A lost executor costs at most the tasks that it ran.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_join(large: DataFrame, small: DataFrame, keys: list[str], also: Column | None = None) -> DataFrame:
    """Inner join on ``keys`` and ``also`` where one value of the keys may hold most of ``large``.

    ``small`` is broadcast if its rows are few. Beyond that each of its rows is copied to SALTS
    salts and the rows of ``large`` are dealt over them, so no key meets in one task.
    """
    if small.count() <= SMALL_ROWS:
        out = large.join(F.broadcast(small), keys)
    else:
        dealt = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(SALTS)).cast("int"))
        out = dealt.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"]).drop("_salt")
    return out if also is None else out.where(also)
