"""Tables that one job writes and later ones read, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary
    folder in local mode; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _OWN:
            folder = tempfile.mkdtemp(prefix="attesta-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _OWN[app] = "file://" + folder
        found = _OWN[app]
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there goes when the driver ends, or by `sweep`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    _MADE.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back: lineage ends here, and a
    lost executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attesta_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


def unstage(df: DataFrame) -> None:
    """Removes a staged table that nothing reads any more."""
    if getattr(df, "_attesta_path", None):
        remove(df.sparkSession, df._attesta_path)


def made() -> int:
    """How many tables are staged: a mark for `sweep`."""
    return len(_MADE)


def sweep(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Removes what was staged since the mark but for one table, which must not be read from the others."""
    for path in _MADE[mark:]:
        if path != getattr(keep, "_attesta_path", None):
            remove(spark, path)


#: Bytes of one side of a join up to which it is broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 64 << 20


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """The staged table marked for broadcast if its rows, counted, are within the bound."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
