"""Written intermediate tables in the folder that the cluster shares.

A written table cuts lineage and survives a lost executor: the tasks that read it need no earlier task again.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_held: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or its context's checkpoint folder; a folder of this machine only where
    both are unset and the master is this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="topicloom-"))
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@atexit.register
def _drop_all() -> None:
    """Deletes what the results of this process were read from."""
    for root, spark in _held.items():
        try:
            if not spark._jsc.sc().isStopped():
                _delete(spark, root)
        except Exception:  # the session is gone
            pass


class Scratch:
    """Tables of one run of an operator, each in its own folder under ``shared_dir``; what is not dropped before goes
    when the process ends."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/topicloom/{tag}-{uuid.uuid4().hex}"
        _held[self.root] = spark

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str, compression: str = "zstd", rows: int = 0) -> DataFrame:
        """Writes df and reads it again. Of large rows a file may have so many (0: any number), for readers hold a file's
        rows at once, up to some thousands."""
        df.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", rows).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; without names, all."""
        for path in [self.path(n) for n in names] or [self.root]:
            _delete(self.spark, path)


#: Rows of a narrow table that may be broadcast.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; df should be a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
