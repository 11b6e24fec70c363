"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a frontier (an id and a number) that are broadcast at most, and rows with all their columns.
FEW, FEW_WHOLE = 100_000, 10_000
#: Rows of the counted side of a join that one task takes.
TASK_ROWS = 200_000

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on one machine, as in tests, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='trellium-')}"
    return _LOCAL[app]


class Scratch:
    """Writes a frame as Parquet in the shared folder and reads it again.

    That cuts the lineage as checkpoint() does, survives lost executors, and is columnar. The tables go when the
    interpreter ends, or at drop().
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/trellium/{tag}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """free: the files that were shuffled for it go at once, not when the driver next collects its garbage."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_FREE, None)
        if free:
            self.spark.conf.set(_FREE, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            if free:
                self.spark.conf.unset(_FREE) if before is None else self.spark.conf.set(_FREE, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        try:
            self.drop()
        except Exception:  # the session may have ended already, and its folder with it
            pass


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and read again, so that loops over frames have short plans."""
    return Scratch(df.sparkSession, "step").save(df, "rows")


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df, computed once, and how many rows it has."""
    df = settled(df)
    return df, df.count()


def sized(df: DataFrame, count: int, key: str, few: int = FEW) -> DataFrame:
    """One side of a join on key, whose count rows were counted: broadcast if they are few, else dealt out for a merge.

    Left to itself Spark goes by the bytes of compressed files, and broadcasts millions of short rows; and it joins
    partitions until tasks have 64 MB of compressed rows, which are many times that when sorted.
    """
    if count <= few:
        return F.broadcast(df)
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK_ROWS)), key).hint("merge")
