"""Session helpers: shared-folder materialisation that survives executor loss, table loading."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's checkpoint folder. Only where both are unset and the
    master is local (tests) a folder of this machine; on a cluster that is an error, as executors would each write to their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        already = spark.sparkContext.getCheckpointDir()
        if not already and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = already or "file://" + tempfile.mkdtemp(prefix="paperloom-")
        if not already:
            spark.sparkContext.setCheckpointDir(folder)
    return folder


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended already; the folder is scratch space
        pass


@atexit.register
def _drop_all() -> None:
    for spark, path in _TABLES:
        if path.startswith("file://"):
            import shutil

            shutil.rmtree(path[len("file://") :], ignore_errors=True)
        else:
            _drop(spark, path)


class Scratch:
    """Written tables of one operator, in the shared folder.

    Iterative operators write each step and read it back: the lineage is cut, a lost executor costs
    only its running tasks, and the next plan sees true sizes. ``free`` drops a step no longer read;
    what the result still reads goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/paperloom/{name}-{uuid.uuid4().hex[:12]}"
        self.steps: set[str] = set()
        _TABLES.append((spark, self.root))

    def write(self, df: DataFrame, step: str, partition_by: str | None = None) -> str:
        path = f"{self.root}/{step}"
        self.steps.add(step)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        return path

    def save(self, df: DataFrame, step: str) -> DataFrame:
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df, step))

    def free(self, *steps: str) -> None:
        for step in steps:
            _drop(self.spark, f"{self.root}/{step}")
            self.steps.discard(step)

    def keep(self, *steps: str) -> None:
        self.free(*(self.steps - set(steps)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Tasks the cluster runs at once; the least number of partitions for CPU-heavy stages."""
    return max(1, spark.sparkContext.defaultParallelism)


def tables_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan, for checking a broadcast before asking for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit_rows: int = 200_000, row_bytes: int = 64) -> DataFrame:
    """Broadcast hint for a written table only while it has at most ``limit_rows`` rows (read from its footers) and, decoded, about
    ``row_bytes`` each; beyond it a shuffle join is planned. The hash table stays under some 30 MB, whatever the compression."""
    if tables_bytes(df) > limit_rows * row_bytes:
        return df
    return F.broadcast(df) if df.limit(limit_rows + 1).count() <= limit_rows else df


def struct_of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])
