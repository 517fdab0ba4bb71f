"""Materialised intermediate tables in the shared folder of the cluster.

A written table cuts lineage, survives executor loss and keeps column pruning,
which an in-memory copy does not. The folder is the one the session names in
``spark.checkpoint.dir``. A session on one machine that names none gets a fresh
local folder; on a cluster that is an error, for executors would not see it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}
#: While a table is written: its shuffle files go when the job ends, for the table stands in for them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="spark-factorlab-")
        spark.sparkContext.setCheckpointDir(_LOCAL_FALLBACK[app])
    return _LOCAL_FALLBACK[app]


class Workspace:
    """Names tables under one run folder of the shared checkpoint location."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/factorlab/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def clear(self) -> None:
        """Remove this run's tables, and only those, once its results are written elsewhere."""
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)

    def materialise(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = self.path(name)
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)
