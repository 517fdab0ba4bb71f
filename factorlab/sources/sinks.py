"""Sinks: tables, per-strategy partitions and the portfolio state document."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.sources import schemas
from factorlab.sources.scans import _exists


def sink_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
    return path


def sink_by_strategy(df: DataFrame, path: str, column: str = "strategy") -> str:
    """One folder per strategy. Strategies are few, so partition folders stay few."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)
    return path


class StateConflict(RuntimeError):
    """Somebody else has written, or is writing, the version that was to follow."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _version_path(path: str, version: int) -> str:
    return f"{path}/versions/{version:010d}"


def _claim(spark: SparkSession, path: str, version: int) -> bool:
    """Create the version's claim; false if it has one already."""
    where, fs = _files(spark, f"{path}/claims/{version:010d}")
    try:
        return fs.createNewFile(where)
    except Py4JJavaError as e:
        if fs.exists(where):
            return False
        raise e


def _numbers(spark: SparkSession, path: str) -> list[int]:
    where, fs = _files(spark, path)
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(where)) if fs.exists(where) else []


def state_version(spark: SparkSession, path: str) -> int:
    """Number of the newest complete version; 0 where there is none. A version is complete once Spark has marked it so."""
    for version in reversed(_numbers(spark, f"{path}/versions")):
        if _exists(spark, f"{_version_path(path, version)}/_SUCCESS"):
            return version
    return 0


def write_state(holdings: DataFrame, path: str, last_rebalance: str, base: int | None = None, take_over: bool = False) -> str:
    """``holdings`` (strategy, ticker) to one JSON document of strategy -> holdings, as a new version of ``path``.

    A portfolio holds at most top_n names per strategy, so the document is small
    by construction and may be folded into a single row.

    Versions are never changed. A writer claims the number after ``base``, the version it
    started from (the newest by default), and is refused if that is claimed already. A write
    that fails gives its claim back; readers see the version before until the new one is whole.
    ``take_over`` passes over claims whose writers died.
    """
    spark = holdings.sparkSession
    version = (state_version(spark, path) if base is None else base) + 1
    if base is not None and state_version(spark, path) != base:
        raise StateConflict(f"{path}: version {base} is no longer the newest")
    while not _claim(spark, path, version):
        if not take_over:
            raise StateConflict(f"{path}: version {version} is being written")
        version += 1
    state = (
        holdings.groupBy("strategy")
        .agg(F.array_sort(F.collect_set("ticker")).alias("holdings"))
        .groupBy()
        .agg(
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct("strategy", F.struct("holdings").alias("value"))))
            ).alias("strategies")
        )
        .select(F.lit(last_rebalance).alias("last_rebalance"), "strategies")
    )
    try:
        state.write.mode("errorifexists").json(_version_path(path, version))
    except Exception:
        for left in (_version_path(path, version), f"{path}/claims/{version:010d}"):
            where, fs = _files(spark, left)
            fs.delete(where, True)
        raise
    return path


def read_state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """State document as (last_rebalance, strategy, ticker), by default the newest; empty when absent."""
    version = state_version(spark, path) if version is None else version
    if not version:
        return spark.createDataFrame([], "last_rebalance string, strategy string, ticker string")
    doc = spark.read.schema(schemas.STATE).json(_version_path(path, version))
    return doc.select("last_rebalance", F.explode("strategies").alias("strategy", "value")).select(
        "last_rebalance", "strategy", F.explode("value.holdings").alias("ticker")
    )
