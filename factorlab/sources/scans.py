"""Scans: typed reads with the column list and the cut-off pushed into the file scan."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.sources import schemas


def cutoff_filter(df: DataFrame, cutoff: date, column: str = "date") -> DataFrame:
    return df.filter(F.col(column) <= F.lit(cutoff))


def eval_window_filter(df: DataFrame, start: date, column: str = "month") -> DataFrame:
    return df.filter(F.col(column) >= F.lit(start))


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Read parquet, CSV (with header) or JSON with a declared schema, projected to it."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "false")
    return reader.format(fmt).load(path)


def scan_prices(spark, path: str, cutoff: date, fmt: str = "parquet") -> DataFrame:
    return cutoff_filter(read_table(spark, path, schemas.PRICES, fmt), cutoff)


def scan_daily_metrics(spark, path: str, cutoff: date, fmt: str = "parquet") -> DataFrame:
    return cutoff_filter(read_table(spark, path, schemas.DAILY_METRICS, fmt), cutoff)


def scan_statements(spark, path: str, cutoff: date, fmt: str = "parquet") -> DataFrame:
    return cutoff_filter(read_table(spark, path, schemas.STATEMENTS, fmt), cutoff, "date_available")


def scan_constituents(spark, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.CONSTITUENTS, fmt)


def normalise_index_columns(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Vendor column names to the seven index columns; a missing adj_close becomes close."""
    wanted = ["date", "open", "high", "low", "close", "adj_close", "volume"]
    source = {new: old for old, new in (rename or {}).items()}
    available = {c.lower().replace(" ", "_"): c for c in df.columns}

    def pick(name: str) -> Column:
        col = source.get(name) or available.get(name)
        if col is None and name == "adj_close":
            return pick("close")
        return F.col(f"`{col}`")

    out = df.select(*[pick(n).alias(n) for n in wanted])
    return out.withColumn("adj_close", F.coalesce("adj_close", "close"))


def scan_index(spark, path: str, cutoff: date, fmt: str = "parquet") -> DataFrame:
    """Index bars up to the cut-off; the job fails should any later row get through."""
    return assert_no_rows_after(cutoff_filter(normalise_index_columns(read_table(spark, path, schemas.INDEX_DAILY, fmt)), cutoff), cutoff)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def scan_panel_checkpoint(spark, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Read the processed tables, naming every missing one in a single error."""
    missing = [f"{name} ({p})" for name, p in paths.items() if not _exists(spark, p)]
    if missing:
        raise FileNotFoundError("Missing processed tables: " + ", ".join(sorted(missing)))
    return {name: spark.read.parquet(p) for name, p in paths.items()}


def scan_curves(spark, paths: dict[str, str], schema: str = schemas.CURVE, fmt: str = "parquet") -> DataFrame:
    """Stack per-strategy curve files under a strategy label; absent files are skipped."""
    parts = [
        read_table(spark, p, schema, fmt).withColumn("strategy", F.lit(label))
        for label, p in paths.items()
        if _exists(spark, p)
    ]
    if not parts:
        raise FileNotFoundError("No strategy curves found")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def assert_no_rows_after(df: DataFrame, cutoff: date, column: str = "date") -> DataFrame:
    """Fail the job when a row lies after the cut-off; otherwise pass rows through."""
    ok = F.coalesce(F.col(column) <= F.lit(cutoff), F.lit(True))
    guard = F.assert_true(ok, F.lit(f"{column} after cut-off {cutoff}"))
    return df.filter(guard.isNull())


__all__ = [
    "assert_no_rows_after",
    "cutoff_filter",
    "eval_window_filter",
    "normalise_index_columns",
    "read_table",
    "scan_constituents",
    "scan_curves",
    "scan_daily_metrics",
    "scan_index",
    "scan_panel_checkpoint",
    "scan_prices",
    "scan_statements",
]
