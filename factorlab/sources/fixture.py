"""Adapters from the TPC-H-like tables to the market-data schemas.

A supplier plays the part of a ticker, a line item that of a trade tick, and
nations and regions those of sectors and industry groups.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.config import EngineConfig
from factorlab.functions.nulls import ratio

# Test-scale parameters. The research defaults would leave the
# long windows and large cross-sections empty on these tables.
FIXTURE_CONFIG = EngineConfig(
    cutoff=date(2001, 10, 31),
    evaluation_start=date(1998, 1, 31),
    train_end=date(1999, 12, 31),
    ma_windows=(3, 5, 10, 20, 50, 100, 200),
    price_floor=110.0,
    min_names_zscore=25,
    min_names_fmp=50,
    min_names_multivariate=50,
    trend_min_obs=36,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ticks. ``ord`` packs (order, line) into one long, so first and
    last stay primitive-typed hash aggregates."""
    px = 100 + F.col("l_extendedprice") / 2500
    return _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        px.alias("px"),
        (px * (1 - F.col("l_discount"))).alias("apx"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("ext"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("ext_tax"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("ext_disc"),
    )


def prices(spark: SparkSession, sf_dir: str, cutoff: date | None = None, held: DataFrame | None = None) -> DataFrame:
    """Daily bars. One partial/final hash aggregate: a hot ticker shrinks to at most
    one row per trading day on the map side, before anything is shuffled.

    ``held`` restricts them to its tickers, whose number strategies and months bound: no other tick leaves its scan.
    """
    t = ticks(spark, sf_dir)
    if held is not None:
        t = t.join(F.broadcast(held.select("ticker").distinct()), "ticker", "left_semi")
    if cutoff is not None:
        t = t.filter(F.col("date") <= F.lit(cutoff))
    return t.groupBy("ticker", "date").agg(
        F.min_by("px", "ord").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "ord").alias("close"),
        F.sum("qty").alias("volume"),
        F.min_by("apx", "ord").alias("adjOpen"),
        F.max("apx").alias("adjHigh"),
        F.min("apx").alias("adjLow"),
        F.max_by("apx", "ord").alias("adjClose"),
        F.sum("qty").alias("adjVolume"),
    )


def daily_metrics(spark: SparkSession, sf_dir: str, cutoff: date | None = None) -> DataFrame:
    t = ticks(spark, sf_dir)
    if cutoff is not None:
        t = t.filter(F.col("date") <= F.lit(cutoff))
    day = t.groupBy("ticker", "date").agg(
        F.sum("ext").alias("e"), F.sum("ext_tax").alias("x"), F.sum("qty").alias("q")
    )
    return day.select("ticker", "date", *[c.alias(n) for n, c in _metrics("e", "x", "q").items()])


def market(spark: SparkSession, sf_dir: str, cutoff: date | None = None) -> DataFrame:
    """Daily bars beside their daily metrics, laid out by ticker.

    The ticks move once, as they are: a bar of one tick is wider than the tick. Everything by ticker that follows
    (bars, windows, months, as-of) keeps this layout. A ticker's ticks are folded into its bars as they stream in,
    so what a task holds is bounded by tickers and calendar.
    """
    raw = _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.col("l_extendedprice").alias("ext"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("qty"),
    )
    if cutoff is not None:
        raw = raw.filter(F.col("date") <= F.lit(cutoff))
    px = 100 + F.col("ext") / 2500
    t = raw.repartition("ticker").withColumns(
        {"px": px, "apx": px * (1 - F.col("discount")), "ext_tax": F.col("ext") * F.col("tax")}
    )
    day = t.groupBy("ticker", "date").agg(
        F.min_by("px", "ord").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "ord").alias("close"),
        F.sum("qty").alias("volume"),
        F.min_by("apx", "ord").alias("adjOpen"),
        F.max("apx").alias("adjHigh"),
        F.min("apx").alias("adjLow"),
        F.max_by("apx", "ord").alias("adjClose"),
        F.sum("ext").alias("_e"),
        F.sum("ext_tax").alias("_x"),
    )
    return day.withColumn("adjVolume", F.col("volume")).withColumns(_metrics("_e", "_x", "volume")).drop("_e", "_x")


def _metrics(value: str, taxed: str, quantity: str) -> dict[str, Column]:
    return {
        "marketCap": F.round(value, 2),
        "peRatio": F.round(ratio(value, taxed), 6),
        "pbRatio": F.round(ratio(value, quantity), 10),
        "trailingPEG1Y": F.lit(None).cast("double"),
    }


def statements(spark: SparkSession, sf_dir: str, cutoff: date | None = None) -> DataFrame:
    """Quarterly return-on-equity rows available 45 days after quarter end, plus an
    annual row (quarter 0) that shares the fourth quarter's availability date."""
    t = ticks(spark, sf_dir).select(
        "ticker", F.year("date").alias("fy"), F.quarter("date").alias("fq"), "ext", "ext_disc"
    )
    # One grouping-set aggregate yields quarters and years from a single shuffle.
    rows = t.groupingSets([["ticker", "fy", "fq"], ["ticker", "fy"]], "ticker", "fy", "fq").agg(
        F.sum("ext").alias("e"), F.sum("ext_disc").alias("d")
    )
    quarter = F.coalesce("fq", F.lit(4))
    available = F.date_add(F.last_day(F.make_date("fy", quarter * 3, F.lit(1))), 45)
    out = rows.select(
        "ticker",
        available.alias("date_available"),
        F.col("fy").alias("fiscal_year"),
        F.coalesce("fq", F.lit(0)).alias("fiscal_quarter"),
        F.lit("overview").alias("statement_type"),
        F.lit("roe").alias("data_code"),
        F.round(ratio("d", "e"), 8).alias("value"),
    )
    return out if cutoff is None else out.filter(F.col("date_available") <= F.lit(cutoff))


def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Nations and regions are fixed reference tables (25 and 5 rows at every scale).
    nation = _table(spark, sf_dir, "nation").join(
        F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        _table(spark, sf_dir, "supplier")
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("Symbol"),
            F.col("s_name").alias("Security"),
            F.col("n_name").alias("sector"),
            F.col("r_name").alias("sub_industry"),
        )
    )


def index_daily(spark: SparkSession, sf_dir: str, cutoff: date | None = None) -> DataFrame:
    return index_of(prices(spark, sf_dir, cutoff))


def index_of(bars: DataFrame) -> DataFrame:
    """Equal-weight index of all bars. Prices are summed as exact integers (1e-8
    units), so the level is independent of how rows were partitioned."""

    def level(c: str):
        units = F.round(F.col(c) * 1e8).cast("long")
        return F.sum(units) / F.count(units) / 1e8

    return bars.groupBy("date").agg(
        level("open").alias("open"),
        level("high").alias("high"),
        level("low").alias("low"),
        level("close").alias("close"),
        level("adjClose").alias("adj_close"),
        F.sum("volume").alias("volume"),
    )
