"""Data audit and validation tables. Status is computed, never assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.config import EngineConfig


def audit_row(name: str, df: DataFrame, ticker: str | None, date_col: str | None, key: str) -> DataFrame:
    """Rows, exact distinct tickers, date range and nulls in the key column."""
    none_date = F.lit(None).cast("date")
    return df.agg(
        F.count("*").alias("rows"),
        (F.countDistinct(ticker) if ticker else F.lit(1).cast("long")).alias("tickers"),
        (F.min(date_col) if date_col else none_date).alias("min_date"),
        (F.max(date_col) if date_col else none_date).alias("max_date"),
        F.count_if(F.col(key).isNull()).alias("missing_key_value"),
    ).select(F.lit(name).alias("dataset"), "*")


def data_audit(prices, daily, statements, constituents, index, panel=None) -> DataFrame:
    parts = [
        audit_row("prices", prices, "ticker", "date", "adjClose"),
        audit_row("daily_fundamentals", daily, "ticker", "date", "peRatio"),
        audit_row("statements", statements, "ticker", "date_available", "value"),
        audit_row("constituents", constituents, "Symbol", None, "Symbol"),
        audit_row("index", index, None, "date", "adj_close"),
    ]
    if panel is not None:
        parts.append(audit_row("factor_panel", panel, "ticker", "month", "composite_score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _check(df: DataFrame, name: str, ok, detail) -> DataFrame:
    return df.agg(ok.alias("_ok"), detail.cast("string").alias("detail")).select(
        F.lit(name).alias("check"), F.when(F.coalesce("_ok", F.lit(False)), "OK").otherwise("FAIL").alias("status"), "detail"
    )


def run_validation(panel: DataFrame, prices: DataFrame, curves: DataFrame, trades: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row per check over the pipeline's products."""
    cutoff = F.lit(cfg.cutoff)
    parts = [
        _check(prices, "prices_within_cutoff", F.max("date") <= cutoff, F.max("date")),
        _check(panel, "panel_within_cutoff", F.max("month") <= cutoff, F.max("month")),
        _check(panel, "panel_not_empty", F.count("*") > 0, F.count("*")),
        _check(panel, "panel_keys_unique", F.count("*") == F.countDistinct("ticker", "month"), F.count("*")),
        _check(curves, "positions_non_negative", F.min("n_positions") >= 0, F.min("n_positions")),
        _check(trades, "long_only", F.min("shares") >= 0, F.min("shares")),
        _check(trades, "exits_after_entries", F.max(F.col("entry_date") <= F.col("exit_date")) & F.min(F.col("entry_date") <= F.col("exit_date")), F.count("*")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
