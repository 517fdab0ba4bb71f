"""Daily bars to monthly bars, lags, leads, momentum and moving-average signals.

Windows are partitioned by ticker. Bars are unique per (ticker, date), so a
partition is bounded by the trading calendar whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlab.functions.nulls import _c, finite, gated_avg, masked_last, ratio

OHLC = ("open", "high", "low", "close")
VALUATION = {"marketCap": "market_cap", "peRatio": "pe_ratio", "pbRatio": "pb_ratio", "trailingPEG1Y": "trailing_peg_1y"}


def month_of(column: str = "date") -> Column:
    return F.last_day(column)


def valid_bar_filter(bars: DataFrame, columns=OHLC) -> DataFrame:
    """Drop bars with a missing or non-positive price."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.coalesce(F.col(c) > 0, F.lit(False))
    return bars.filter(keep)


def history_length(bars: DataFrame, key: str = "ticker") -> DataFrame:
    return bars.groupBy(key).agg(F.count("*").alias("n_bars"))


def min_history_filter(bars: DataFrame, need: int, key: str = "ticker") -> DataFrame:
    """Bars of the tickers with at least ``need`` bars."""
    n = F.count("*").over(Window.partitionBy(key))
    return bars.withColumn("_n", n).filter(F.col("_n") >= need).drop("_n")


def short_history(universe: DataFrame, bars: DataFrame, need: int, key: str = "ticker") -> DataFrame:
    """Requested tickers that are missing or have fewer than ``need`` bars."""
    enough = history_length(bars, key).filter(F.col("n_bars") >= need)
    return universe.select(key).distinct().join(enough, key, "left_anti")


def masked_first(value: str, order: str) -> Column:
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def _bar_aggregates() -> list[Column]:
    return [
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        masked_first("adjOpen", "date").alias("open"),
        F.max("adjHigh").alias("high"),
        F.min("adjLow").alias("low"),
        masked_last("adjClose", "date").alias("close"),
        masked_last("close", "date").alias("raw_close"),
        F.sum("adjVolume").alias("volume"),
    ]


def _last_valuation(fields: dict[str, str]) -> list[Column]:
    return [masked_last(src, "date").alias(dst) for src, dst in fields.items()]


def monthly_bars(prices: DataFrame) -> DataFrame:
    """Adjusted monthly OHLCV per ticker; first and last skip nulls."""
    return prices.withColumn("month", month_of()).groupBy("ticker", "month").agg(*_bar_aggregates())


def monthly_bars_with_signals(prices: DataFrame, windows, metrics: bool = False) -> DataFrame:
    """Monthly bars and month-end moving-average deviations in one pass, with the month's
    valuation fields where the bars carry them (``metrics``).

    The daily bars are scanned and shuffled by ticker once: that layout serves
    the signal windows, the monthly aggregate and the monthly lags that follow.
    """
    fields = VALUATION if metrics else {}
    need = ["ticker", "date", "adjOpen", "adjHigh", "adjLow", "adjClose", "close", "adjVolume", *fields]
    daily = with_deviations(prices.select(*need), windows, "adjClose")
    # Only the month-end row contributes a signal, so max picks that row's value.
    devs = [F.max(F.when(F.col("month_end"), F.col(f"ma_dev_{n}"))).alias(f"ma_dev_{n}") for n in windows]
    return daily.groupBy("ticker", "month").agg(*_bar_aggregates(), *devs, *_last_valuation(fields))


def _by_month(key: str = "ticker"):
    return Window.partitionBy(key).orderBy("month")


def prev_next_bars(monthly: DataFrame) -> DataFrame:
    """Previous close and next month's bar. Shifts count rows, not calendar months."""
    w = _by_month()
    return monthly.withColumns(
        {
            "prev_close": F.lag("close").over(w),
            **{f"next_{c}": F.lead(c).over(w) for c in OHLC},
        }
    )


def forward_returns(monthly: DataFrame) -> DataFrame:
    return monthly.withColumns(
        {
            "ret_1m_cc": ratio("close", "prev_close") - 1,
            "next_ret_cc": ratio("next_close", "close") - 1,
            "next_ret_oc": ratio("next_close", "next_open") - 1,
        }
    )


def momentum_k(monthly: DataFrame, k: int = 12, key: str = "ticker") -> DataFrame:
    past = F.lag("close", k).over(_by_month(key))
    return monthly.withColumn(f"momentum_{k}m", ratio(F.col("close"), past) - 1)


def price_floor_eligibility(monthly: DataFrame, floor: float) -> DataFrame:
    return monthly.withColumn("eligible_price", F.coalesce(F.col("raw_close") >= floor, F.lit(False)))


def stock_months(prices: DataFrame, cfg) -> DataFrame:
    """The full monthly stock table: bars, neighbours, returns, momentum, price floor."""
    return stock_features(monthly_bars(prices), cfg)


def stock_features(monthly: DataFrame, cfg) -> DataFrame:
    out = forward_returns(prev_next_bars(monthly))
    return price_floor_eligibility(momentum_k(out, cfg.momentum_lag), cfg.price_floor)


def index_monthly_bars(index: DataFrame) -> DataFrame:
    return (
        index.withColumn("month", month_of())
        .groupBy("month")
        .agg(
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            masked_first("open", "date").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            masked_last("adj_close", "date").alias("close"),
            F.sum("volume").alias("volume"),
        )
    )


def _series_window(df: DataFrame, order: str, series: str | None):
    # One index series is one row per calendar period, so even the single
    # unkeyed series is bounded by the calendar.
    return Window.partitionBy(series if series else F.lit(0)).orderBy(order)


def index_returns(index_monthly: DataFrame, series: str | None = None) -> DataFrame:
    w = _series_window(index_monthly, "month", series)
    return index_monthly.withColumns(
        {
            "ret_1m": ratio(F.col("close"), F.lag("close").over(w)) - 1,
            "next_ret": ratio(F.lead("close").over(w), F.col("close")) - 1,
        }
    )


def sma_regime(index_monthly: DataFrame, months: int = 10, series: str | None = None) -> DataFrame:
    """Trailing average and the flag close > average, False during warm-up."""
    w = _series_window(index_monthly, "month", series).rowsBetween(1 - months, 0)
    out = index_monthly.withColumn(f"sma_{months}m", gated_avg("close", w, months))
    return out.withColumn("regime_on", F.coalesce(F.col("close") > F.col(f"sma_{months}m"), F.lit(False)))


def index_months(index: DataFrame, cfg) -> DataFrame:
    return sma_regime(index_returns(index_monthly_bars(index)), cfg.sma_months)


def monthly_metrics(daily: DataFrame) -> DataFrame:
    """Last non-null valuation fields per (ticker, month)."""
    return daily.withColumn("month", month_of()).groupBy("ticker", "month").agg(*_last_valuation(VALUATION))


def live_month_close(prices: DataFrame, price: str = "adjClose") -> DataFrame:
    return (
        prices.withColumn("month", month_of()).groupBy("ticker", "month").agg(masked_last(price, "date").alias("close"))
    )


def month_end_row(bars: DataFrame, key: str = "ticker") -> DataFrame:
    """Last available bar of each (key, month)."""
    nxt = F.lead(month_of()).over(Window.partitionBy(key).orderBy("date"))
    out = bars.withColumn("month", month_of()).withColumn("_next_month", nxt)
    return out.filter(F.coalesce(F.col("_next_month") != F.col("month"), F.lit(True))).drop("_next_month")


def with_deviations(bars: DataFrame, windows, price: str, key: str | None = "ticker") -> DataFrame:
    """Bars with month, a month-end flag and moving-average deviations MA_w / price - 1.

    A moving sum is the difference of two running sums, so each window costs one
    lag per row instead of re-reading w rows; all windows share one exchange and
    one sort. A window is NULL until w non-null prices are inside it.
    """
    w = Window.partitionBy(F.col(key) if key else F.lit(0)).orderBy("date")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    month = month_of()
    # A running sum never recovers from a NaN, so missing prices are nulls before they are summed.
    clean = finite(price)
    base = bars.withColumns(
        {
            "month": month,
            "_sum": F.sum(clean).over(running),
            "_cnt": F.count(clean).over(running),
            "_next_month": F.lead(month).over(w),
        }
    ).withColumn("_sum", F.coalesce("_sum", F.lit(0.0)))
    sums = {f"_s{n}": F.col("_sum") - F.lag("_sum", n, 0.0).over(w) for n in windows}
    counts = {f"_c{n}": F.col("_cnt") - F.lag("_cnt", n, 0).over(w) for n in windows}
    devs = {
        f"ma_dev_{n}": F.when(F.col(f"_c{n}") == n, finite(ratio(F.col(f"_s{n}") / n, _c(price)) - 1)) for n in windows
    }
    return (
        base.withColumns({**sums, **counts})
        .withColumn("month_end", F.coalesce(F.col("_next_month") != F.col("month"), F.lit(True)))
        .select(*bars.columns, "month", "month_end", *[d.alias(n) for n, d in devs.items()])
    )


def ma_deviation(bars: DataFrame, windows, price: str, key: str | None = "ticker") -> DataFrame:
    """Month-end moving-average deviations for every window."""
    keep = [key] if key else []
    out = with_deviations(bars.select(*keep, "date", price), windows, price, key)
    return out.filter("month_end").select(*keep, "month", *[f"ma_dev_{n}" for n in windows])


def ma_deviation_latest(bars: DataFrame, windows, price: str) -> DataFrame:
    """The same signals for the last month of every ticker only.

    The longest window is all the history that they need: the rank limit drops older bars before the exchange.
    """
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    recent = bars.select("ticker", "date", price).withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= max(windows))
    out = with_deviations(recent, windows, price)
    return out.filter("_r = 1").select("ticker", "month", *[f"ma_dev_{n}" for n in windows])


def ma_ratio(signals: DataFrame, windows) -> DataFrame:
    keep = [c for c in signals.columns if not c.startswith("ma_dev_")]
    return signals.select(*keep, *[(F.col(f"ma_dev_{n}") + 1.0).alias(f"ma_ratio_{n}") for n in windows])
