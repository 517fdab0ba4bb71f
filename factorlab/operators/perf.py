"""Performance analytics over return curves keyed by run and ordered by period."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlab.config import EngineConfig
from factorlab.functions.nulls import finite, ratio
from factorlab.functions.stats import student_two_sided_p


def _w(keys: list[str], order: str):
    # A run has one row per period, so the calendar bounds the partition.
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def wealth_curve(
    df: DataFrame, keys: list[str], ret: str = "portfolio_return", order: str = "month", start: float = 1.0
) -> DataFrame:
    return df.withColumn("wealth", F.lit(start) * F.product(1 + F.col(ret)).over(_w(keys, order)))


def drawdown(df: DataFrame, keys: list[str], level: str = "wealth", order: str = "month") -> DataFrame:
    return df.withColumn("drawdown", ratio(F.col(level), F.max(level).over(_w(keys, order))) - 1)


def sharpe(ret: str | Column, periods: int = 12) -> Column:
    return ratio(F.avg(ret), F.stddev_samp(ret)) * math.sqrt(periods)


def ttest_1samp(ret: str) -> Column:
    return F.when(F.count(ret) > 2, ratio(F.avg(ret), F.stddev_samp(ret) / F.sqrt(F.count(ret))))


def perf_metrics(
    df: DataFrame, keys: list[str], ret: str = "portfolio_return", order: str = "month", periods: int = 12, p_value: bool = True
) -> DataFrame:
    """One metrics row per key: a window stage for wealth and drawdown, then one aggregate."""
    clean = df.withColumn(ret, finite(ret)).filter(F.col(ret).isNotNull())
    path = drawdown(wealth_curve(clean, keys, ret, order), keys, order=order)
    out = path.groupBy(*keys).agg(
        F.count(ret).alias("n_periods"),
        F.avg(ret).alias("avg_period_return"),
        F.stddev_samp(ret).alias("period_volatility"),
        (F.avg(ret) * periods).alias("annualized_return_approx"),
        (F.stddev_samp(ret) * math.sqrt(periods)).alias("annualized_volatility"),
        sharpe(ret, periods).alias("annualized_sharpe"),
        ttest_1samp(ret).alias("t_stat"),
        (F.product(1 + F.col(ret)) - 1).alias("cumulative_return"),
        F.min("drawdown").alias("max_drawdown"),
        F.max(ret).alias("best_month"),
        F.min(ret).alias("worst_month"),
        F.min(order).alias("first_period"),
        F.max(order).alias("last_period"),
    )
    if not p_value:
        return out
    return out.withColumn("p_value", student_two_sided_p(F.col("t_stat"), F.col("n_periods") - 1))


def eval_metrics(
    df: DataFrame, keys: list[str], start: date, cash: float, ret: str = "portfolio_return", order: str = "month",
    periods: int = 12, p_value: bool = True,
) -> DataFrame:
    """Metrics from the evaluation start, with final equity restated from fresh cash."""
    window = df.filter(F.col(order) >= F.lit(start))
    out = perf_metrics(window, keys, ret, order, periods, p_value)
    return out.withColumn("final_equity", F.lit(cash) * (1 + F.col("cumulative_return"))).withColumn(
        "total_return", F.col("cumulative_return")
    )


def avg_positions(curves: DataFrame, keys: list[str], start: date) -> DataFrame:
    return curves.filter(F.col("month") >= F.lit(start)).groupBy(*keys).agg(F.avg("n_positions").alias("avg_positions"))


def strategy_metrics_table(curves: DataFrame, cfg: EngineConfig, keys=("strategy",), p_value: bool = True) -> DataFrame:
    keys = list(keys)
    return eval_metrics(curves, keys, cfg.evaluation_start, cfg.initial_cash, p_value=p_value).join(
        avg_positions(curves, keys, cfg.evaluation_start), keys, "left"
    )


def with_segments(curves: DataFrame, cfg: EngineConfig, full: bool = False) -> DataFrame:
    """Tag evaluation-window rows train or test; with ``full`` each row also counts in full."""
    inside = curves.filter(F.col("month") >= F.lit(cfg.evaluation_start))
    half = F.when(F.col("month") <= F.lit(cfg.train_end), "train").otherwise("test")
    if full:
        return inside.withColumn("segment", F.explode(F.array(F.lit("full"), half)))
    return inside.withColumn("segment", half)


def walk_forward(curves: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Train and test statistics per strategy and a flag on the best train Sharpe."""
    m = perf_metrics(with_segments(curves, cfg), ["strategy", "segment"], p_value=False)

    def pick(seg: str, c: str) -> Column:
        return F.max(F.when(F.col("segment") == seg, F.col(c)))

    wide = m.groupBy("strategy").agg(
        pick("train", "annualized_sharpe").alias("train_sharpe"),
        pick("test", "annualized_sharpe").alias("test_sharpe"),
        pick("test", "cumulative_return").alias("test_cumulative_return"),
        pick("test", "max_drawdown").alias("test_max_drawdown"),
        F.countDistinct("segment").alias("_n"),
    ).filter("_n = 2").drop("_n")
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("train_sharpe"), "strategy")  # one row per strategy
    return wide.withColumn("selected_by_train", F.row_number().over(best) == 1)


def train_test_full(curves: DataFrame, cfg: EngineConfig, keys=("strategy",)) -> DataFrame:
    """Sharpe, return, drawdown and positions on three overlapping samples."""
    keys = [*keys, "segment"]
    rows = with_segments(curves, cfg, full=True)
    m = perf_metrics(rows, keys, p_value=False)
    pos = rows.groupBy(*keys).agg(F.avg("n_positions").alias("avg_positions"))
    return m.join(pos, keys).select(
        *keys, "annualized_sharpe", F.col("cumulative_return").alias("total_return"), "max_drawdown", "avg_positions"
    ).withColumn("final_equity", F.lit(cfg.initial_cash) * (1 + F.col("total_return")))


def rolling_sharpe(df: DataFrame, keys: list[str], n: int = 12, periods: int = 12, ret: str = "portfolio_return") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("month").rowsBetween(1 - n, 0)
    sd = F.stddev_samp(ret).over(w)
    value = F.when((F.count(ret).over(w) == n) & (sd > 0), ratio(F.avg(ret).over(w), sd) * math.sqrt(periods))
    return df.withColumn("rolling_sharpe", value)


def rolling_positions(df: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("month").rowsBetween(1 - n, 0)
    return df.withColumn("rolling_positions", F.avg("n_positions").over(w))


def cumulative_excess(df: DataFrame, keys: list[str]) -> DataFrame:
    """Geometric and arithmetic accumulation of r - b."""
    w = _w(keys, "month")
    ex = F.col("portfolio_return") - F.col("benchmark_return")
    return df.withColumn("cum_excess_geometric", F.product(1 + ex).over(w) - 1).withColumn(
        "cum_excess_arithmetic", F.sum(ex).over(w)
    )


def edge_accumulation(pair: DataFrame) -> DataFrame:
    diff = F.col("portfolio_return_a") - F.col("portfolio_return_b")
    w = Window.partitionBy(F.lit(0)).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)  # one row per month
    return pair.withColumn("diff", diff).withColumn("cum_diff", F.sum("diff").over(w))


def calendar_year_return(df: DataFrame, keys: list[str], ret: str = "portfolio_return") -> DataFrame:
    return df.groupBy(*keys, F.year("month").alias("year")).agg((F.product(1 + F.col(ret)) - 1).alias("annual_return"))


def cost_drag_pp(curves: DataFrame) -> DataFrame:
    """Calendar-year return lost to central costs, in percentage points."""
    y = calendar_year_return(curves, ["strategy", "scenario"])

    def pick(s: str) -> Column:
        return F.max(F.when(F.col("scenario") == s, F.col("annual_return")))

    return (
        y.groupBy("strategy", "year")
        .agg(((pick("zero") - pick("central")) * 100).alias("drag_pp"))
        .filter(F.col("drag_pp").isNotNull())
    )


def yearly_cost_drag(curves: DataFrame) -> DataFrame:
    out = (
        curves.withColumn("year", F.year("month"))
        .groupBy("strategy", "scenario", "year")
        .agg(
            F.sum("cost_dollars").alias("cost_dollars"),
            F.sum("pnl").alias("pnl"),
            F.sum(F.col("pnl") + F.col("cost_dollars")).alias("gross_pnl"),
            F.avg("prev_equity").alias("avg_equity_start"),
            F.avg("round_trip_bps").alias("avg_round_trip_bps"),
            F.avg("n_positions").alias("avg_positions"),
        )
    )
    return out.withColumn("cost_drag_pct_of_avg_equity", ratio("cost_dollars", "avg_equity_start"))


def hit_rate(df: DataFrame, keys: list[str], ret: str = "portfolio_return") -> DataFrame:
    r = F.col(ret)
    return df.filter(r.isNotNull()).groupBy(*keys).agg(
        F.count(ret).alias("n_months"),
        (F.avg(F.when(r > 0, 1.0).otherwise(0.0)) * 100).alias("hit_rate_pct"),
        (F.avg(F.when(r > 0, r)) * 100).alias("avg_up_month_pct"),
        (F.avg(F.when(r < 0, r)) * 100).alias("avg_down_month_pct"),
        (F.max(r) * 100).alias("best_month_pct"),
        (F.min(r) * 100).alias("worst_month_pct"),
    )


def tail_risk(df: DataFrame, keys: list[str], ret: str = "portfolio_return", min_rows: int = 12) -> DataFrame:
    """Sortino and Calmar ratios beside the maximum drawdown."""
    path = drawdown(wealth_curve(df.filter(F.col(ret).isNotNull()), keys, ret), keys)
    r = F.col(ret)
    out = path.groupBy(*keys).agg(
        F.count(ret).alias("_n"),
        (F.avg(r) * 12).alias("annualized_return_approx"),
        F.stddev_samp(F.when(r < 0, r)).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
    ).filter(F.col("_n") >= min_rows)
    return out.select(
        *keys,
        "annualized_return_approx",
        ratio(F.col("annualized_return_approx"), F.col("_down") * math.sqrt(12)).alias("sortino_ratio"),
        ratio(F.col("annualized_return_approx"), F.abs("max_drawdown")).alias("calmar_ratio"),
        "max_drawdown",
    )


def hhi(df: DataFrame) -> DataFrame:
    return df.withColumn("hhi", ratio(F.lit(1.0), F.col("n_positions").cast("double")))


def best_worst_k(df: DataFrame, keys: list[str], k: int = 5, ret: str = "portfolio_return") -> DataFrame:
    rows = df.filter(F.col(ret).isNotNull())

    def side(kind: str, order) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order, "month")
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
            *keys, F.lit(kind).alias("type"), "rank", "month", (F.col(ret) * 100).alias("return_pct")
        )

    return side("best", F.desc(ret)).unionByName(side("worst", F.asc(ret)))


def regime_diagnostics(exposure: DataFrame) -> DataFrame:
    """Seven scalar diagnostics in long form from one conditional aggregate."""
    on = F.coalesce("regime_on", F.lit(False))
    wide = exposure.agg(
        F.count("*").cast("double").alias("total_months"),
        F.count_if(on).cast("double").alias("regime_on_months"),
        F.count_if(~on).cast("double").alias("regime_off_months"),
        F.count_if("invested").cast("double").alias("invested_months"),
        F.count_if(~F.col("invested")).cast("double").alias("cash_months"),
        F.avg(F.when(on, F.col("portfolio_return"))).alias("avg_return_when_regime_on"),
        F.avg(F.when(~on, F.col("portfolio_return"))).alias("avg_return_when_regime_off"),
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in wide.columns])
    return wide.select(F.inline(pairs))


def regime_out_share(exposure: DataFrame, start: date) -> DataFrame:
    out = F.count_if(~F.coalesce("regime_on", F.lit(False)))
    return exposure.filter(F.col("month") >= F.lit(start)).agg(
        out.alias("months_out"), F.count("*").alias("months"), ratio(out * 100.0, F.count("*")).alias("out_pct")
    )


def pivot_year_month(curves: DataFrame, value: str = "portfolio_return") -> DataFrame:
    rows = curves.select("strategy", F.year("month").alias("year"), F.month("month").alias("_m"), value)
    wide = rows.groupBy("strategy", "year").pivot("_m", list(range(1, 13))).agg(F.avg(value))
    return wide.select("strategy", "year", *[F.col(str(i)).alias(f"m{i:02d}") for i in range(1, 13)])


def improvement_deltas(metrics: DataFrame, ladder: list[str]) -> DataFrame:
    """Sharpe change against the previous rung of the ladder."""
    position = F.array_position(F.array(*[F.lit(s) for s in ladder]), F.col("strategy"))
    w = Window.partitionBy(F.lit(0)).orderBy("rung")  # one row per strategy
    return (
        metrics.withColumn("rung", position)
        .filter("rung > 0")
        .select("strategy", "rung", "annualized_sharpe")
        .withColumn("sharpe_delta", F.col("annualized_sharpe") - F.lag("annualized_sharpe").over(w))
    )
