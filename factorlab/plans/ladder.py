"""Strategy runs: ladders, grids and cost scenarios, each as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.config import COST_SCENARIOS, FACTORS, EngineConfig, StrategySpec
from factorlab.operators import perf, portfolio, scoring, tables, xsection
from factorlab.sources.workspace import Workspace


def ic_for_trend(panel: DataFrame, trend_col: str, cfg: EngineConfig, ws: Workspace) -> DataFrame:
    """Rank IC per (month, factor) with the given trend column in the trend role."""
    factors = {f: (trend_col if f == "trend" else f"{f}_z") for f in FACTORS}
    long = xsection.factor_long(panel, factors, cfg.min_names_fmp)
    return xsection.information_coefficients(long, ws)


def months_of(panel: DataFrame) -> DataFrame:
    return portfolio.regime_by_month(panel)


def run_specs(
    panel: DataFrame,
    specs: list[StrategySpec],
    cfg: EngineConfig,
    ws: Workspace,
    scenarios: list[str] | None = None,
    ic_tables: dict[str, DataFrame] | None = None,
):
    """(curves, picks) of every spec under every cost scenario.

    The panel is scored once per distinct score and cut to top_n picks before
    specs multiply the rows, so a grid of exits costs picks, not panels.
    """
    spark = panel.sparkSession
    months = months_of(panel)
    weights = {}
    for spec in specs:
        if spec.weighting.method == "rolling_rank_ic" and spec.score_variant not in weights:
            ic = (ic_tables or {}).get(spec.trend)
            if ic is None:
                ic = ws.materialise(ic_for_trend(panel, spec.trend, cfg, ws), "rank_ic")
            weights[spec.score_variant] = scoring.rolling_ic_weights(months.select("month"), ic, spec)
    scored = scoring.scores_by_variant(panel, specs, weights)
    picks = portfolio.topn_by_score(scored, ["variant", "month"], max(s.top_n for s in specs))
    picks = ws.materialise(picks, "picks")
    scenarios = scenarios or ["zero"]
    costs = portfolio.monthly_costs(months, portfolio.cost_schedule(spark), scenarios)
    return portfolio.vector_backtest(picks, specs, scenarios, months, costs, cfg)


def run_ladder(panel: DataFrame, specs: list[StrategySpec], cfg: EngineConfig, ws: Workspace, ic_tables=None):
    """Curves, picks and the metrics table beside the experiment log."""
    curves, real = run_specs(panel, specs, cfg, ws, ic_tables=ic_tables)
    curves = ws.materialise(curves, "ladder_curves")
    metrics = perf.strategy_metrics_table(curves, cfg)
    from factorlab.config import specs_frame

    return curves, real, tables.metrics_enrich(metrics, specs_frame(panel.sparkSession, specs))


def stop_take_grid(curves: DataFrame, specs: list[StrategySpec], cfg: EngineConfig) -> DataFrame:
    """Full, train and test metrics of every grid cell, one row per cell."""
    spark = curves.sparkSession
    m = perf.train_test_full(curves, cfg)

    def pick(seg: str, c: str):
        return F.max(F.when(F.col("segment") == seg, F.col(c)))

    wide = m.groupBy("strategy").agg(
        pick("full", "annualized_sharpe").alias("full_sharpe"),
        pick("full", "final_equity").alias("full_final_equity"),
        pick("full", "max_drawdown").alias("full_max_drawdown"),
        pick("train", "annualized_sharpe").alias("train_sharpe"),
        pick("train", "total_return").alias("train_total_return"),
        pick("train", "max_drawdown").alias("train_max_drawdown"),
        pick("test", "annualized_sharpe").alias("test_sharpe"),
        pick("test", "total_return").alias("test_total_return"),
        pick("test", "max_drawdown").alias("test_max_drawdown"),
        pick("test", "avg_positions").alias("test_avg_positions"),
    )
    levels = spark.createDataFrame(
        [(s.name, s.exits.stop, s.exits.take) for s in specs], "strategy string, stop_loss double, take_profit double"
    )
    grid = wide.join(F.broadcast(levels), "strategy")  # literal table of the grid
    grid = tables.ordinal_index(grid, "stop_loss", sorted({s.exits.stop for s in specs}), "stop_idx")
    return tables.ordinal_index(grid, "take_profit", sorted({s.exits.take for s in specs}), "take_idx")


def cost_scenario_grid(curves: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Metrics per strategy and cost scenario with the Sharpe lost against zero cost."""
    keys = ["strategy", "scenario"]
    m = perf.eval_metrics(curves, keys, cfg.evaluation_start, cfg.initial_cash, p_value=False)
    costs = (
        curves.filter(F.col("month") >= F.lit(cfg.evaluation_start))
        .groupBy(*keys)
        .agg(
            F.sum("cost_dollars").alias("total_cost_dollars"),
            F.avg(F.when(F.col("round_trip_bps") != 0, F.col("round_trip_bps"))).alias("avg_round_trip_bps"),
        )
    )
    zero = m.filter(F.col("scenario") == "zero").select("strategy", F.col("annualized_sharpe").alias("_zero"))
    drop = F.when(F.col("scenario") != "zero", F.col("_zero") - F.col("annualized_sharpe"))
    return (
        m.join(costs, keys)
        .join(zero, "strategy", "left")
        .select(
            *keys, "annualized_sharpe", "annualized_return_approx", "annualized_volatility", "max_drawdown",
            "cumulative_return", "final_equity", "total_cost_dollars", "avg_round_trip_bps",
            drop.alias("sharpe_drop_vs_zero"),
        )
    )


def fmp_summary(portfolio_fmp: DataFrame, regression_fmp: DataFrame, ic: DataFrame | None) -> DataFrame:
    """Performance of both factor-portfolio constructions per factor, with IC."""
    both = portfolio_fmp.select(
        F.lit("portfolio_sort").alias("approach"), "factor", "month", F.col("portfolio_fmp_return").alias("r")
    ).unionByName(
        regression_fmp.select(
            F.lit("cross_sectional_regression").alias("approach"), "factor", "month", F.col("regression_fmp_return").alias("r")
        )
    )
    out = perf.perf_metrics(both, ["approach", "factor"], "r")
    return out if ic is None else out.join(F.broadcast(xsection.ic_summary(ic)), "factor", "left")


def fmp_common_start(portfolio_fmp: DataFrame, regression_fmp: DataFrame) -> DataFrame:
    parts = []
    for approach, df, col in (
        ("portfolio_sort", portfolio_fmp, "portfolio_fmp_return"),
        ("regression", regression_fmp, "regression_fmp_return"),
    ):
        rows = xsection.common_start_filter(df.select("factor", "month", F.col(col).alias("r")))
        m = perf.perf_metrics(rows, ["factor", "common_start"], "r")
        parts.append(m.withColumn("approach", F.lit(approach)))
    return tables.union_runs(*parts)


SCENARIOS = list(COST_SCENARIOS)
