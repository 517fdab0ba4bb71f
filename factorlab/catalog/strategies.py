"""Queries over strategies: backtests, trades, performance and robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorlab.catalog.context import CFG, Lab, all_specs, grid_specs, ladder_specs
from factorlab.catalog.registry import add
from factorlab.catalog.sql import EVAL, normal_p, perf_sql, student_p
from factorlab.config import STOP_LEVELS, TAKE_LEVELS, specs_frame
from factorlab.operators import audit, joins, perf, portfolio, regress, resample, scoring, tables, trades
from factorlab.plans import ladder
from factorlab.plans.ladder import SCENARIOS

CURVE = (
    "strategy month portfolio_return:7 pnl:2 equity:2 prev_equity:2 n_positions:i regime_on cost_dollars:3 "
    "commission_bps_per_side:4 slippage_bps_per_side:4 round_trip_bps:4 per_position_dollars:2 sizing_method"
)
PERF = (
    "n_periods:i avg_period_return:7 period_volatility:7 annualized_return_approx:6 annualized_volatility:6 "
    "annualized_sharpe:6 t_stat:6 p_value:6 cumulative_return:5 max_drawdown:6 best_month:7 worst_month:7"
)



# ---------------------------------------------------------------- selection
add(
    "stop_take_return",
    "ticker month r:9",
    lambda lb: lb.monthly.select("ticker", "month", portfolio.stop_take_return(F.lit(0.10), F.lit(0.20)).alias("r")),
    "SELECT ticker, month, CASE WHEN coalesce(next_high / next_open - 1 >= 0.2, FALSE) "
    "AND NOT coalesce(next_low / next_open - 1 <= -0.1, FALSE) THEN 0.2::DOUBLE "
    "WHEN NOT coalesce(next_low / next_open - 1 > -0.1, FALSE) THEN -0.1::DOUBLE ELSE next_ret_oc END AS r FROM stock_months",
)
add(
    "regime_gate",
    "month regime_on n_picks:i",
    lambda lb: lb.months.join(
        lb.picks.filter("strategy = 'improved_5'").groupBy("month").agg(F.count("*").alias("n_picks")), "month", "left"
    ).withColumn("n_picks", F.coalesce("n_picks", F.lit(0))),
    "SELECT m.month, m.regime_on, count(r.ticker) AS n_picks FROM months m "
    "LEFT JOIN realised r ON r.month = m.month AND r.strategy = 'improved_5' GROUP BY m.month, m.regime_on",
)
add(
    "topn_by_score",
    "variant month ticker rank:i score:6",
    lambda lb: portfolio.topn_by_score(scoring.scores_by_variant(lb.panel, all_specs(), _rolling_weights(lb)), ["variant", "month"], 10),
    f"SELECT * FROM picks WHERE rank <= 10 AND variant IN {tuple(dict.fromkeys(s.score_variant for s in all_specs()))}",
)
add(
    "spec_ladder",
    "strategy variant top_n:i trend_col weight_method regime_filter stop_loss take_profit sizing_method assignment_scope "
    "n_scored:i first_month",
    lambda lb: _spec_coverage(lb),
    "SELECT v.*, c.n_scored, c.first_month FROM (VALUES "
    + ", ".join(
        f"('{s.name}', '{s.score_variant}', {s.top_n}, '{s.trend}', '{s.weighting.method}', {s.gated}, "
        f"{s.exits.stop if s.exits.stop is not None else 'NULL'}::DOUBLE, "
        f"{s.exits.take if s.exits.take is not None else 'NULL'}::DOUBLE, '{s.sizing.method}', {s.scores_like(all_specs()[0])})"
        for s in [*all_specs(), *grid_specs()]
    )
    + ") v(strategy, variant, top_n, trend_col, weight_method, regime_filter, stop_loss, take_profit, sizing_method, "
    "assignment_scope) LEFT JOIN (SELECT variant, count(*) AS n_scored, min(month) AS first_month FROM scores "
    "WHERE score IS NOT NULL GROUP BY variant) c USING (variant)",
)


def _rolling_weights(lb: Lab):
    rolling = next(s for s in all_specs() if s.weighting.method == "rolling_rank_ic")
    return {rolling.score_variant: scoring.rolling_ic_weights(lb.months.select("month"), lb.ic_expanding, rolling)}


def _spec_coverage(lb: Lab):
    """Every specification beside how much of the panel its score covers."""
    specs = [*all_specs(), *grid_specs()]
    cover = scoring.scores_by_variant(lb.panel, specs, _rolling_weights(lb)).groupBy("variant").agg(
        F.count("*").alias("n_scored"), F.min("month").alias("first_month")
    )
    return specs_frame(lb.spark, specs).join(cover, "variant", "left")


add(
    "spec_panel_cross",
    "strategy scenario month n:i gross:6",
    lambda lb: _spec_cross(lb),
    "SELECT strategy, scenario, month, count(*) AS n, sum(gross) AS gross FROM realised_grid GROUP BY strategy, scenario, month",
)


def _spec_cross(lb: Lab):
    months = lb.months
    picks = portfolio.topn_by_score(scoring.scores_by_variant(lb.panel, grid_specs()), ["variant", "month"], 10)
    runs = portfolio.spec_runs(lb.spark, grid_specs())
    costs = portfolio.monthly_costs(months, portfolio.cost_schedule(lb.spark), ["zero"])
    real = portfolio.realised_picks(picks, runs, costs)
    return real.groupBy("strategy", "scenario", "month").agg(
        F.count("*").alias("n"), F.sum("gross_stock_return").alias("gross")
    )


add(
    "vector_backtest",
    CURVE,
    lambda lb: ladder.run_specs(lb.panel, all_specs(), CFG, lb.ws, ic_tables={"trend_expanding_z": lb.ic_expanding})[0],
    "SELECT * FROM curves",
)
add("strategy_curves", CURVE, lambda lb: lb.curves, "SELECT * FROM curves")
add(
    "position_size",
    "strategy month size:2",
    lambda lb: lb.curves.select(
        "strategy",
        "month",
        portfolio.position_size(
            F.col("prev_equity"), F.col("sizing_method"), F.when(F.col("strategy") == "improved_8", 0.05).otherwise(0.10), CFG.cash_per_trade
        ).alias("size"),
    ),
    "SELECT strategy, month, CASE WHEN sizing_method = 'percent_of_equity' THEN 0.05 * prev_equity ELSE 100000.0 END AS size FROM curves",
)
add(
    "select_positions",
    "strategy month n_positions:i",
    lambda lb: lb.curves,
    "SELECT strategy, month, n_positions FROM curves",
)
add(
    "holdings_log",
    "strategy signal_month ticker sector rank:i score:6 allocated_cash:2 gross_stock_return:7 cost_drag_per_holding:7 realized_stock_return:7",
    lambda lb: portfolio.holdings_log(lb.curves, lb.picks),
    "SELECT * FROM holdings",
)
add(
    "signals",
    "strategy month rank:i ticker",
    lambda lb: portfolio.signals(lb.holdings),
    "SELECT strategy, signal_month AS month, rank, ticker FROM holdings",
)
add(
    "run_ladder",
    f"strategy {PERF} final_equity:2 avg_positions:6 top_n:i trend_col weight_method",
    lambda lb: ladder.run_ladder(lb.panel, ladder_specs(), CFG, lb.ws, {"trend_expanding_z": lb.ic_expanding})[2],
    "SELECT m.*, a.avg_positions, 10 AS top_n, CASE strategy WHEN 'base' THEN 'trend_z' ELSE 'trend_expanding_z' END AS trend_col, "
    "CASE strategy WHEN 'improved_3' THEN 'rolling_rank_ic' ELSE 'static' END AS weight_method "
    "FROM metrics m JOIN avg_pos a USING (strategy) WHERE strategy IN ('base', 'improved_1', 'improved_2', 'improved_3')",
)

# --------------------------------------------------------------- costs, grid
SCHED = "year:i scenario scenario_multiplier:3 commission_bps_per_side:6 slippage_bps_per_side:6 round_trip_bps:6"
add(
    "cost_schedule",
    "month " + SCHED.replace("year:i", "schedule_year:i"),
    lambda lb: joins.nearest_year_join(
        lb.months.select("month", F.explode(F.array(*[F.lit(s) for s in SCENARIOS])).alias("scenario")),
        portfolio.cost_schedule(lb.spark),
    ),
    "SELECT *, year AS schedule_year FROM costs",
)
add(
    "cost_drag_apply",
    "strategy scenario month ticker gross_stock_return:7 cost_drag_per_holding:7 realized_stock_return:7",
    lambda lb: ladder.run_specs(lb.panel, lb.cost_specs(), CFG, lb.ws, SCENARIOS)[1],
    "SELECT strategy, scenario, month, ticker, gross AS gross_stock_return, drag AS cost_drag_per_holding, "
    "net AS realized_stock_return FROM realised_cost",
)
add(
    "cost_scenario_grid",
    "strategy scenario annualized_sharpe:6 annualized_return_approx:6 annualized_volatility:6 max_drawdown:6 "
    "cumulative_return:5 final_equity:2 total_cost_dollars:2 avg_round_trip_bps:4 sharpe_drop_vs_zero:6",
    lambda lb: ladder.cost_scenario_grid(lb.cost_curves, CFG),
    "SELECT m.strategy, m.scenario, m.annualized_sharpe, m.annualized_return_approx, m.annualized_volatility, m.max_drawdown, "
    "m.cumulative_return, m.final_equity, k.total_cost_dollars, k.avg_round_trip_bps, "
    "CASE WHEN m.scenario <> 'zero' THEN z.annualized_sharpe - m.annualized_sharpe END AS sharpe_drop_vs_zero FROM metrics_cost m "
    "JOIN (SELECT strategy, scenario, sum(cost_dollars) AS total_cost_dollars, avg(nullif(round_trip_bps, 0)) AS avg_round_trip_bps "
    f"FROM curves_cost WHERE month >= {EVAL} GROUP BY ALL) k USING (strategy, scenario) "
    "JOIN metrics_cost z ON z.strategy = m.strategy AND z.scenario = 'zero'",
)
add(
    "yearly_cost_drag",
    "strategy scenario year:i cost_dollars:2 pnl:2 gross_pnl:2 avg_equity_start:2 avg_round_trip_bps:4 avg_positions:5 "
    "cost_drag_pct_of_avg_equity:7",
    lambda lb: perf.yearly_cost_drag(lb.cost_curves),
    "SELECT *, cost_dollars / nullif(avg_equity_start, 0) AS cost_drag_pct_of_avg_equity FROM (SELECT strategy, scenario, "
    "year(month) AS year, sum(cost_dollars) AS cost_dollars, sum(pnl) AS pnl, sum(pnl + cost_dollars) AS gross_pnl, "
    "avg(prev_equity) AS avg_equity_start, avg(round_trip_bps) AS avg_round_trip_bps, avg(n_positions) AS avg_positions "
    "FROM curves_cost GROUP BY ALL)",
)
add(
    "cost_drag_pp",
    "strategy year:i drag_pp:5",
    lambda lb: perf.cost_drag_pp(lb.cost_curves),
    "SELECT strategy, year, (max(a) FILTER (scenario = 'zero') - max(a) FILTER (scenario = 'central')) * 100 AS drag_pp FROM ("
    "SELECT strategy, scenario, year(month) AS year, product(1 + portfolio_return) - 1 AS a FROM curves_cost GROUP BY ALL) GROUP BY ALL",
)
_SM = ["annualized_sharpe", "annualized_return_approx", "max_drawdown", "cumulative_return", "final_equity"]
add(
    "scenario_pivot",
    "strategy " + " ".join(f"{s}_{m}:{2 if m == 'final_equity' else 5}" for s in SCENARIOS for m in _SM),
    lambda lb: tables.scenario_pivot(ladder.cost_scenario_grid(lb.cost_curves, CFG), SCENARIOS, _SM),
    "SELECT strategy, "
    + ", ".join(f"max({m}) FILTER (scenario = '{s}') AS {s}_{m}" for s in SCENARIOS for m in _SM)
    + " FROM metrics_cost GROUP BY strategy",
)
GRID = (
    "strategy stop_loss take_profit stop_idx:i take_idx:i full_sharpe:6 full_final_equity:2 full_max_drawdown:6 train_sharpe:6 "
    "train_total_return:5 train_max_drawdown:6 test_sharpe:6 test_total_return:5 test_max_drawdown:6 test_avg_positions:5"
)
add(
    "stop_take_grid",
    GRID,
    lambda lb: ladder.stop_take_grid(ladder.run_specs(lb.panel, grid_specs(), CFG, lb.ws)[0], grid_specs(), CFG),
    "SELECT * FROM grid",
)
add(
    "ordinal_index",
    "strategy stop_idx:i take_idx:i",
    lambda lb: tables.ordinal_index(
        tables.ordinal_index(lb.grid.drop("stop_idx", "take_idx"), "stop_loss", list(STOP_LEVELS), "stop_idx"),
        "take_profit", list(TAKE_LEVELS), "take_idx",
    ),
    "SELECT strategy, stop_idx, take_idx FROM grid",
)
add(
    "grid_neighbour_join",
    "strategy neighbour",
    lambda lb: tables.grid_neighbour_join(lb.grid),
    "SELECT strategy, neighbour FROM grid_pairs",
)
add(
    "grid_stability",
    "strategy neighbor_train_sharpe_median:6 neighbor_test_sharpe_median:6 neighbor_count:i train_stability_gap:6 robust_train_score:6",
    lambda lb: tables.grid_stability(lb.grid),
    "SELECT * FROM grid_stab",
)
_OK = (
    "coalesce(train_sharpe IS NOT NULL AND train_total_return > 0 AND train_max_drawdown > -0.25 AND neighbor_count >= 3, FALSE)"
)
add(
    "argmax_select",
    "strategy stop_loss take_profit robust_train_score:6 grid_eligible",
    lambda lb: tables.argmax_select(tables.grid_stability(lb.grid)),
    f"SELECT *, {_OK} AS grid_eligible FROM grid_stab ORDER BY {_OK} DESC, robust_train_score DESC NULLS LAST, "
    "train_sharpe DESC NULLS LAST, strategy LIMIT 1",
)
add(
    "top10_grid",
    "ranking rank:i strategy robust_train_score:6 train_sharpe:6 test_sharpe:6",
    lambda lb: tables.top10_grid(tables.grid_stability(lb.grid)),
    "SELECT * FROM (SELECT 'train' AS ranking, row_number() OVER (ORDER BY robust_train_score DESC NULLS LAST, train_sharpe DESC "
    "NULLS LAST, strategy) AS rank, * FROM grid_stab UNION ALL SELECT 'test', row_number() OVER (ORDER BY test_sharpe DESC NULLS "
    "LAST, test_max_drawdown DESC NULLS LAST, strategy), * FROM grid_stab) WHERE rank <= 10",
)
add(
    "pivot_grid",
    "stop_loss " + " ".join(f"take_{round(t * 1000):03d}:6" for t in TAKE_LEVELS),
    lambda lb: tables.pivot_grid(lb.grid, list(TAKE_LEVELS), "train_sharpe"),
    "SELECT stop_loss, "
    + ", ".join(f"max(train_sharpe) FILTER (take_profit = {t}) AS take_{round(t * 1000):03d}" for t in TAKE_LEVELS)
    + " FROM grid GROUP BY stop_loss",
)
add(
    "train_test_full",
    "strategy segment annualized_sharpe:6 total_return:5 max_drawdown:6 avg_positions:5 final_equity:2",
    lambda lb: perf.train_test_full(lb.curves, CFG),
    "SELECT * FROM ("
    + perf_sql("segments_full", "strategy, segment")
    + ") JOIN (SELECT strategy, segment, avg(n_positions) AS avg_positions FROM segments_full GROUP BY ALL) USING (strategy, segment)",
)

# -------------------------------------------------------------------- trades
EXITS = "strategy ticker entry_date entry_price shares:i exit_date exit_price:6 reason bar_len:i"


add(
    "first_touch_exits",
    EXITS,
    lambda lb: trades.first_touch_exits(trades.rebalance_bars(lb.trade_signals, lb.held_prices), None, None, CFG, lb.trade_levels),
    "SELECT * FROM exits",
)
add(
    "holding_spells",
    "strategy ticker start_month end_month n_months:i",
    lambda lb: trades.holding_spells(lb.holdings.select("strategy", F.col("signal_month").alias("month"), "ticker")),
    "SELECT strategy, ticker, min(month) AS start_month, max(month) AS end_month, count(*) AS n_months FROM ("
    "SELECT h.strategy, h.ticker, h.signal_month AS month, m.k - row_number() OVER (PARTITION BY h.strategy, h.ticker ORDER BY m.k) AS g "
    "FROM holdings h JOIN (SELECT signal_month, row_number() OVER (ORDER BY signal_month) AS k FROM "
    "(SELECT DISTINCT signal_month FROM holdings)) m USING (signal_month)) GROUP BY strategy, ticker, g",
)
add("trade_log", "strategy ticker date pnl:3 bar_len:i reason", lambda lb: trades.trade_log(lb.exits), "SELECT * FROM trade_log")
add(
    "trade_stats",
    "strategy n_trades:i avg_bar_len:5 first_date",
    lambda lb: trades.trade_stats(trades.trade_log(lb.exits)),
    "SELECT strategy, count(*) AS n_trades, avg(bar_len) AS avg_bar_len, min(date) AS first_date FROM trade_log GROUP BY strategy",
)
add(
    "pnl_histogram",
    "strategy bin:i n_trades:i",
    lambda lb: trades.pnl_histogram(trades.trade_log(lb.exits)),
    "SELECT strategy, CASE WHEN pnl < -15000 THEN 0 WHEN pnl > 15000 THEN 50 "
    "ELSE least(floor((pnl + 15000) / (30000.0 / 49)) + 1, 49) END AS bin, count(*) AS n_trades FROM trade_log GROUP BY ALL",
)
add(
    "daily_positions",
    "strategy date ticker entry_date shares:i price market_value",
    lambda lb: trades.daily_positions(lb.exits, lb.held_prices, lb.index_tables[0]),
    "SELECT * FROM positions",
)
add(
    "mark_to_market",
    "strategy date cash:2 market_value:2 value:2",
    lambda lb: _mtm(lb),
    "SELECT * FROM mtm",
)


def _mtm(lb: Lab):
    cal = lb.index_tables[0].select("date")
    return trades.mark_to_market(lb.exits, trades.daily_positions(lb.exits, lb.held_prices, cal), cal, [s.name for s in all_specs()], CFG)


add(
    "equity_return",
    "strategy date value:2 return:7",
    lambda lb: joins.return_from_level(_mtm(lb).select("strategy", "date", "value"), key="strategy"),
    "SELECT strategy, date, value, coalesce(value / lag(value) OVER (PARTITION BY strategy ORDER BY date) - 1, 0) AS return FROM mtm",
)
add(
    "fixed_cash_shares",
    "ticker date shares:i",
    lambda lb: lb.prices.select("ticker", "date", portfolio.fixed_cash_shares(F.col("adjClose"), CFG.cash_per_trade).alias("shares")),
    "SELECT ticker, date, floor(100000.0 / adjClose) AS shares FROM prices",
)
add(
    "pct_equity_shares",
    "ticker date shares:i",
    lambda lb: lb.prices.select(
        "ticker", "date", portfolio.pct_equity_shares(F.col("adjClose"), F.lit(1_000_000.0), 0.05).alias("shares")
    ),
    "SELECT ticker, date, floor(0.05 * 1000000.0 / adjClose) AS shares FROM prices",
)
add(
    "bracket_prices",
    "ticker date stop_price:2 take_price:2",
    lambda lb: lb.prices.select(
        "ticker",
        "date",
        *[c.alias(n) for c, n in zip(portfolio.bracket_prices(F.col("adjClose"), 0.05, 0.30), ("stop_price", "take_price"))],
    ),
    "SELECT ticker, date, round(adjClose * (1 - 0.05), 2) AS stop_price, round(adjClose * (1 + 0.30), 2) "
    "AS take_price FROM prices",
)
add(
    "long_only_check",
    "min_size:i status",
    lambda lb: portfolio.long_only_check(lb.exits),
    "SELECT min(shares) AS min_size, CASE WHEN coalesce(min(shares) >= 0, TRUE) THEN 'OK' ELSE 'FAIL' END AS status FROM exits",
)

# --------------------------------------------------------------- performance
add(
    "perf_metrics",
    f"strategy {PERF} first_period last_period",
    lambda lb: perf.perf_metrics(lb.curves, ["strategy"]),
    perf_sql("curves", "strategy"),
)
add(
    "eval_metrics",
    f"strategy {PERF} final_equity:2 total_return:5 first_period last_period",
    lambda lb: perf.eval_metrics(lb.curves, ["strategy"], CFG.evaluation_start, CFG.initial_cash),
    "SELECT * FROM metrics",
)
add(
    "avg_positions",
    "strategy avg_positions:6",
    lambda lb: perf.avg_positions(lb.curves, ["strategy"], CFG.evaluation_start),
    "SELECT * FROM avg_pos",
)
add(
    "strategy_metrics_table",
    "strategy annualized_sharpe:6 annualized_return_approx:6 annualized_volatility:6 max_drawdown:6 cumulative_return:5 "
    "final_equity:2 total_return:5 n_periods:i avg_positions:6",
    lambda lb: perf.strategy_metrics_table(lb.curves, CFG),
    "SELECT * FROM metrics JOIN avg_pos USING (strategy)",
)
add(
    "order_by_metric",
    "strategy annualized_sharpe:6",
    lambda lb: tables.order_by_metric(perf.strategy_metrics_table(lb.curves, CFG), "annualized_sharpe"),
    "SELECT strategy, annualized_sharpe FROM metrics ORDER BY annualized_sharpe DESC",
)
add(
    "wealth_curve",
    "strategy month wealth:5",
    lambda lb: perf.wealth_curve(lb.eval_curves, ["strategy"]),
    "SELECT strategy, month, product(1 + portfolio_return) OVER (PARTITION BY strategy ORDER BY month) AS wealth FROM eval_curves",
)
add(
    "drawdown",
    "strategy month drawdown:6",
    lambda lb: perf.drawdown(lb.curves, ["strategy"], "equity"),
    "SELECT strategy, month, equity / max(equity) OVER (PARTITION BY strategy ORDER BY month) - 1 AS drawdown FROM curves",
)
add(
    "rolling_sharpe",
    "strategy month rolling_sharpe:5",
    lambda lb: perf.rolling_sharpe(lb.eval_curves, ["strategy"]),
    "SELECT strategy, month, CASE WHEN count(portfolio_return) OVER w = 12 AND stddev_samp(portfolio_return) OVER w > 0 THEN "
    "sqrt(12) * avg(portfolio_return) OVER w / nullif(stddev_samp(portfolio_return) OVER w, 0) END AS rolling_sharpe FROM eval_curves "
    "WINDOW w AS (PARTITION BY strategy ORDER BY month ROWS 11 PRECEDING)",
)
add(
    "rolling_positions",
    "strategy month rolling_positions:6",
    lambda lb: perf.rolling_positions(lb.eval_curves, ["strategy"]),
    "SELECT strategy, month, avg(n_positions) OVER (PARTITION BY strategy ORDER BY month ROWS 5 PRECEDING) AS rolling_positions "
    "FROM eval_curves",
)
_EX = "SELECT strategy, month, portfolio_return - benchmark_return AS e FROM aligned"
add(
    "cumulative_excess_geometric",
    "strategy month cum_excess_geometric:5",
    lambda lb: perf.cumulative_excess(joins.benchmark_align_inner(lb.eval_curves, lb.bench), ["strategy"]),
    f"SELECT strategy, month, product(1 + e) OVER (PARTITION BY strategy ORDER BY month) - 1 AS cum_excess_geometric FROM ({_EX})",
)
add(
    "cumulative_excess_arithmetic",
    "strategy month cum_excess_arithmetic:6",
    lambda lb: perf.cumulative_excess(joins.benchmark_align_inner(lb.eval_curves, lb.bench), ["strategy"]),
    f"SELECT strategy, month, sum(e) OVER (PARTITION BY strategy ORDER BY month) AS cum_excess_arithmetic FROM ({_EX})",
)
_PAIR = (
    "SELECT a.month, a.portfolio_return AS portfolio_return_a, b.portfolio_return AS portfolio_return_b FROM eval_curves a "
    "JOIN eval_curves b ON a.month = b.month AND a.strategy = 'improved_4' AND b.strategy = 'improved_6'"
)
add(
    "pairwise_curve_join",
    "month portfolio_return_a:7 portfolio_return_b:7",
    lambda lb: joins.pairwise_curve_join(lb.eval_curves, "improved_4", "improved_6"),
    _PAIR,
)
add(
    "edge_accumulation",
    "month diff:7 cum_diff:6",
    lambda lb: perf.edge_accumulation(joins.pairwise_curve_join(lb.eval_curves, "improved_4", "improved_6")),
    f"SELECT month, portfolio_return_a - portfolio_return_b AS diff, sum(portfolio_return_a - portfolio_return_b) "
    f"OVER (ORDER BY month) AS cum_diff FROM ({_PAIR})",
)
add(
    "benchmark_align_inner",
    "strategy month portfolio_return:7 benchmark_return:8",
    lambda lb: joins.benchmark_align_inner(lb.eval_curves, lb.bench),
    "SELECT * FROM aligned",
)
add(
    "benchmark_align_outer",
    "strategy month portfolio_return:7 benchmark_return:8 excess:7",
    lambda lb: joins.benchmark_align_outer(lb.eval_curves, lb.bench, "strategy"),
    "SELECT strategy, month, coalesce(portfolio_return, 0) AS portfolio_return, coalesce(benchmark_return, 0) AS benchmark_return, "
    "coalesce(portfolio_return, 0) - coalesce(benchmark_return, 0) AS excess FROM eval_curves FULL OUTER JOIN "
    "(SELECT * FROM bench, (SELECT DISTINCT strategy FROM eval_curves)) USING (strategy, month)",
)
add(
    "reindex_to_spine",
    "strategy month portfolio_return:7",
    lambda lb: joins.reindex_to_spine(lb.months.select("month"), lb.eval_curves, "portfolio_return", key="strategy"),
    "SELECT strategy, month, coalesce(c.portfolio_return, 0) AS portfolio_return FROM "
    "(SELECT * FROM (SELECT month FROM months), (SELECT DISTINCT strategy FROM eval_curves)) LEFT JOIN eval_curves c USING (strategy, month)",
)
NAMES = [s.name for s in all_specs()]
_PIVOT = ", ".join(f"avg(portfolio_return) FILTER (strategy = '{s}') AS {s}" for s in NAMES)
add(
    "multi_series_align",
    "month " + " ".join(f"{s}:7" for s in NAMES),
    lambda lb: joins.multi_series_align(lb.eval_curves, NAMES),
    f"SELECT month, {_PIVOT} FROM eval_curves GROUP BY month",
)
add(
    "pivot_returns_wide",
    "month " + " ".join(f"{s}:7" for s in NAMES),
    lambda lb: lb.curves.groupBy("month").pivot("strategy", NAMES).agg(F.avg("portfolio_return")),
    f"SELECT month, {_PIVOT} FROM curves GROUP BY month",
)
add(
    "common_index",
    "month",
    lambda lb: joins.common_index(lb.eval_curves, lb.index_tables[1]),
    "SELECT DISTINCT month FROM eval_curves WHERE month IN (SELECT month FROM index_months)",
)
add(
    "pivot_year_month",
    "strategy year:i " + " ".join(f"m{i:02d}:7" for i in range(1, 13)),
    lambda lb: perf.pivot_year_month(lb.eval_curves),
    "SELECT strategy, year(month) AS year, "
    + ", ".join(f"avg(portfolio_return) FILTER (month(month) = {i}) AS m{i:02d}" for i in range(1, 13))
    + " FROM eval_curves GROUP BY strategy, year(month)",
)
add(
    "calendar_year_return",
    "strategy year:i annual_return:6",
    lambda lb: perf.calendar_year_return(lb.eval_curves, ["strategy"]),
    "SELECT strategy, year(month) AS year, product(1 + portfolio_return) - 1 AS annual_return FROM eval_curves GROUP BY ALL",
)
add(
    "hit_rate",
    "strategy n_months:i hit_rate_pct:5 avg_up_month_pct:5 avg_down_month_pct:5 best_month_pct:5 worst_month_pct:5",
    lambda lb: perf.hit_rate(lb.eval_curves, ["strategy"]),
    "SELECT strategy, count(*) AS n_months, avg((portfolio_return > 0)::INT) * 100 AS hit_rate_pct, "
    "avg(portfolio_return) FILTER (portfolio_return > 0) * 100 AS avg_up_month_pct, "
    "avg(portfolio_return) FILTER (portfolio_return < 0) * 100 AS avg_down_month_pct, max(portfolio_return) * 100 AS best_month_pct, "
    "min(portfolio_return) * 100 AS worst_month_pct FROM eval_curves GROUP BY strategy",
)
add(
    "tail_risk",
    "strategy annualized_return_approx:6 sortino_ratio:5 calmar_ratio:5 max_drawdown:6",
    lambda lb: perf.tail_risk(lb.eval_curves, ["strategy"]),
    "SELECT strategy, annualized_return_approx, annualized_return_approx / nullif(d * sqrt(12), 0) AS sortino_ratio, "
    "annualized_return_approx / nullif(abs(max_drawdown), 0) AS calmar_ratio, max_drawdown FROM metrics JOIN "
    "(SELECT strategy, stddev_samp(portfolio_return) FILTER (portfolio_return < 0) AS d FROM eval_curves GROUP BY strategy) "
    "USING (strategy)",
)
add(
    "best_worst_k",
    "strategy type rank:i month return_pct:5",
    lambda lb: perf.best_worst_k(lb.eval_curves, ["strategy"], 5),
    "SELECT * FROM (SELECT strategy, 'best' AS type, row_number() OVER (PARTITION BY strategy ORDER BY portfolio_return DESC, month) "
    "AS rank, month, portfolio_return * 100 AS return_pct FROM eval_curves UNION ALL SELECT strategy, 'worst', row_number() OVER "
    "(PARTITION BY strategy ORDER BY portfolio_return, month), month, portfolio_return * 100 FROM eval_curves) WHERE rank <= 5",
)
add(
    "hhi",
    "strategy month hhi:6",
    lambda lb: perf.hhi(lb.eval_curves),
    "SELECT strategy, month, 1.0 / nullif(n_positions, 0) AS hhi FROM eval_curves",
)
add(
    "walk_forward",
    "strategy train_sharpe:6 test_sharpe:6 test_cumulative_return:5 test_max_drawdown:6 selected_by_train",
    lambda lb: perf.walk_forward(lb.curves, CFG),
    "SELECT *, row_number() OVER (ORDER BY train_sharpe DESC NULLS LAST, strategy) = 1 AS selected_by_train FROM (SELECT strategy, "
    "max(annualized_sharpe) FILTER (segment = 'train') AS train_sharpe, max(annualized_sharpe) FILTER (segment = 'test') AS test_sharpe, "
    "max(cumulative_return) FILTER (segment = 'test') AS test_cumulative_return, "
    "max(max_drawdown) FILTER (segment = 'test') AS test_max_drawdown FROM ("
    + perf_sql("segments", "strategy, segment")
    + ") GROUP BY strategy)",
)
add(
    "selected_flag",
    "strategy annualized_sharpe:6 selected",
    lambda lb: tables.selected_flag(perf.strategy_metrics_table(lb.curves, CFG), "annualized_sharpe"),
    "SELECT strategy, annualized_sharpe, row_number() OVER (ORDER BY annualized_sharpe DESC NULLS LAST, strategy) = 1 AS selected FROM metrics",
)
add(
    "benchmark_metrics",
    f"strategy {PERF} final_equity:2",
    lambda lb: perf.eval_metrics(
        lb.bench.select(
            F.lit("benchmark").alias("strategy"), "month", F.coalesce("benchmark_return", F.lit(0.0)).alias("portfolio_return")
        ),
        ["strategy"], CFG.evaluation_start, CFG.initial_cash,
    ),
    perf_sql(
        "(SELECT 'benchmark' AS strategy, month, coalesce(benchmark_return, 0) AS portfolio_return FROM bench)",
        "strategy", where=f"month >= {EVAL}",
    ),
)
add(
    "regime_exposure",
    "month index_close:6 sma_10m:6 regime_on n_positions:i portfolio_return:7 invested",
    lambda lb: joins.regime_exposure(lb.panel, lb.curves.filter("strategy = 'improved_5'")),
    "SELECT * FROM exposure",
)
_ON = "coalesce(regime_on, FALSE)"
add(
    "regime_diagnostics",
    "metric value:7",
    lambda lb: perf.regime_diagnostics(joins.regime_exposure(lb.panel, lb.curves.filter("strategy = 'improved_5'"))),
    f"SELECT unnest(['total_months', 'regime_on_months', 'regime_off_months', 'invested_months', 'cash_months', "
    "'avg_return_when_regime_on', 'avg_return_when_regime_off']) AS metric, unnest([a, b, c, d, e, f, g]) AS value FROM ("
    f"SELECT count(*)::DOUBLE AS a, count(*) FILTER ({_ON})::DOUBLE AS b, count(*) FILTER (NOT {_ON})::DOUBLE AS c, "
    "count(*) FILTER (invested)::DOUBLE AS d, count(*) FILTER (NOT invested)::DOUBLE AS e, "
    f"avg(portfolio_return) FILTER ({_ON}) AS f, avg(portfolio_return) FILTER (NOT {_ON}) AS g FROM exposure)",
)
add(
    "regime_out_share",
    "months_out:i months:i out_pct:5",
    lambda lb: perf.regime_out_share(
        joins.regime_exposure(lb.panel, lb.curves.filter("strategy = 'improved_5'")), CFG.evaluation_start
    ),
    f"SELECT count(*) FILTER (NOT {_ON}) AS months_out, count(*) AS months, count(*) FILTER (NOT {_ON}) * 100.0 / count(*) AS out_pct "
    f"FROM exposure WHERE month >= {EVAL}",
)
add(
    "improvement_deltas",
    "strategy rung:i annualized_sharpe:6 sharpe_delta:6",
    lambda lb: perf.improvement_deltas(perf.strategy_metrics_table(lb.curves, CFG), NAMES),
    "SELECT strategy, rung, annualized_sharpe, annualized_sharpe - lag(annualized_sharpe) OVER (ORDER BY rung) AS sharpe_delta FROM ("
    f"SELECT *, list_position([{', '.join(repr(n) for n in NAMES)}], strategy) AS rung FROM metrics)",
)
_ROLES = {"base": "base", "improved_1": "improved_1", "improved_2": "improved_2", "improved_3": "improved_3"}
add(
    "staged_role_order",
    "strategy role role_order:i annualized_sharpe:6",
    lambda lb: tables.staged_role_order(perf.strategy_metrics_table(lb.curves, CFG), _ROLES),
    "SELECT strategy, strategy AS role, list_position(['base', 'improved_1', 'improved_2', 'improved_3'], strategy) AS role_order, "
    "annualized_sharpe FROM metrics WHERE strategy IN ('base', 'improved_1', 'improved_2', 'improved_3')",
)
BENCH = (
    "n_months:i avg_strategy_return:7 avg_benchmark_return:7 avg_excess_return:7 annualized_excess_return_approx:6 excess_t_stat:6 "
    "excess_p_value:6 beta:6 monthly_alpha:7 annualized_alpha_approx:6 alpha_t_stat:5 alpha_p_value:6 r_squared:6"
)


def _hac_sql() -> str:
    s00, s01, s11 = "u * u", "u * ub", "ub * ub"
    for lag in (1, 2, 3):
        k = 1 - lag / 4
        lu, lb_ = f"lag(u, {lag}, 0.0::DOUBLE) OVER w", f"lag(ub, {lag}, 0.0::DOUBLE) OVER w"
        s00 += f" + {2 * k} * u * {lu}"
        s01 += f" + {k} * (u * {lb_} + ub * {lu})"
        s11 += f" + {2 * k} * ub * {lb_}"
    inner = f"""
SELECT s.*, a.m00, a.m01, a.m11, s.sbb / s.det AS ca, -s.sb / s.det AS cb FROM (
  SELECT *, n_months * sbb - sb * sb AS det FROM (
  SELECT strategy, count(*) AS n_months, avg(portfolio_return) AS avg_strategy_return, avg(benchmark_return) AS avg_benchmark_return,
    avg(portfolio_return - benchmark_return) AS avg_excess_return, stddev_samp(portfolio_return - benchmark_return) AS sde,
    regr_slope(portfolio_return, benchmark_return) AS beta, regr_intercept(portfolio_return, benchmark_return) AS monthly_alpha,
    regr_r2(portfolio_return, benchmark_return) AS r_squared, sum(benchmark_return) AS sb,
    sum(benchmark_return * benchmark_return) AS sbb FROM aligned GROUP BY strategy)) s
JOIN (SELECT strategy, sum(x00) AS m00, sum(x01) AS m01, sum(x11) AS m11 FROM (
  SELECT strategy, {s00} AS x00, {s01} AS x01, {s11} AS x11 FROM (
    SELECT *, u * benchmark_return AS ub FROM (
      SELECT a.*, portfolio_return - ra - rb * benchmark_return AS u FROM aligned a JOIN (
        SELECT strategy, regr_slope(portfolio_return, benchmark_return) AS rb, regr_intercept(portfolio_return, benchmark_return) AS ra
        FROM aligned GROUP BY strategy) USING (strategy)))
  WINDOW w AS (PARTITION BY strategy ORDER BY month)) GROUP BY strategy) a USING (strategy)"""
    return f"""
SELECT *, avg_excess_return * 12 AS annualized_excess_return_approx, monthly_alpha * 12 AS annualized_alpha_approx,
  {student_p('excess_t_stat', '(n_months - 1)')} AS excess_p_value, {normal_p('alpha_t_stat')} AS alpha_p_value FROM (
  SELECT *, avg_excess_return / (sde / sqrt(n_months)) AS excess_t_stat,
    monthly_alpha / sqrt(ca * ca * m00 + 2 * ca * cb * m01 + cb * cb * m11) AS alpha_t_stat FROM ({inner})) WHERE n_months >= 24"""


add(
    "benchmark_alpha_beta",
    f"strategy {BENCH}",
    lambda lb: regress.benchmark_alpha_beta(joins.benchmark_align_inner(lb.eval_curves, lb.bench)),
    _hac_sql(),
)
add(
    "return_correlation",
    "strategy_a strategy_b correlation:6",
    lambda lb: regress.return_correlation(lb.eval_curves),
    "SELECT a.strategy AS strategy_a, b.strategy AS strategy_b, corr(a.portfolio_return, b.portfolio_return) AS correlation "
    "FROM eval_curves a JOIN eval_curves b USING (month) GROUP BY ALL",
)
add(
    "metrics_enrich",
    "strategy annualized_sharpe:6 weight_method beta:6 monthly_alpha:7",
    lambda lb: tables.metrics_enrich(
        perf.strategy_metrics_table(lb.curves, CFG).select("strategy", "annualized_sharpe"),
        specs_frame(lb.spark, all_specs()),
        regress.benchmark_alpha_beta(joins.benchmark_align_inner(lb.eval_curves, lb.bench)),
    ),
    "SELECT m.strategy, m.annualized_sharpe, CASE WHEN strategy = 'improved_3' THEN 'rolling_rank_ic' ELSE 'static' END AS weight_method, "
    "b.beta, b.monthly_alpha FROM metrics m LEFT JOIN (SELECT strategy, regr_slope(portfolio_return, benchmark_return) AS beta, "
    "regr_intercept(portfolio_return, benchmark_return) AS monthly_alpha FROM aligned GROUP BY strategy) b USING (strategy)",
)
add(
    "union_runs",
    "strategy scenario n:i total:6",
    lambda lb: tables.union_runs(lb.curves, lb.cost_curves.filter("scenario <> 'zero'"))
    .groupBy("strategy", "scenario")
    .agg(F.count("*").alias("n"), F.sum("portfolio_return").alias("total")),
    "SELECT strategy, scenario, count(*) AS n, sum(portfolio_return) AS total FROM (SELECT * FROM curves UNION ALL BY NAME "
    "SELECT * FROM curves_cost WHERE scenario <> 'zero') GROUP BY ALL",
)
_BETTER = {
    "annualized_sharpe": "high",
    "annualized_return_approx": "high",
    "max_drawdown": "low_abs",
    "cumulative_return": "high",
    "final_equity": "high",
    "period_volatility": "low",
}
_VAL = {m: (f"abs({m})" if r == "low_abs" else m) for m, r in _BETTER.items()}
add(
    "head_to_head",
    "metric value_a:5 value_b:5 delta:5 winner",
    lambda lb: tables.head_to_head(
        perf.strategy_metrics_table(lb.curves, CFG), "improved_4", "improved_6", _BETTER
    ),
    "SELECT metric, value_a, value_b, value_a - value_b AS delta, CASE WHEN value_a - value_b IS NULL THEN '' WHEN value_a = value_b "
    "THEN 'tie' WHEN (rule = 'high') = (value_a > value_b) THEN 'improved_4' ELSE 'improved_6' END AS winner FROM ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, '{r}' AS rule, (SELECT {_VAL[m]} FROM metrics WHERE strategy = 'improved_4') AS value_a, "
        f"(SELECT {_VAL[m]} FROM metrics WHERE strategy = 'improved_6') AS value_b"
        for m, r in _BETTER.items()
    )
    + ")",
)
add(
    "vs_baseline_summary",
    "engine strategy annualized_sharpe:6 max_drawdown:6 avg_positions:5",
    lambda lb: _vs_baseline(lb),
    "SELECT 'vector' AS engine, strategy, annualized_sharpe, max_drawdown, avg_positions FROM metrics JOIN avg_pos USING (strategy) "
    "UNION ALL SELECT 'daily', strategy, annualized_sharpe, max_drawdown, NULL FROM ("
    + perf_sql(
        "(SELECT strategy, date, coalesce(value / lag(value) OVER (PARTITION BY strategy ORDER BY date) - 1, 0) AS r FROM mtm)",
        "strategy", "r", "date", f"date >= {EVAL}",
    ).replace("sqrt(12) * avg(r)", "sqrt(252) * avg(r)")
    + ")",
)


def _vs_baseline(lb: Lab):
    from pyspark.sql import Window

    w = Window.partitionBy("strategy").orderBy("date")
    daily = _mtm(lb).withColumn("r", F.coalesce(F.try_divide("value", F.lag("value").over(w)) - 1, F.lit(0.0)))
    return tables.vs_baseline_summary(
        {
            "vector": perf.strategy_metrics_table(lb.curves, CFG),
            "daily": perf.eval_metrics(daily, ["strategy"], CFG.evaluation_start, CFG.initial_cash, "r", "date", 252),
        },
        ["annualized_sharpe", "max_drawdown", "avg_positions"],
    )


# ---------------------------------------------------------------- robustness
def _mc(lb: Lab):
    return lb.monte_carlo


add(
    "monte_carlo",
    "sim:i annualized_sharpe:6 final_equity:2 strategy strategy_sharpe:6 p_value:6",
    _mc,
    "SELECT * FROM mc_test",
)
add(
    "mc_summary",
    "strategy strategy_sharpe:6 p_value:6 n_sims:i random_max_sharpe:6 random_median_sharpe:6 random_min_sharpe:6",
    lambda lb: resample.mc_summary(_mc(lb)),
    "SELECT strategy, max(strategy_sharpe) AS strategy_sharpe, max(p_value) AS p_value, count(*) AS n_sims, "
    "max(annualized_sharpe) AS random_max_sharpe, median(annualized_sharpe) AS random_median_sharpe, "
    "min(annualized_sharpe) AS random_min_sharpe FROM mc_test GROUP BY strategy",
)


def _boot(lb: Lab):
    return resample.block_bootstrap(lb.eval_curves, ["strategy"], CFG.bootstrap_reps, CFG.block_size, CFG.seed + 1)


add(
    "block_bootstrap",
    "strategy sim:i annualized_sharpe:6 cumulative_return:5 max_drawdown:6",
    _boot,
    "SELECT * FROM boot_perf",
)
add(
    "bootstrap_ci",
    "strategy ci_lo:6 ci_hi:6",
    lambda lb: resample.bootstrap_ci(_boot(lb), ["strategy"]),
    "SELECT strategy, quantile_cont(annualized_sharpe, 0.025) AS ci_lo, quantile_cont(annualized_sharpe, 0.975) AS ci_hi "
    "FROM boot_perf GROUP BY strategy",
)


def _excess(lb: Lab):
    return resample.excess_matrix(lb.eval_curves, lb.bench)


add("excess_matrix", "strategy month excess:7", _excess, "SELECT * FROM excess")
add(
    "stationary_variance",
    "strategy mean:8 n:i se:8",
    lambda lb: resample.stationary_variance(_excess(lb), CFG.block_size),
    "SELECT * FROM sb_stats",
)
add(
    "excess_bootstrap_ci",
    "strategy ann_excess:6 ci_lo:6 ci_hi:6",
    lambda lb: resample.excess_bootstrap_ci(_excess(lb), ["strategy"], CFG.bootstrap_reps, CFG.block_size, CFG.seed + 2),
    "SELECT * FROM (SELECT strategy, avg(excess) * 12 AS ann_excess FROM excess GROUP BY strategy) JOIN (SELECT strategy, "
    "quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM (SELECT strategy, sim, avg(r) * 12 AS m FROM excess_boot "
    "GROUP BY strategy, sim) GROUP BY strategy) USING (strategy)",
)
add(
    "stationary_bootstrap_indices",
    "rep:i t:i idx:i",
    lambda lb: resample.stationary_bootstrap_indices(
        _excess(lb).agg(F.countDistinct("month").alias("n")),
        CFG.bootstrap_reps, CFG.block_size, CFG.seed + 3,
    ),
    "SELECT * FROM sb_draws",
)
add(
    "hansen_spa",
    "n_models:i n_periods:i bootstrap_reps:i p_value_lower:6 p_value_consistent:6 p_value_upper:6",
    lambda lb: resample.hansen_spa(_excess(lb), CFG.bootstrap_reps, CFG.block_size, CFG.seed + 3),
    "SELECT max(k) AS n_models, max(n) AS n_periods, count(*) AS bootstrap_reps, avg((zl > stat)::INT) AS p_value_lower, "
    "avg((zc > stat)::INT) AS p_value_consistent, avg((zu > stat)::INT) AS p_value_upper FROM spa_reps",
)


def _stepm(lb: Lab):
    return resample.romano_wolf_stepm(_excess(lb), CFG.bootstrap_reps, CFG.block_size, CFG.seed + 3)


add(
    "romano_wolf_stepm",
    "strategy t_stat:6 mean_excess:7 critical_value:6 superior",
    _stepm,
    "SELECT * FROM stepm",
)
add(
    "scoreboard",
    "strategy annualized_sharpe:6 annualized_return_approx:6 max_drawdown:6 cumulative_return:5 final_equity:2 mc_p_value:6 beats_benchmark",
    lambda lb: tables.scoreboard(
        perf.strategy_metrics_table(lb.curves, CFG), resample.mc_summary(_mc(lb)), _stepm(lb)
    ),
    "SELECT m.*, t.p_value AS mc_p_value, coalesce(s.superior, FALSE) AS beats_benchmark FROM (SELECT strategy, annualized_sharpe, "
    "annualized_return_approx, max_drawdown, cumulative_return, final_equity FROM metrics) m LEFT JOIN (SELECT strategy, "
    "max(p_value) AS p_value FROM mc_test GROUP BY strategy) t USING (strategy) LEFT JOIN stepm s USING (strategy)",
)
add(
    "run_validation",
    "check status detail",
    lambda lb: audit.run_validation(lb.panel, lb.tables.prices, lb.curves, lb.exits, CFG),
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", CASE WHEN {ok} THEN 'OK' ELSE 'FAIL' END AS status, CAST({d} AS VARCHAR) AS detail FROM {t}"
        for n, ok, d, t in (
            ("prices_within_cutoff", f"max(date) <= DATE '{CFG.cutoff}'", "max(date)", "prices"),
            ("panel_within_cutoff", f"max(month) <= DATE '{CFG.cutoff}'", "max(month)", "panel"),
            ("panel_not_empty", "count(*) > 0", "count(*)", "panel"),
            ("panel_keys_unique", "count(*) = count(DISTINCT (ticker, month))", "count(*)", "panel"),
            ("positions_non_negative", "min(n_positions) >= 0", "min(n_positions)", "curves"),
            ("long_only", "min(shares) >= 0", "min(shares)", "exits"),
            ("exits_after_entries", "bool_and(entry_date <= exit_date)", "count(*)", "exits"),
        )
    ),
)
