"""Queries over the factor panel: scores, factor portfolios, IC and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorlab.catalog.context import CFG, LIVE_MONTH, LIVE_PORTFOLIOS, Lab, ladder_specs
from factorlab.catalog.registry import add
from factorlab.catalog.sql import Z, perf_sql
from factorlab.config import FACTORS
from factorlab.functions.stats import significance_stars, student_two_sided_p
from factorlab.operators import bars, perf, regress, scoring, tables, xsection
from factorlab.plans import ladder, live
from factorlab.plans import panel as panel_plan
from factorlab.sources import sinks

ZCOLS = " ".join(f"{z}:6" for z in Z.values())

add(
    "winsor_zscore",
    "month ticker momentum_z:6 roe_z:6",
    lambda lb: xsection.winsor_zscore(
        lb.panel.drop("roe_z", "momentum_z"), {"momentum_factor": "momentum_z", "roe_factor": "roe_z"},
        CFG.min_names_zscore,
    ),
    "SELECT * FROM panel",
)
add(
    "winsor_zscore_split",
    "month ticker momentum_z:6 roe_z:6",
    lambda lb: xsection.winsor_zscore(
        lb.panel.drop("roe_z", "momentum_z"), {"momentum_factor": "momentum_z", "roe_factor": "roe_z"},
        CFG.min_names_zscore,
    ),
    "SELECT * FROM panel",
)
add(
    "factor_panel",
    f"ticker month close next_ret_cc roe pe_clean momentum_12m trend_raw:9 sector index_close:6 regime_on eligible {ZCOLS} "
    "composite_score:6",
    lambda lb: panel_plan.factor_panel(lb.market, CFG, lb.ws, lb.trend_coefs, lb.expanding_coefs),
    "SELECT * FROM panel",
)
add(
    "factor_panel_fitted",
    f"ticker month trend_raw:8 trend_expanding_raw:7 eligible {ZCOLS} composite_score:6",
    lambda lb: panel_plan.factor_panel(lb.market, CFG, lb.ws),
    "SELECT * FROM panel_fit",
)
add(
    "inject_hzz",
    "ticker month trend_hzz_raw:9 trend_hzz_z:6",
    lambda lb: panel_plan.inject_hzz(lb.panel, lb.signals, CFG, lb.ws, lb.smoothed_betas),
    "SELECT * FROM panel",
)
add(
    "inject_hzz_fitted",
    "ticker month trend_hzz_raw:6 trend_hzz_z:5",
    lambda lb: panel_plan.inject_hzz(lb.panel, lb.signals, CFG, lb.ws),
    "SELECT * FROM panel_hzz",
)
add(
    "live_trend",
    "ticker month trend_expanding_raw:7",
    lambda lb: regress.apply_trend(
        lb.ma_signals.filter(F.col("month") == F.lit(LIVE_MONTH)),
        regress.expanding_trend_betas(
            panel_plan.index_history(*reversed(lb.index_tables), CFG), CFG.dev_cols, CFG, months=[LIVE_MONTH]
        ).drop("series_id"),
        CFG.dev_cols,
        "trend_expanding_raw",
    ),
    f"SELECT ticker, month, trend_expanding_raw FROM trend_fit WHERE month = DATE '{LIVE_MONTH}'",
)
add(
    "composite_min3",
    "ticker month composite_score:6",
    lambda lb: scoring.composite_min3(lb.panel, panel_plan.REQUIRED_Z),
    "SELECT * FROM panel",
)
add(
    "weighted_score",
    "ticker month score:6",
    lambda lb: lb.panel.select(
        "ticker",
        "month",
        scoring.weighted_score(
            [F.col("roe_z"), F.col("pe_z"), F.col("momentum_z"), F.col("trend_z")],
            [F.lit(2.0), F.lit(1.0), F.lit(-1.0), F.lit(0.5)],
        ).alias("score"),
    ),
    "SELECT ticker, month, (2 * roe_z + pe_z - momentum_z + 0.5 * trend_z) / 4.5 AS score FROM panel",
)
add(
    "xs_univariate_fmp",
    "month factor regression_fmp_return:7 regression_t_stat:6 regression_r2:6 n_obs:i",
    lambda lb: xsection.xs_univariate_fmp(lb.factor_long),
    "SELECT * FROM fmp_regression",
)
add(
    "pearson_ic",
    "month factor ic:6 n_obs:i",
    lambda lb: xsection.pearson_ic(lb.factor_long),
    "SELECT * FROM ic",
)
add(
    "spearman_ic",
    "month factor ic:6 rank_ic:6 n_obs:i",
    lambda lb: xsection.information_coefficients(lb.factor_long, lb.ws),
    "SELECT * FROM ic",
)
add(
    "spearman_ic_split",
    "month factor ic:6 rank_ic:6 n_obs:i",
    lambda lb: xsection.information_coefficients(lb.factor_long, lb.ws),
    "SELECT * FROM ic",
)
add(
    "mean_std_count_by_factor",
    "factor mean:6 std:6 count:i",
    lambda lb: xsection.mean_std_count_by_factor(lb.ic),
    "SELECT factor, avg(rank_ic) AS mean, stddev_samp(rank_ic) AS std, count(rank_ic) AS count FROM ic GROUP BY factor",
)
add(
    "ic_summary",
    "factor avg_ic:6 avg_rank_ic:6 ic_t:6 rank_ic_t:6",
    lambda lb: xsection.ic_summary(lb.ic),
    "SELECT * FROM ic_sum",
)
add(
    "ic_means",
    "factor mean_ic:6 mean_rank_ic:6",
    lambda lb: tables.ic_means(lb.ic),
    "SELECT factor, avg(ic) AS mean_ic, avg(rank_ic) AS mean_rank_ic FROM ic GROUP BY factor",
)
add(
    "fmp_portfolio_sort",
    "month factor portfolio_fmp_return:7 top_return:7 bottom_return:7 n_top:i n_bottom:i",
    lambda lb: xsection.fmp_portfolio_sort(xsection.quintile_legs(lb.factor_long, lb.ws)),
    "SELECT * FROM fmp_portfolio",
)
add(
    "fmp_weights",
    "month factor ticker weight:9",
    lambda lb: xsection.fmp_weights(lb.legs),
    "SELECT * FROM fmp_weights",
)
add(
    "top20_weights",
    "month factor ticker weight:9 rank:i",
    lambda lb: xsection.top_weights(xsection.fmp_weights(lb.legs), 20),
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY weight DESC, ticker) AS rank "
    "FROM fmp_weights WHERE month = (SELECT max(month) FROM fmp_weights)) WHERE rank <= 20",
)
add(
    "selected_date_weights",
    "month factor ticker weight:9",
    lambda lb: xsection.selected_date_snapshot(xsection.fmp_weights(lb.legs), "2000-12-15"),
    "SELECT * FROM fmp_weights WHERE month = (SELECT max(month) FROM fmp_weights WHERE month <= DATE '2000-12-15')",
)
PERF = (
    "n_periods:i avg_period_return:7 period_volatility:7 annualized_return_approx:6 annualized_volatility:6 "
    "annualized_sharpe:6 t_stat:6 p_value:6 cumulative_return:5 max_drawdown:6 best_month:7 worst_month:7"
)
add(
    "fmp_summary",
    f"approach factor {PERF} avg_ic:6 avg_rank_ic:6 ic_t:6 rank_ic_t:6",
    lambda lb: ladder.fmp_summary(lb.fmp_portfolio, lb.fmp_regression, lb.ic),
    "SELECT * FROM fmp_perf LEFT JOIN ic_sum USING (factor)",
)
_STARTS = "(SELECT max(s) FROM (SELECT min(month) AS s FROM {t} GROUP BY factor))"
add(
    "common_start_filter",
    "factor month portfolio_fmp_return:7 common_start",
    lambda lb: xsection.common_start_filter(lb.fmp_portfolio),
    f"SELECT *, {_STARTS.format(t='fmp_portfolio')} AS common_start FROM fmp_portfolio "
    f"WHERE month >= {_STARTS.format(t='fmp_portfolio')}",
)
add(
    "fmp_common_start",
    f"approach factor common_start {PERF}",
    lambda lb: ladder.fmp_common_start(lb.fmp_portfolio, lb.fmp_regression),
    "SELECT 'portfolio_sort' AS approach, * FROM ("
    + perf_sql(
        f"(SELECT *, {_STARTS.format(t='fmp_portfolio')} AS common_start FROM fmp_portfolio)",
        "factor, common_start", "portfolio_fmp_return", "month", "month >= common_start",
    )
    + ") UNION ALL SELECT 'regression', * FROM ("
    + perf_sql(
        f"(SELECT *, {_STARTS.format(t='fmp_regression')} AS common_start FROM fmp_regression)",
        "factor, common_start", "regression_fmp_return", "month", "month >= common_start",
    )
    + ")",
)
_STARS = "CASE WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' WHEN p_value < 0.1 THEN '*' ELSE '' END"
add(
    "factor_premia_table",
    "factor approach annualized_sharpe:6 annualized_return_approx:6 t_stat:6 p_value:6 stars avg_ic:6 avg_rank_ic:6",
    lambda lb: tables.factor_premia_table(ladder.fmp_summary(lb.fmp_portfolio, lb.fmp_regression, lb.ic)),
    "SELECT upper(factor) AS factor, CASE approach WHEN 'portfolio_sort' THEN 'Portfolio' ELSE 'Regression' END AS approach, "
    f"annualized_sharpe, annualized_return_approx, t_stat, p_value, {_STARS} AS stars, avg_ic, avg_rank_ic "
    "FROM fmp_perf LEFT JOIN ic_sum USING (factor)",
)
add(
    "significance_stars",
    "factor approach stars",
    lambda lb: ladder.fmp_summary(lb.fmp_portfolio, lb.fmp_regression, None).withColumn(
        "stars", significance_stars(F.col("p_value"))
    ),
    f"SELECT factor, approach, {_STARS} AS stars FROM fmp_perf",
)
add(
    "ttest_1samp",
    "factor n:i t_stat:6 p_value:6",
    lambda lb: lb.ic.groupBy("factor")
    .agg(F.count("rank_ic").alias("n"), perf.ttest_1samp("rank_ic").alias("t_stat"))
    .withColumn("p_value", student_two_sided_p(F.col("t_stat"), F.col("n") - 1)),
    "SELECT factor, n, t AS t_stat, p_value FROM (SELECT factor, n_periods AS n, t_stat AS t, p_value FROM ("
    + perf_sql("ic", "factor", "rank_ic")
    + "))",
)
TRAIL = "month factor mean:6 std:6 count:i n_months:i"
add(
    "trailing_k_months",
    TRAIL,
    lambda lb: scoring.trailing_ic_stats(lb.months.select("month"), lb.ic_expanding, 24),
    "SELECT * FROM ic_trailing",
)
_WCOLS = " ".join(f"weight_{f}:6" for f in FACTORS)
add(
    "rolling_ic_weights",
    f"month method {_WCOLS}",
    lambda lb: scoring.rolling_ic_weights(lb.months.select("month"), lb.ic_expanding, ladder_specs()[3]),
    "SELECT * FROM ic_weights",
)
add(
    "static_weights",
    f"month strategy method {_WCOLS}",
    lambda lb: scoring.static_weights(lb.months, ladder_specs()[0]),
    "SELECT month, 'base' AS strategy, 'static' AS method, "
    + ", ".join(f"0.25 AS weight_{f}" for f in FACTORS)
    + " FROM months",
)
add(
    "weight_history",
    f"month strategy method lookback_months:i min_periods:i shrink_to_equal:6 min_factor_weight:6 max_factor_weight:6 {_WCOLS}",
    lambda lb: scoring.weight_history(lb.months, ladder_specs(), {"trend_expanding_z": lb.ic_expanding}),
    "SELECT month, s AS strategy, 'static' AS method, NULL::INT AS lookback_months, NULL::INT AS min_periods, "
    "NULL::DOUBLE AS shrink_to_equal, NULL::DOUBLE AS min_factor_weight, NULL::DOUBLE AS max_factor_weight, "
    + ", ".join(f"0.25 AS weight_{f}" for f in FACTORS)
    + " FROM months CROSS JOIN (VALUES ('base'), ('improved_1'), ('improved_2')) v(s) UNION ALL "
    "SELECT month, 'improved_3', method, 24, 12, 0.5, 0.1, 0.45, "
    + ", ".join(f"weight_{f}" for f in FACTORS)
    + " FROM ic_weights",
)
add(
    "bounded_simplex",
    f"month {_WCOLS}",
    lambda lb: _simplex(lb),
    # Rank ICs as raw strengths: the same projection from the rolling weights table.
    f"SELECT month, {', '.join(f'weight_{f}' for f in FACTORS)} FROM ic_weights WHERE method <> 'equal_until_min_history'",
)


def _simplex(lb: Lab):
    from factorlab.functions.nulls import ratio

    stats = scoring.trailing_ic_stats(lb.months.select("month"), lb.ic_expanding, 24).filter("n_months >= 12")
    strength = F.coalesce(F.greatest(ratio("mean", "std"), F.lit(0.0)), F.lit(0.0))
    raw = stats.withColumn("_s", strength).groupBy("month").agg(
        *[F.max(F.when(F.col("factor") == f, F.col("_s"))).alias(f) for f in FACTORS]
    )
    total = sum((F.col(f) for f in FACTORS), F.lit(0.0))
    shrunk = F.array(*[0.5 * 0.25 + 0.5 * F.when(total > 0, F.col(f) / total).otherwise(0.25) for f in FACTORS])
    w = scoring.bounded_simplex(shrunk, 4, 0.10, 0.45)
    return raw.withColumn("w", w).select("month", *[F.col("w")[i].alias(f"weight_{f}") for i, f in enumerate(FACTORS)])


add(
    "weights_to_panel",
    "ticker month score:6",
    lambda lb: _weighted_panel(lb),
    "SELECT ticker, month, score FROM scores WHERE variant LIKE 'rolling%'",
)


def _weighted_panel(lb: Lab):
    spec = ladder_specs()[3]
    w = scoring.rolling_ic_weights(lb.months.select("month"), lb.ic_expanding, spec)
    joined = lb.panel.filter("eligible").join(F.broadcast(w), "month", "left")
    return joined.select(
        "ticker",
        "month",
        scoring.weighted_score(
            [F.col(spec.factor_column(f)) for f in FACTORS], [F.col(f"weight_{f}") for f in FACTORS]
        ).alias("score"),
    )


add(
    "factor_coverage",
    "n_rows:i factor n_available:i",
    lambda lb: scoring.factor_coverage(
        lb.panel.filter(F.col("month") == F.lit(LIVE_MONTH)), panel_plan.LIVE_Z
    ),
    " UNION ALL ".join(
        f"SELECT (SELECT count(*) FROM panel WHERE month = DATE '{LIVE_MONTH}') AS n_rows, '{c}' AS factor, "
        f"(SELECT count({c}) FROM panel WHERE month = DATE '{LIVE_MONTH}') AS n_available"
        for c in panel_plan.LIVE_Z
    ),
)
add(
    "coverage_by_month",
    "month n_eligible:i n_signal:i coverage_pct:6",
    lambda lb: tables.coverage_by_month(lb.panel, "trend_hzz_z"),
    "SELECT month, count(*) FILTER (eligible) AS n_eligible, count(trend_hzz_z) AS n_signal, "
    "count(trend_hzz_z) * 100.0 / nullif(count(*) FILTER (eligible), 0) AS coverage_pct FROM panel GROUP BY month",
)
add(
    "median_diagnostics",
    "n_beta_months:i median_cross_section_size:3 median_r_squared:6 n_smoothed_months_usable:i first_usable_month",
    lambda lb: _trend_fit_diagnostics(lb),
    "SELECT b.*, s.* FROM (SELECT count(*) AS n_beta_months, median(n) AS median_cross_section_size, "
    "median(r2) AS median_r_squared FROM hz_b) b, (SELECT count(b0) AS n_smoothed_months_usable, "
    "min(month) FILTER (b0 IS NOT NULL) AS first_usable_month FROM hzz_smooth) s",
)


def _trend_fit_diagnostics(lb: Lab):
    """Size and fit of the monthly cross-sectional trend regressions, and from when on their smoothed betas can be used."""
    betas = panel_plan.hzz_betas(lb.panel, bars.ma_ratio(lb.signals, CFG.ma_windows), CFG, lb.ws)
    betas = lb.ws.materialise(betas, "trend_betas")
    return tables.median_diagnostics(betas, regress.smooth_betas(betas, CFG.ratio_cols, CFG.beta_smoothing))


add(
    "live_eligibility",
    "ticker month eligible",
    lambda lb: live.live_eligibility(lb.panel, CFG.price_floor),
    f"SELECT ticker, month, coalesce(close > {CFG.price_floor} AND coalesce({', '.join(panel_plan.LIVE_Z)}) IS NOT NULL, FALSE) "
    "AS eligible FROM panel",
)
add(
    "live_targets",
    "month rank:i ticker score:6",
    lambda lb: live.live_targets(lb.panel, LIVE_MONTH, 10, CFG.price_floor),
    "SELECT * FROM live WHERE strategy = 'live'",
)
add(
    "rebalance_diff",
    "strategy ticker action",
    lambda lb: _orders(lb),
    "SELECT * FROM diff",
)
add(
    "monthly_rebalance",
    "strategy ticker action rank:i score:6 quantity:i stop_price:2 take_price:2",
    lambda lb: _orders(lb),
    "SELECT d.strategy, d.ticker, d.action, l.rank, l.score, CASE WHEN d.action = 'enter' THEN CASE d.strategy "
    f"WHEN 'live' THEN floor({CFG.cash_per_trade} / l.close) ELSE greatest(floor(0.05 * 1000000.0 / l.close), 1) END END AS quantity, "
    "CASE WHEN d.action = 'enter' THEN round(l.close * (1 - CASE d.strategy WHEN 'live' THEN 0.05 ELSE 0.10 END), 2) END AS stop_price, "
    "CASE WHEN d.action = 'enter' THEN round(l.close * (1 + CASE d.strategy WHEN 'live' THEN 0.30 ELSE 0.20 END), 2) END AS take_price "
    "FROM diff d LEFT JOIN live l USING (strategy, ticker)",
)
add(
    "next_state",
    "last_rebalance strategy ticker",
    lambda lb: _stored(lb),
    f"SELECT '{LIVE_MONTH}' AS last_rebalance, strategy, ticker FROM live",
)


def _orders(lb: Lab):
    return live.monthly_rebalance(
        lb.panel, lb.live_state(), LIVE_MONTH, LIVE_PORTFOLIOS, CFG.price_floor, 1_000_000.0, CFG.cash_per_trade
    )


def _stored(lb: Lab):
    """The state after the rebalance, written and read back."""
    path = lb.ws.path("state")
    live.rebalance_and_store(_orders(lb), path, LIVE_MONTH)
    return sinks.read_state(lb.spark, path)
