"""Queries over sources, filters, bars, point-in-time joins and window signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorlab.catalog.context import CFG, TREND_COEFS, Lab, all_specs
from factorlab.catalog.registry import add
from factorlab.catalog.sql import CUT, EVAL, W
from factorlab.functions.nulls import finite
from factorlab.functions.stats import hash_int
from factorlab.operators import audit, bars, joins, portfolio, ranks, regress, tables, xsection
from factorlab.plans import panel as panel_plan
from factorlab.sources import fixture, scans, sinks

BARS = "ticker date open high low close volume adjOpen adjHigh adjLow adjClose adjVolume"
DEV = " ".join(f"ma_dev_{w}:9" for w in W)

# ----------------------------------------------------------------- sources


def _written(lb: Lab, df, name: str, fmt: str = "parquet") -> str:
    return sinks.sink_table(df, lb.ws.path(name), fmt)


add(
    "scan_prices",
    BARS,
    lambda lb: scans.scan_prices(lb.spark, _written(lb, fixture.prices(lb.spark, lb.sf_dir), "prices"), CFG.cutoff),
    "SELECT * FROM prices",
)
add(
    "scan_daily_metrics",
    "ticker date marketCap peRatio pbRatio trailingPEG1Y",
    lambda lb: scans.scan_daily_metrics(
        lb.spark, _written(lb, fixture.daily_metrics(lb.spark, lb.sf_dir), "metrics"), CFG.cutoff
    ),
    "SELECT * FROM daily_metrics",
)
add(
    "scan_statements",
    "ticker date_available fiscal_year:i fiscal_quarter:i statement_type data_code value",
    lambda lb: scans.scan_statements(
        lb.spark, _written(lb, fixture.statements(lb.spark, lb.sf_dir), "statements"), CFG.cutoff
    ),
    "SELECT * FROM statements",
)
add(
    "scan_constituents",
    "Symbol Security sector sub_industry",
    lambda lb: scans.scan_constituents(lb.spark, _written(lb, lb.constituents, "constituents", "csv"), "csv"),
    "SELECT * FROM constituents",
)
add(
    "scan_index",
    "date open high low close adj_close volume",
    lambda lb: scans.scan_index(lb.spark, _written(lb, fixture.index_daily(lb.spark, lb.sf_dir), "index"), CFG.cutoff),
    "SELECT * FROM index_daily",
)
add(
    "normalise_index_columns",
    "date open high low close adj_close volume",
    lambda lb: scans.normalise_index_columns(
        lb.index_daily.select(
            F.col("date").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"),
            F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"),
        )
    ),
    "SELECT date, open, high, low, close, close AS adj_close, volume FROM index_daily",
)
add(
    "scan_panel_checkpoint",
    "dataset n_rows:i",
    lambda lb: _checkpoint(lb),
    "SELECT 'monthly' AS dataset, count(*) AS n_rows FROM stock_months UNION ALL "
    "SELECT 'index', count(*) FROM index_months",
)


def _checkpoint(lb: Lab):
    paths = {"monthly": _written(lb, lb.monthly, "ckpt"), "index": _written(lb, lb.index_months, "ckpt")}
    got = scans.scan_panel_checkpoint(lb.spark, paths)
    return tables.union_runs(
        *[df.agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("dataset"), "n_rows") for k, df in got.items()]
    )


add(
    "scan_curves",
    "strategy month portfolio_return:6 equity:2 n_positions:i",
    lambda lb: _curve_files(lb),
    "SELECT * FROM curves",
)


def _curve_files(lb: Lab):
    root = sinks.sink_by_strategy(lb.curves.drop("scenario"), lb.ws.path("by_strategy"))
    names = {s: f"{root}/strategy={s}" for s in (*[x.name for x in all_specs()], "absent_variant")}
    return scans.scan_curves(lb.spark, names)


add(
    "sink_table",
    BARS,
    lambda lb: scans.read_table(
        lb.spark, _written(lb, lb.prices, "csv_out", "csv"), scans.schemas.PRICES, "csv"
    ),
    "SELECT * FROM prices",
)
add(
    "sink_by_strategy",
    "strategy n_rows:i total_return_sum:6",
    lambda lb: lb.spark.read.parquet(sinks.sink_by_strategy(lb.curves, lb.ws.path("split")))
    .groupBy("strategy")
    .agg(F.count("*").alias("n_rows"), F.sum("portfolio_return").alias("total_return_sum")),
    "SELECT strategy, count(*) AS n_rows, sum(portfolio_return) AS total_return_sum FROM curves GROUP BY strategy",
)
add(
    "read_state",
    "last_rebalance strategy ticker",
    lambda lb: lb.live_state(),
    "SELECT '2001-08-31' AS last_rebalance, strategy, ticker FROM live_prev",
)
add(
    "write_state",
    "strategy n_holdings:i first_ticker",
    lambda lb: lb.live_state()
    .groupBy("strategy")
    .agg(F.count("*").alias("n_holdings"), F.min("ticker").alias("first_ticker")),
    "SELECT strategy, count(*) AS n_holdings, min(ticker) AS first_ticker FROM live_prev GROUP BY strategy",
)

# ----------------------------------------------------------------- filters
add(
    "cutoff_filter",
    "ticker n:i last_date",
    lambda lb: scans.cutoff_filter(fixture.ticks(lb.spark, lb.sf_dir), CFG.cutoff)
    .groupBy("ticker")
    .agg(F.count("*").alias("n"), F.max("date").alias("last_date")),
    f"SELECT ticker, count(*) AS n, max(date) AS last_date FROM ticks WHERE date <= {CUT} GROUP BY ticker",
)
add(
    "eval_window_filter",
    "ticker month close",
    lambda lb: scans.eval_window_filter(lb.monthly, CFG.evaluation_start),
    f"SELECT * FROM stock_months WHERE month >= {EVAL}",
)
add(
    "valid_bar_filter",
    "ticker date open high low close",
    lambda lb: bars.valid_bar_filter(
        lb.prices.withColumn("low", F.when(F.col("volume") > 10, F.col("low"))).withColumn(
            "open", F.when(F.col("volume") == 20, 0.0).otherwise(F.col("open"))
        )
    ),
    "SELECT ticker, date, open, high, low, close FROM prices WHERE volume > 10 AND volume <> 20",
)
add(
    "min_history_filter",
    "ticker n_bars:i",
    lambda lb: bars.history_length(bars.min_history_filter(lb.prices, 530)),
    "SELECT ticker, count(*) AS n_bars FROM prices GROUP BY ticker HAVING count(*) >= 530",
)
add(
    "min_history_skipped",
    "ticker",
    lambda lb: bars.short_history(lb.constituents.select(F.col("Symbol").alias("ticker")), lb.prices, 530),
    "SELECT Symbol AS ticker FROM constituents WHERE Symbol NOT IN "
    "(SELECT ticker FROM prices GROUP BY ticker HAVING count(*) >= 530)",
)
add(
    "price_floor_eligibility",
    "ticker month raw_close eligible_price",
    lambda lb: bars.price_floor_eligibility(bars.monthly_bars(lb.prices), CFG.price_floor),
    "SELECT * FROM stock_months",
)
add(
    "tradeable_eligibility",
    "ticker month eligible",
    lambda lb: panel_plan.tradeable_eligibility(lb.monthly),
    "SELECT ticker, month, coalesce(eligible_price AND next_ret_cc IS NOT NULL AND next_ret_oc IS NOT NULL "
    "AND next_open > 0, FALSE) AS eligible FROM stock_months",
)
add(
    "positive_pe_clean",
    "ticker month pe_clean",
    lambda lb: panel_plan.positive_pe_clean(
        bars.monthly_metrics(lb.daily_metrics).withColumn(
            "pe_ratio", F.when(F.col("pe_ratio") > 60, -F.col("pe_ratio")).otherwise(F.col("pe_ratio"))
        )
    ),
    "SELECT ticker, month, CASE WHEN pe_ratio > 0 AND pe_ratio <= 60 THEN pe_ratio END AS pe_clean FROM metrics_m",
)
add(
    "nonfinite_to_null",
    "ticker date x:6",
    lambda lb: lb.prices.select(
        "ticker",
        "date",
        finite(
            F.when(F.col("volume") < 10, F.lit(float("nan")))
            .when(F.col("volume") < 20, F.lit(float("inf")))
            .otherwise(F.col("close") / F.col("open"))
        ).alias("x"),
    ),
    "SELECT ticker, date, CASE WHEN volume >= 20 THEN close / open END AS x FROM prices",
)
add(
    "month_end_row",
    "ticker month date adjClose",
    lambda lb: bars.month_end_row(lb.prices),
    "SELECT ticker, last_day(date) AS month, max(date) AS date, arg_max(adjClose, date) AS adjClose FROM prices "
    "GROUP BY ticker, last_day(date)",
)
add(
    "selected_date_snapshot",
    "ticker month close",
    lambda lb: xsection.selected_date_snapshot(lb.monthly, "2000-12-31"),
    "SELECT * FROM stock_months WHERE month = (SELECT max(month) FROM stock_months WHERE month <= DATE '2000-12-31')",
)
add(
    "membership_filter",
    "ticker n:i",
    lambda lb: joins.membership_filter(lb.prices, lb.holdings).groupBy("ticker").agg(F.count("*").alias("n")),
    "SELECT ticker, count(*) AS n FROM prices WHERE ticker IN (SELECT ticker FROM holdings) GROUP BY ticker",
)
add(
    "missing_tickers",
    "ticker",
    lambda lb: joins.missing_tickers(
        lb.constituents.select(F.col("Symbol").alias("ticker")), lb.prices
    ),
    "SELECT Symbol AS ticker FROM constituents EXCEPT SELECT ticker FROM prices",
)
add(
    "conditional_overwrite",
    "ticker month r",
    lambda lb: lb.monthly.select(
        "ticker",
        "month",
        portfolio.conditional_overwrite(F.col("next_ret_cc"), F.col("next_ret_cc") < -0.1, F.lit(-0.1)).alias("r"),
    ),
    "SELECT ticker, month, CASE WHEN next_ret_cc < -0.1 THEN -0.1::DOUBLE ELSE next_ret_cc END AS r FROM stock_months",
)

# ------------------------------------------------------------------- joins
add(
    "asof_fundamental_join",
    "ticker month roe",
    lambda lb: joins.asof_fundamental(
        joins.distinct_pairs(lb.prices.withColumn("month", F.last_day("date"))), lb.statements
    ),
    "SELECT * FROM roe_m",
)
add(
    "panel_assembly",
    "ticker month close market_cap pe_ratio roe " + " ".join(f"ma_dev_{w}:9" for w in W),
    lambda lb: joins.panel_assembly(
        lb.monthly,
        bars.monthly_metrics(lb.daily_metrics),
        joins.asof_fundamental(joins.distinct_pairs(bars.monthly_bars(lb.prices)), lb.statements),
        bars.ma_deviation(lb.prices, W, "adjClose"),
    ),
    f"SELECT m.ticker, m.month, m.close, k.market_cap, k.pe_ratio, r.roe, {', '.join(f's.ma_dev_{w}' for w in W)} FROM stock_months m "
    "LEFT JOIN metrics_m k USING (ticker, month) LEFT JOIN roe_m r USING (ticker, month) "
    "LEFT JOIN ma_sig s USING (ticker, month)",
)
add(
    "sector_enrich",
    "ticker month Security sector sub_industry",
    lambda lb: joins.sector_enrich(bars.monthly_bars(lb.prices), lb.constituents),
    "SELECT m.ticker, m.month, c.Security, c.sector, c.sub_industry FROM monthly_bars m "
    "LEFT JOIN constituents c ON c.Symbol = m.ticker",
)
add(
    "index_enrich",
    "ticker month index_close:6 sma_10m:6 regime_on",
    lambda lb: joins.index_enrich(bars.monthly_bars(lb.prices), lb.index_tables[1]),
    "SELECT m.ticker, m.month, i.close AS index_close, i.sma_10m, i.regime_on FROM monthly_bars m "
    "LEFT JOIN index_months i USING (month)",
)
add(
    "factor_history_join",
    f"month next_ret:9 {DEV}",
    lambda lb: panel_plan.index_history(*reversed(lb.index_tables), CFG),
    "SELECT m.month, m.next_ret, a.* EXCLUDE (month) FROM index_months m LEFT JOIN idx_ma a USING (month)",
)
add(
    "betas_to_stocks",
    "ticker month intercept:9 " + " ".join(f"ma_ratio_{w}:9 beta_{w}:9" for w in W),
    lambda lb: bars.ma_ratio(lb.ma_signals, W).join(
        F.broadcast(lb.smoothed_betas.select("month", "intercept", *[F.col(f"ma_ratio_{w}").alias(f"beta_{w}") for w in W])), "month", "left"
    ),
    "SELECT r.ticker, r.month, 0.0001 * month(month) AS intercept, "
    + ", ".join(f"ma_ratio_{w}, {TREND_COEFS[w]} * (0.1 * (year(month) - 1990)) AS beta_{w}" for w in W)
    + " FROM ma_ratios r",
)
add(
    "distinct_pairs",
    "ticker month",
    lambda lb: joins.distinct_pairs(lb.prices.withColumn("month", F.last_day("date"))),
    "SELECT DISTINCT ticker, last_day(date) AS month FROM prices",
)
add(
    "last_per_key",
    "month ticker date close",
    lambda lb: joins.last_per_key(
        lb.prices.select(F.last_day("date").alias("month"), "ticker", "date", "close"),
        ["month"],
        [F.col("date"), F.col("ticker")],
    ),
    "SELECT month, ticker, date, close FROM (SELECT last_day(date) AS month, ticker, date, close, "
    "row_number() OVER (PARTITION BY last_day(date) ORDER BY date DESC, ticker DESC) AS k FROM prices) WHERE k = 1",
)
add(
    "nearest_year_join",
    "month scenario schedule_year:i commission_bps_per_side:6 slippage_bps_per_side:6 round_trip_bps:6",
    lambda lb: joins.nearest_year_join(
        lb.index_tables[1].select(
            F.add_months("month", 12 * 9).alias("month"), F.explode(F.array(F.lit("central"), F.lit("zero"))).alias("scenario")
        ),
        portfolio.cost_schedule(lb.spark),
    ),
    "SELECT month, scenario, year AS schedule_year, commission_bps_per_side, slippage_bps_per_side, round_trip_bps FROM ("
    "SELECT m.month, s.*, row_number() OVER (PARTITION BY m.month, s.scenario ORDER BY abs(s.year - year(m.month)), s.year) AS k "
    "FROM (SELECT (month + INTERVAL 108 MONTH)::DATE AS month FROM index_months) m CROSS JOIN schedule s "
    "WHERE s.scenario IN ('central', 'zero')) WHERE k = 1",
)

# ------------------------------------------------------------ aggregations
MB = "ticker month first_date last_date open high low close raw_close volume"
add("monthly_bars", MB, lambda lb: bars.monthly_bars(lb.prices), "SELECT * FROM monthly_bars")
add(
    "index_monthly_bars",
    "month first_date last_date open high low close volume",
    lambda lb: bars.index_monthly_bars(lb.index_daily),
    "SELECT * FROM index_monthly_bars",
)
add(
    "monthly_metrics",
    "ticker month market_cap pe_ratio pb_ratio trailing_peg_1y",
    lambda lb: bars.monthly_metrics(lb.daily_metrics),
    "SELECT * FROM metrics_m",
)
add(
    "live_month_close",
    "ticker month close",
    lambda lb: bars.live_month_close(lb.prices),
    "SELECT ticker, month, close FROM monthly_bars",
)


def _audit_sql(name: str, table: str, ticker: str, lo: str, hi: str, key: str) -> str:
    return (
        f"SELECT '{name}' AS dataset, count(*) AS rows, {ticker} AS tickers, {lo} AS min_date, {hi} AS max_date, "
        f"count(*) FILTER ({key} IS NULL) AS missing_key_value FROM {table}"
    )


add(
    "data_audit",
    "dataset rows:i tickers:i min_date max_date missing_key_value:i",
    lambda lb: audit.data_audit(
        lb.prices, lb.daily_metrics, lb.statements, lb.constituents, lb.index_tables[0], lb.panel
    ),
    " UNION ALL ".join(
        [
            _audit_sql("prices", "prices", "count(DISTINCT ticker)", "min(date)", "max(date)", "adjClose"),
            _audit_sql("daily_fundamentals", "daily_metrics", "count(DISTINCT ticker)", "min(date)", "max(date)", "peRatio"),
            _audit_sql(
                "statements", "statements", "count(DISTINCT ticker)", "min(date_available)", "max(date_available)", "value"
            ),
            _audit_sql("constituents", "constituents", "count(DISTINCT Symbol)", "NULL::DATE", "NULL::DATE", "Symbol"),
            _audit_sql("index", "index_daily", "1", "min(date)", "max(date)", "adj_close"),
            _audit_sql("factor_panel", "panel", "count(DISTINCT ticker)", "min(month)", "max(month)", "composite_score"),
        ]
    ),
)

# ----------------------------------------------------------------- windows
add(
    "prev_next_bars",
    "ticker month prev_close next_open next_high next_low next_close",
    lambda lb: bars.prev_next_bars(bars.monthly_bars(lb.prices)),
    "SELECT * FROM stock_months",
)
add(
    "forward_returns",
    "ticker month ret_1m_cc next_ret_cc next_ret_oc",
    lambda lb: bars.forward_returns(bars.prev_next_bars(bars.monthly_bars(lb.prices))),
    "SELECT * FROM stock_months",
)
add(
    "momentum_k",
    "ticker month momentum_12m",
    lambda lb: bars.momentum_k(bars.monthly_bars(lb.prices), 12),
    "SELECT * FROM stock_months",
)
add(
    "index_returns",
    "month close ret_1m next_ret",
    lambda lb: bars.index_returns(bars.index_monthly_bars(lb.index_daily)),
    "SELECT * FROM index_months",
)
add(
    "sma_regime",
    "month close sma_10m:8 regime_on",
    lambda lb: bars.sma_regime(bars.index_monthly_bars(lb.index_daily), CFG.sma_months),
    "SELECT * FROM index_months",
)
add("ma_deviation", f"ticker month {DEV}", lambda lb: lb.ma_signals, "SELECT * FROM ma_sig")
add(
    "ma_deviation_index",
    f"month {DEV}",
    lambda lb: bars.ma_deviation(lb.index_daily, W, "adj_close", key=None),
    "SELECT * FROM idx_ma",
)
add(
    "ma_deviation_latest",
    f"ticker month {DEV}",
    lambda lb: bars.ma_deviation_latest(lb.prices, W, "adjClose"),
    "SELECT * FROM ma_sig QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY month DESC) = 1",
)
add(
    "ma_ratio",
    "ticker month " + " ".join(f"ma_ratio_{w}:9" for w in W),
    lambda lb: bars.ma_ratio(lb.ma_signals, W),
    "SELECT * FROM ma_ratios",
)


def _panel_slice(lb: Lab):
    # Ranking writes and moves what it is given.
    return lb.panel.filter("eligible").select("month", "ticker", "roe_z")


add(
    "rank_first",
    "month ticker rank:i",
    lambda lb: ranks.rank_first(
        _panel_slice(lb).filter("roe_z is not null"), ["month"], ["roe_z", "ticker"], "rank", lb.ws
    ),
    "SELECT month, ticker, row_number() OVER (PARTITION BY month ORDER BY roe_z, ticker) AS rank FROM panel "
    "WHERE eligible AND roe_z IS NOT NULL",
)
add(
    "rank_first_split",
    "month ticker rank:i",
    lambda lb: ranks.rank_first(
        _panel_slice(lb).filter("roe_z is not null"), ["month"], ["roe_z", "ticker"], "rank", lb.ws
    ),
    "SELECT month, ticker, row_number() OVER (PARTITION BY month ORDER BY roe_z, ticker) AS rank FROM panel "
    "WHERE eligible AND roe_z IS NOT NULL",
)
_AVG_RANK = (
    "SELECT month, ticker, rank() OVER (PARTITION BY month ORDER BY roe_z) "
    "+ (count(*) OVER (PARTITION BY month, roe_z) - 1) / 2.0 AS rank FROM panel WHERE eligible AND roe_z IS NOT NULL"
)
add(
    "rank_average",
    "month ticker rank:1",
    lambda lb: ranks.rank_average(
        _panel_slice(lb).filter("roe_z is not null"), ["month"], "roe_z", "ticker", "rank", lb.ws
    ),
    _AVG_RANK,
)
add(
    "rank_average_split",
    "month ticker rank:1",
    lambda lb: ranks.rank_average(
        _panel_slice(lb).filter("roe_z is not null"), ["month"], "roe_z", "ticker", "rank", lb.ws
    ),
    _AVG_RANK,
)
_QUANT = (
    "SELECT month, count(pe_factor) AS n, quantile_cont(pe_factor, 0.01) AS q01, quantile_cont(pe_factor, 0.99) AS q99 "
    "FROM panel WHERE pe_factor IS NOT NULL GROUP BY month"
)


def _quantile_plan(lb: Lab):
    q = ranks.quantiles(lb.panel.select("month", "pe_factor"), ["month"], "pe_factor", [0.01, 0.99])
    return q.select("month", "n", F.col("q")[0].alias("q01"), F.col("q")[1].alias("q99"))


add("winsor_quantiles", "month n:i q01:5 q99:5", _quantile_plan, _QUANT)
add("winsor_quantiles_split", "month n:i q01:5 q99:5", _quantile_plan, _QUANT)
add(
    "quintile_bucket",
    "month factor ticker rank:i quintile:i",
    lambda lb: xsection.quintile_legs(lb.factor_long, lb.ws),
    "SELECT * FROM legs",
)

# ------------------------------------------- scalar functions and hash draws
add(
    "hash_draws",
    "sim:i month draw:i",
    lambda lb: lb.index_tables[1].select("month", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("sim")).select(
        "sim", "month", hash_int(CFG.seed, F.col("sim"), F.col("month"), 0).alias("draw")
    ),
    f"SELECT sim, month, ('0x' || substr(md5(concat_ws('|', {CFG.seed}, sim, month, 0)), 1, 12))::BIGINT AS draw "
    "FROM index_months CROSS JOIN range(10) r(sim)",
)

# -------------------------------------------------------------- regressions
add(
    "apply_trend",
    "ticker month trend_raw:9",
    lambda lb: regress.apply_trend(lb.ma_signals, lb.trend_coefs, CFG.dev_cols, "trend_raw"),
    "SELECT * FROM trend_m",
)
add(
    "apply_trend_expanding",
    "ticker month trend_expanding_raw:9",
    lambda lb: regress.apply_trend(lb.ma_signals, lb.expanding_coefs, CFG.dev_cols, "trend_expanding_raw"),
    "SELECT * FROM trend_m",
)
add(
    "hzz_predict",
    "ticker month trend_hzz_raw:9",
    lambda lb: regress.hzz_predict(bars.ma_ratio(lb.ma_signals, W), lb.smoothed_betas, CFG.ratio_cols),
    "SELECT * FROM hzz_m",
)
_VARS = "concat_ws('|', " + ", ".join(f"CASE WHEN a.p_{c} <= {CFG.trend_alpha} THEN '{c}' END" for c in CFG.dev_cols) + ")"


def _full_fit(lb: Lab):
    return regress.index_trend_full(panel_plan.index_history(*reversed(lb.index_tables), CFG), CFG.dev_cols, CFG)


add(
    "index_trend_full",
    "series_id term coefficient:6 full_model_p_value:6 refit_p_value:6 selected n_obs:i r_squared_refit:6 selected_variables",
    lambda lb: _full_fit(lb).withColumn("selected_variables", F.array_join("selected_variables", "|")),
    " UNION ALL ".join(
        f"SELECT 'index' AS series_id, '{t}' AS term, b.b{v} AS coefficient, a.p{v} AS full_model_p_value, "
        f"CASE WHEN {sel} THEN b.p{v} END AS refit_p_value, {sel} AS selected, b.n AS n_obs, b.r2 AS r_squared_refit, "
        f"{_VARS} AS selected_variables FROM fta_p a JOIN ftb_p b USING (g)"
        for t, v, sel in [("const", "0", "TRUE"), *[(c, f"_{c}", f"a.p_{c} <= {CFG.trend_alpha}") for c in CFG.dev_cols]]
    ),
)
add(
    "expanding_trend_betas",
    "series_id month n_obs:i r_squared_refit:6 selected_variables intercept:7 " + " ".join(f"{c}:6" for c in CFG.dev_cols),
    lambda lb: regress.expanding_trend_betas(
        panel_plan.index_history(*reversed(lb.index_tables), CFG), CFG.dev_cols, CFG
    ).withColumn("selected_variables", F.array_join("selected_variables", "|")),
    f"SELECT 'index' AS series_id, a.g AS month, b.n AS n_obs, b.r2 AS r_squared_refit, {_VARS} AS selected_variables, "
    "b.b0 AS intercept, " + ", ".join(f"b.b_{c} AS {c}" for c in CFG.dev_cols) + " FROM eta_p a JOIN etb_b b USING (g)",
)
add(
    "expanding_history",
    "month n_train:i",
    lambda lb: _expanding_counts(lb),
    "SELECT month, count(*) FILTER (ok) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_train "
    "FROM (SELECT m.month, next_ret IS NOT NULL AND ma_dev_200 IS NOT NULL AS ok FROM index_months m JOIN idx_ma USING (month))",
)


def _expanding_counts(lb: Lab):
    from pyspark.sql import Window

    h = panel_plan.index_history(*reversed(lb.index_tables), CFG)
    ok = F.col("next_ret").isNotNull()
    for c in CFG.dev_cols:
        ok = ok & F.col(c).isNotNull()
    w = Window.partitionBy("series_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    return h.select("month", F.count(F.when(ok, 1)).over(w).alias("n_train"))


add(
    "xs_multivariate_betas",
    "month n_obs:i r_squared:6 intercept:5 " + " ".join(f"{c}:5" for c in CFG.ratio_cols),
    lambda lb: panel_plan.hzz_betas(lb.panel, bars.ma_ratio(lb.signals, W), CFG, lb.ws),
    "SELECT g AS month, n AS n_obs, r2 AS r_squared, b0 AS intercept, "
    + ", ".join(f"b_{c} AS {c}" for c in CFG.ratio_cols)
    + " FROM hz_b",
)
add(
    "xs_moments",
    "month n_obs:i mean_y:9 syy:6 s_y3:6 s_33:6",
    lambda lb: regress.xs_moments(
        lb.panel.filter("eligible_price").select("ticker", "month", "next_ret_cc").join(
            bars.ma_ratio(lb.ma_signals, W), ["ticker", "month"]
        ),
        "next_ret_cc",
        CFG.ratio_cols,
        "month",
        CFG.min_names_multivariate,
    ).select(
        "month",
        "n_obs",
        F.col("means")[0].alias("mean_y"),
        F.col("cross")[0].alias("syy"),
        F.col("cross")[1].alias("s_y3"),
        F.col("cross")[len(W) + 1].alias("s_33"),
    ),
    f"SELECT month, count(*) AS n_obs, avg(next_ret_cc) AS mean_y, regr_syy(next_ret_cc, ma_ratio_3) AS syy, "
    "regr_sxy(next_ret_cc, ma_ratio_3) AS s_y3, regr_sxx(next_ret_cc, ma_ratio_3) AS s_33 "
    "FROM panel JOIN ma_ratios USING (ticker, month) WHERE eligible_price AND next_ret_cc IS NOT NULL AND "
    + " AND ".join(f"ma_ratio_{w} IS NOT NULL" for w in W)
    + f" GROUP BY month HAVING count(*) >= {CFG.min_names_multivariate}",
)
add(
    "smooth_betas",
    "month intercept:9 ma_ratio_3:9 ma_ratio_200:9 smoothed_window:i smoothed_n_obs:6",
    lambda lb: regress.smooth_betas(lb.smoothed_betas.withColumn("n_obs", F.month("month")), CFG.ratio_cols, 12),
    "SELECT month, CASE WHEN c = 12 THEN a END AS intercept, CASE WHEN c = 12 THEN b END AS ma_ratio_3, "
    "CASE WHEN c = 12 THEN d END AS ma_ratio_200, 12 AS smoothed_window, CASE WHEN c = 12 THEN e END AS smoothed_n_obs FROM ("
    "SELECT month, count(*) OVER w AS c, avg(0.0001 * month(month)) OVER w AS a, avg(0.05 * (0.1 * (year(month) - 1990))) OVER w AS b, "
    "avg(0.005 * (0.1 * (year(month) - 1990))) OVER w AS d, avg(month(month)) OVER w AS e FROM index_months "
    "WINDOW w AS (ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))",
)
add(
    "selected_variables",
    "lag:i coefficient:6 selected",
    lambda lb: regress.selected_variables(_full_fit(lb)),
    " UNION ALL ".join(
        f"SELECT {w} AS lag, b.b_ma_dev_{w} AS coefficient, a.p_ma_dev_{w} <= {CFG.trend_alpha} AS selected "
        "FROM fta_p a JOIN ftb_b b USING (g)"
        for w in W
    ),
)
