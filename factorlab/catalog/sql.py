"""The same pipeline as ANSI-style SQL common table expressions, for checking.

``oracle(query)`` prefixes a query with the expressions it needs, in order.
"""

from __future__ import annotations

import re

from factorlab.catalog.context import (
    LIVE_MONTH,
    PREVIOUS_MONTH,
    LIVE_PORTFOLIOS,
    TRADE_STOP,
    TRADE_TAKE,
    TREND_COEFS,
    TREND_INTERCEPT,
    all_specs,
    grid_specs,
)
from factorlab.config import CENTRAL_COST_BPS, COST_SCENARIOS, FACTORS
from factorlab.sources.fixture import FIXTURE_CONFIG as CFG

W = CFG.ma_windows
CUT = f"DATE '{CFG.cutoff}'"
EVAL = f"DATE '{CFG.evaluation_start}'"
TRAIN = f"DATE '{CFG.train_end}'"
Z = {
    "roe_factor": "roe_z",
    "pe_factor": "pe_z",
    "momentum_factor": "momentum_z",
    "trend_factor": "trend_z",
    "trend_expanding_factor": "trend_expanding_z",
}
CTE: dict[str, str] = {}

CTE["ticks"] = """
SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey * 8 + l_linenumber AS ord,
       100 + l_extendedprice / 2500 AS px, (100 + l_extendedprice / 2500) * (1 - l_discount) AS apx,
       l_quantity AS qty, l_extendedprice AS ext, l_extendedprice * l_tax AS ext_tax,
       l_extendedprice * l_discount AS ext_disc
FROM lineitem"""
CTE["prices"] = f"""
SELECT ticker, date, arg_min(px, ord) AS open, max(px) AS high, min(px) AS low, arg_max(px, ord) AS close,
       sum(qty) AS volume, arg_min(apx, ord) AS adjOpen, max(apx) AS adjHigh, min(apx) AS adjLow,
       arg_max(apx, ord) AS adjClose, sum(qty) AS adjVolume
FROM ticks WHERE date <= {CUT} GROUP BY ticker, date"""
CTE["daily_metrics"] = f"""
SELECT ticker, date, round(sum(ext), 2) AS marketCap, round(sum(ext) / nullif(sum(ext_tax), 0), 6) AS peRatio,
       round(sum(ext) / nullif(sum(qty), 0), 10) AS pbRatio, CAST(NULL AS DOUBLE) AS trailingPEG1Y
FROM ticks WHERE date <= {CUT} GROUP BY ticker, date"""
CTE["statements"] = f"""
SELECT * FROM (
  SELECT ticker, last_day(make_date(year(date), quarter(date) * 3, 1)) + 45 AS date_available, year(date) AS fiscal_year,
         quarter(date) AS fiscal_quarter, 'overview' AS statement_type, 'roe' AS data_code,
         round(sum(ext_disc) / nullif(sum(ext), 0), 8) AS value
  FROM ticks GROUP BY ticker, year(date), quarter(date)
  UNION ALL
  SELECT ticker, last_day(make_date(year(date), 12, 1)) + 45, year(date), 0, 'overview', 'roe',
         round(sum(ext_disc) / nullif(sum(ext), 0), 8)
  FROM ticks GROUP BY ticker, year(date))
WHERE date_available <= {CUT}"""
CTE["constituents"] = """
SELECT 'S' || s_suppkey AS Symbol, s_name AS Security, n_name AS sector, r_name AS sub_industry
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _level(c: str) -> str:
    return f"sum(CAST(round({c} * 1e8) AS BIGINT))::DOUBLE / count({c}) / 1e8"


CTE["index_daily"] = f"""
SELECT date, {_level('open')} AS open, {_level('high')} AS high, {_level('low')} AS low, {_level('close')} AS close,
       {_level('adjClose')} AS adj_close, sum(volume) AS volume
FROM prices GROUP BY date"""
CTE["monthly_bars"] = """
SELECT ticker, last_day(date) AS month, min(date) AS first_date, max(date) AS last_date,
       arg_min(adjOpen, date) AS open, max(adjHigh) AS high, min(adjLow) AS low, arg_max(adjClose, date) AS close,
       arg_max(close, date) AS raw_close, sum(adjVolume) AS volume
FROM prices GROUP BY ticker, last_day(date)"""
CTE["stock_months"] = f"""
SELECT *, close / nullif(prev_close, 0) - 1 AS ret_1m_cc, next_close / nullif(close, 0) - 1 AS next_ret_cc,
       next_close / nullif(next_open, 0) - 1 AS next_ret_oc, close / nullif(lag12, 0) - 1 AS momentum_12m,
       coalesce(raw_close >= {CFG.price_floor}, FALSE) AS eligible_price
FROM (SELECT *, lag(close) OVER w AS prev_close, lead(open) OVER w AS next_open, lead(high) OVER w AS next_high,
             lead(low) OVER w AS next_low, lead(close) OVER w AS next_close, lag(close, 12) OVER w AS lag12
      FROM monthly_bars WINDOW w AS (PARTITION BY ticker ORDER BY month))"""
CTE["index_monthly_bars"] = """
SELECT last_day(date) AS month, min(date) AS first_date, max(date) AS last_date, arg_min(open, date) AS open,
       max(high) AS high, min(low) AS low, arg_max(adj_close, date) AS close, sum(volume) AS volume
FROM index_daily GROUP BY last_day(date)"""
CTE["index_months"] = """
SELECT *, coalesce(close > sma_10m, FALSE) AS regime_on FROM (
  SELECT *, close / lag(close) OVER w - 1 AS ret_1m, lead(close) OVER w / close - 1 AS next_ret,
         CASE WHEN count(close) OVER (w ROWS 9 PRECEDING) = 10 THEN avg(close) OVER (w ROWS 9 PRECEDING) END AS sma_10m
  FROM index_monthly_bars WINDOW w AS (ORDER BY month))"""
CTE["metrics_m"] = """
SELECT ticker, last_day(date) AS month, arg_max(marketCap, date) FILTER (marketCap IS NOT NULL) AS market_cap,
       arg_max(peRatio, date) FILTER (peRatio IS NOT NULL) AS pe_ratio,
       arg_max(pbRatio, date) FILTER (pbRatio IS NOT NULL) AS pb_ratio,
       arg_max(trailingPEG1Y, date) FILTER (trailingPEG1Y IS NOT NULL) AS trailing_peg_1y
FROM daily_metrics GROUP BY ticker, last_day(date)"""
CTE["roe_values"] = """
SELECT ticker, date_available AS date,
       arg_max(value, fiscal_year * 10 + CASE WHEN fiscal_quarter = 0 THEN 5 ELSE fiscal_quarter END) AS roe
FROM statements WHERE data_code = 'roe' GROUP BY ticker, date_available"""
CTE["roe_m"] = """
SELECT m.ticker, m.month, r.roe FROM (SELECT DISTINCT ticker, month FROM monthly_bars) m
ASOF LEFT JOIN roe_values r ON m.ticker = r.ticker AND m.month >= r.date"""


def _ma(table: str, price: str, part: str, keep: str) -> str:
    cols = ", ".join(
        f"CASE WHEN count({price}) OVER (w ROWS {n - 1} PRECEDING) = {n} "
        f"THEN avg({price}) OVER (w ROWS {n - 1} PRECEDING) / {price} - 1 END AS ma_dev_{n}"
        for n in W
    )
    names = ", ".join(f"ma_dev_{n}" for n in W)
    return f"""
SELECT {keep}month, {names} FROM (
  SELECT {keep}last_day(date) AS month, lead(last_day(date)) OVER w AS nm, {cols}
  FROM {table} WINDOW w AS ({part}ORDER BY date)) WHERE nm IS NULL OR nm <> month"""


CTE["ma_sig"] = _ma("prices", "adjClose", "PARTITION BY ticker ", "ticker, ")
CTE["idx_ma"] = _ma("index_daily", "adj_close", "", "")
CTE["ma_ratios"] = "SELECT ticker, month, " + ", ".join(f"ma_dev_{n} + 1 AS ma_ratio_{n}" for n in W) + " FROM ma_sig"
CTE["trend_m"] = (
    f"SELECT ticker, month, {TREND_INTERCEPT} + " + " + ".join(f"{TREND_COEFS[n]} * ma_dev_{n}" for n in W)
    + " AS trend_raw, 0.0001 * month(month) + "
    + " + ".join(f"{TREND_COEFS[n]} * (1 + 0.1 * month(month)) * ma_dev_{n}" for n in W)
    + " AS trend_expanding_raw FROM ma_sig WHERE month IN (SELECT month FROM index_months)"
)
CTE["hzz_m"] = (
    "SELECT ticker, month, 0.0001 * month(month) + "
    + " + ".join(f"{TREND_COEFS[n]} * (0.1 * (year(month) - 1990)) * ma_ratio_{n}" for n in W)
    + " AS trend_hzz_raw FROM ma_ratios"
)
_ALLZ = {**Z, "trend_hzz_factor": "trend_hzz_z"}


def composite(cols: list[str]) -> str:
    n = " + ".join(f"({c} IS NOT NULL)::INT" for c in cols)
    s = " + ".join(f"coalesce({c}, 0)" for c in cols)
    return f"CASE WHEN {n} >= 3 THEN ({s}) / ({n}) END"


def panel_chain(tag: str, trend: str, hzz: str) -> None:
    """Panel and z-scores from the given trend tables, as expressions named with ``tag``."""
    CTE[f"panel_raw{tag}"] = f"""
SELECT m.*, k.market_cap, k.pe_ratio, k.pb_ratio, k.trailing_peg_1y, r.roe, t.trend_raw, t.trend_expanding_raw,
       h.trend_hzz_raw, c.Security, c.sector, c.sub_industry, i.close AS index_close, i.sma_10m, i.regime_on,
       CASE WHEN k.pe_ratio > 0 THEN k.pe_ratio END AS pe_clean, r.roe AS roe_factor,
       -(CASE WHEN k.pe_ratio > 0 THEN k.pe_ratio END) AS pe_factor, m.momentum_12m AS momentum_factor,
       t.trend_raw AS trend_factor, t.trend_expanding_raw AS trend_expanding_factor, h.trend_hzz_raw AS trend_hzz_factor,
       coalesce(m.eligible_price AND m.next_ret_cc IS NOT NULL AND m.next_ret_oc IS NOT NULL AND m.next_open > 0, FALSE) AS eligible
FROM stock_months m LEFT JOIN metrics_m k USING (ticker, month) LEFT JOIN roe_m r USING (ticker, month)
LEFT JOIN {trend} t USING (ticker, month) LEFT JOIN {hzz} h USING (ticker, month)
LEFT JOIN constituents c ON c.Symbol = m.ticker LEFT JOIN index_months i USING (month)"""
    CTE[f"zq{tag}"] = "SELECT month, " + ", ".join(
        f"count({s}) AS n_{t}, quantile_cont({s}, 0.01) AS lo_{t}, quantile_cont({s}, 0.99) AS hi_{t}" for s, t in _ALLZ.items()
    ) + f" FROM panel_raw{tag} GROUP BY month"
    CTE[f"zc{tag}"] = "SELECT p.*, " + ", ".join(
        f"CASE WHEN n_{t} >= {CFG.min_names_zscore} AND {s} IS NOT NULL THEN least(greatest({s}, lo_{t}), hi_{t}) END AS x_{t}"
        for s, t in _ALLZ.items()
    ) + f" FROM panel_raw{tag} p JOIN zq{tag} USING (month)"
    CTE[f"zm{tag}"] = "SELECT month, " + ", ".join(
        f"avg(x_{t}) AS m_{t}, stddev_pop(x_{t}) AS d_{t}" for t in _ALLZ.values()
    ) + f" FROM zc{tag} GROUP BY month"
    CTE[f"zs{tag}"] = f"SELECT zc{tag}.*, " + ", ".join(
        f"(x_{t} - m_{t}) / nullif(d_{t}, 0) AS {t}" for t in _ALLZ.values()
    ) + f" FROM zc{tag} JOIN zm{tag} USING (month)"
    CTE[f"panel{tag}"] = f"SELECT *, {composite(['roe_z', 'pe_z', 'momentum_z', 'trend_z'])} AS composite_score FROM zs{tag}"


panel_chain("", "trend_m", "hzz_m")
CTE["months"] = "SELECT month, coalesce(bool_or(regime_on), TRUE) AS regime_on FROM panel GROUP BY month"
CTE["bench"] = "SELECT month, ret_1m AS benchmark_return FROM index_months"


def _long(trend: str) -> str:
    union = " UNION ALL ".join(
        f"SELECT month, ticker, '{f}' AS factor, {trend if f == 'trend' else f + '_z'} AS z, next_ret_cc AS ret "
        "FROM panel WHERE eligible"
        for f in FACTORS
    )
    return f"""
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY month, factor) AS n FROM ({union})
               WHERE z IS NOT NULL AND ret IS NOT NULL) WHERE n >= {CFG.min_names_fmp}"""


def _ic(table: str) -> str:
    def avg_rank(c: str) -> str:
        return (
            f"rank() OVER (PARTITION BY month, factor ORDER BY {c}) "
            f"+ (count(*) OVER (PARTITION BY month, factor, {c}) - 1) / 2.0"
        )

    return f"""
SELECT month, factor, corr(z, ret) AS ic, corr(rz, rr) AS rank_ic, count(*) AS n_obs
FROM (SELECT *, {avg_rank('z')} AS rz, {avg_rank('ret')} AS rr FROM {table}) GROUP BY month, factor"""


CTE["factor_long"] = _long("trend_z")
CTE["factor_long_exp"] = _long("trend_expanding_z")
CTE["ic"] = _ic("factor_long")
CTE["ic_exp"] = _ic("factor_long_exp")
CTE["legs"] = """
SELECT *, greatest(1, ceil(5.0 * (rank - 1) / (n - 1)))::INT AS quintile FROM (
  SELECT *, row_number() OVER (PARTITION BY month, factor ORDER BY z, ticker) AS rank FROM factor_long)"""
CTE["fmp_portfolio"] = """
SELECT *, top_return - bottom_return AS portfolio_fmp_return FROM (
  SELECT month, factor, avg(ret) FILTER (quintile = 5) AS top_return, avg(ret) FILTER (quintile = 1) AS bottom_return,
         count(*) FILTER (quintile = 5) AS n_top, count(*) FILTER (quintile = 1) AS n_bottom
  FROM legs GROUP BY month, factor)"""
CTE["fmp_weights"] = """
SELECT month, factor, ticker, (CASE WHEN quintile = 5 THEN 1.0 ELSE -1.0 END)
       / count(*) OVER (PARTITION BY month, factor, quintile) AS weight
FROM legs WHERE quintile IN (1, 5)"""
CTE["fmp_regression"] = """
SELECT month, factor, slope AS regression_fmp_return, r2 AS regression_r2, n_obs,
       slope / nullif(sqrt((syy - slope * sxy) / (n_obs - 2) / nullif(sxx, 0)), 0) AS regression_t_stat
FROM (SELECT month, factor, regr_slope(ret, z) AS slope, regr_r2(ret, z) AS r2, count(*) AS n_obs,
             regr_sxx(ret, z) AS sxx, regr_syy(ret, z) AS syy, regr_sxy(ret, z) AS sxy
      FROM factor_long GROUP BY month, factor)"""

# ------------------------------------------------------------- IC weights
_F4 = " UNION ALL ".join(f"SELECT '{f}' AS factor" for f in FACTORS)
CTE["ic_spine"] = f"""
SELECT month, factor, rank_ic, coalesce(before, 0) AS before, coalesce(before, 0) + 1 AS i FROM (
  SELECT m.month, sum(CASE WHEN h.month IS NOT NULL THEN 1 ELSE 0 END)
           OVER (ORDER BY m.month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS before
  FROM months m LEFT JOIN (SELECT DISTINCT month FROM ic_exp WHERE rank_ic IS NOT NULL) h USING (month))
CROSS JOIN ({_F4}) LEFT JOIN ic_exp USING (month, factor)"""
CTE["ic_trailing"] = """
SELECT month, factor, avg(rank_ic) OVER w AS mean, stddev_samp(rank_ic) OVER w AS std, count(rank_ic) OVER w AS count,
       least(24, before) AS n_months
FROM ic_spine WINDOW w AS (PARTITION BY factor ORDER BY i RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING)"""
CTE["ic_strength"] = "SELECT month, max(n_months) AS n, " + ", ".join(
    f"max(coalesce(greatest(mean / nullif(std, 0), 0), 0)) FILTER (factor = '{f}') AS s_{f}" for f in FACTORS
) + " FROM ic_trailing GROUP BY month"
_TOT = " + ".join(f"s_{f}" for f in FACTORS)
CTE["sx0"] = (
    f"SELECT month, n, CASE WHEN n < 12 THEN 'equal_until_min_history' WHEN {_TOT} <= 0 THEN 'equal_no_positive_ic_ir' "
    "ELSE 'rolling_rank_ic_ir' END AS method, "
    + ", ".join(
        f"0.5 * 0.25 + 0.5 * CASE WHEN {_TOT} > 0 THEN s_{f} / ({_TOT}) ELSE 0.25 END AS r_{f}, "
        f"0.0::DOUBLE AS v_{f}, FALSE AS p_{f}"
        for f in FACTORS
    )
    + " FROM ic_strength"
)
for _i in range(4):
    _free = " + ".join(f"CASE WHEN p_{f} THEN 0 ELSE r_{f} END" for f in FACTORS)
    _cnt = " + ".join(f"(NOT p_{f})::INT" for f in FACTORS)
    _mass = " - ".join(["1.0", *[f"v_{f}" for f in FACTORS]])
    _out = " OR ".join(f"(NOT p_{f} AND (c_{f} < 0.10 OR c_{f} > 0.45))" for f in FACTORS)
    CTE[f"sx{_i + 1}"] = (
        "SELECT month, n, method, "
        + ", ".join(
            f"r_{f}, CASE WHEN NOT p_{f} AND (NOT any_out OR c_{f} < 0.10 OR c_{f} > 0.45) "
            f"THEN least(greatest(c_{f}, CASE WHEN any_out THEN 0.10 ELSE c_{f} END), "
            f"CASE WHEN any_out THEN 0.45 ELSE c_{f} END) ELSE v_{f} END AS v_{f}, "
            f"p_{f} OR NOT any_out OR c_{f} < 0.10 OR c_{f} > 0.45 AS p_{f}"
            for f in FACTORS
        )
        + f" FROM (SELECT *, {_out} AS any_out FROM (SELECT *, "
        + ", ".join(
            f"CASE WHEN fs > 0 THEN r_{f} / fs * mass ELSE mass / nullif(fc, 0) END AS c_{f}" for f in FACTORS
        )
        + f" FROM (SELECT *, {_free} AS fs, {_cnt} AS fc, {_mass} AS mass FROM sx{_i})))"
    )
_VS = " + ".join(f"v_{f}" for f in FACTORS)
CTE["ic_weights"] = "SELECT month, method, " + ", ".join(
    f"CASE WHEN n < 12 THEN 0.25 ELSE v_{f} / ({_VS}) END AS weight_{f}" for f in FACTORS
) + " FROM sx4"

# ----------------------------------------------------------------- backtest


def _lit(v) -> str:
    return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v))


def _spec_values(specs, scenarios) -> str:
    rows = ", ".join(
        f"('{s.name}', '{sc}', '{s.score_variant}', {s.top_n}, {s.gated}, {_lit(s.exits.stop)}::DOUBLE, "
        f"{_lit(s.exits.take)}::DOUBLE, '{s.sizing.method}', {s.sizing.share}::DOUBLE)"
        for s in specs
        for sc in scenarios
    )
    return (
        f"SELECT * FROM (VALUES {rows}) v(strategy, scenario, variant, top_n, regime_filter, stop_loss, take_profit, "
        "sizing_method, pct)"
    )


_SPECS = all_specs()
_variants = {s.score_variant: s for s in [*_SPECS, *grid_specs()]}
CTE["scores"] = " UNION ALL ".join(
    (
        f"SELECT '{v}' AS variant, month, ticker, sector, next_open, next_high, next_low, next_ret_oc, "
        + "("
        + " + ".join(
            f"{s.factor_column(f)} * {('weight_' + f) if s.weighting.method == 'rolling_rank_ic' else float(s.weights[f])}"
            for f in FACTORS
        )
        + ") / ("
        + " + ".join(
            f"{('weight_' + f) if s.weighting.method == 'rolling_rank_ic' else float(s.weights[f])}" for f in FACTORS
        )
        + ") AS score FROM panel"
        + (" JOIN ic_weights USING (month)" if s.weighting.method == "rolling_rank_ic" else "")
        + " WHERE eligible"
    )
    for v, s in _variants.items()
)
CTE["picks"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, month ORDER BY score DESC, ticker) AS rank
               FROM scores WHERE score IS NOT NULL) WHERE rank <= 20"""
CTE["schedule"] = (
    "SELECT year, scenario, mult AS scenario_multiplier, c * mult AS commission_bps_per_side, "
    "s * mult AS slippage_bps_per_side, 2.0 * (c * mult + s * mult) AS round_trip_bps FROM (VALUES "
    + ", ".join(f"({y}, {c}::DOUBLE, {s}::DOUBLE)" for y, (c, s) in CENTRAL_COST_BPS.items())
    + ") a(year, c, s) CROSS JOIN (VALUES "
    + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in COST_SCENARIOS.items())
    + ") b(scenario, mult)"
)
CTE["costs"] = """
SELECT * FROM (SELECT m.month, s.*, row_number() OVER (PARTITION BY m.month, s.scenario
                      ORDER BY abs(s.year - year(m.month)), s.year) AS k
               FROM months m CROSS JOIN schedule s) WHERE k = 1"""


def _realised(runs: str) -> str:
    low, high = "next_low / nullif(next_open, 0) - 1", "next_high / nullif(next_open, 0) - 1"
    return f"""
SELECT strategy, scenario, month, ticker, sector, rank, score, gross, drag, gross - drag AS net FROM (
  SELECT r.strategy, r.scenario, p.month, p.ticker, p.sector, p.rank, p.score, c.round_trip_bps / 10000.0 AS drag,
    CASE WHEN coalesce({high} >= r.take_profit, FALSE) AND NOT coalesce({low} <= -r.stop_loss, FALSE) THEN r.take_profit
         WHEN r.stop_loss IS NOT NULL AND NOT coalesce({low} > -r.stop_loss, FALSE) THEN -r.stop_loss
         ELSE next_ret_oc END AS gross
  FROM picks p JOIN {runs} r ON p.variant = r.variant AND p.rank <= r.top_n
  JOIN months m ON m.month = p.month AND (NOT r.regime_filter OR m.regime_on)
  JOIN costs c ON c.scenario = r.scenario AND c.month = p.month)"""


def _steps(runs: str, realised: str) -> str:
    return f"""
SELECT r.strategy, r.scenario, m.month, row_number() OVER (PARTITION BY r.strategy, r.scenario ORDER BY m.month) AS i,
       coalesce(x.rets, []) AS rets, r.top_n, r.sizing_method, r.pct
FROM {runs} r CROSS JOIN months m
LEFT JOIN (SELECT strategy, scenario, month, list(net ORDER BY rank) AS rets FROM {realised} GROUP BY ALL) x
  ON x.strategy = r.strategy AND x.scenario = r.scenario AND x.month = m.month"""


def fold_sql(steps: str, name: str, keys: list[str]) -> str:
    """Recursive equity walk; one recursion level per month."""
    ks = ", ".join(f"s.{k}" for k in keys)
    on = " AND ".join(f"s.{k} = f.{k}" for k in keys)
    first = ", ".join(keys)
    return f"""
SELECT DISTINCT {first}, 0::BIGINT AS i, NULL::DATE AS month, 0.0::DOUBLE AS portfolio_return, 0.0::DOUBLE AS pnl,
       {CFG.initial_cash}::DOUBLE AS equity, 0.0::DOUBLE AS prev_equity, 0::BIGINT AS n_positions,
       0.0::DOUBLE AS per_position_dollars FROM {steps}
UNION ALL
SELECT {first}, i, month, CASE WHEN n > 0 THEN size * tot / prev ELSE 0.0 END,
       CASE WHEN n > 0 THEN size * tot ELSE 0.0 END, prev + CASE WHEN n > 0 THEN size * tot ELSE 0.0 END, prev, n, size
FROM (SELECT {first}, i, month, prev, n, size, coalesce(list_sum(rets[1:n]), 0.0) AS tot FROM (
  SELECT {ks}, s.i, s.month, s.rets, f.equity AS prev,
         least(s.top_n, CASE WHEN s.sizing_method = 'percent_of_equity' THEN s.top_n
               ELSE greatest(floor(f.equity / {CFG.cash_per_trade}), 0) END, len(s.rets))::BIGINT AS n,
         CASE WHEN s.sizing_method = 'percent_of_equity' THEN s.pct * f.equity ELSE {CFG.cash_per_trade} END AS size
  FROM {name} f JOIN {steps} s ON {on} AND s.i = f.i + 1))"""


def _curve(fold: str, runs: str) -> str:
    return f"""
SELECT f.strategy, f.scenario, f.month, f.portfolio_return, f.pnl, f.equity, f.prev_equity, f.n_positions,
       f.per_position_dollars, m.regime_on, r.sizing_method, c.commission_bps_per_side, c.slippage_bps_per_side,
       c.round_trip_bps, f.per_position_dollars * c.round_trip_bps / 10000.0 * f.n_positions AS cost_dollars
FROM {fold} f JOIN months m USING (month) JOIN costs c ON c.scenario = f.scenario AND c.month = f.month
JOIN {runs} r ON r.strategy = f.strategy AND r.scenario = f.scenario WHERE f.i > 0"""


_COST = [s for s in _SPECS if s.name in ("improved_4", "improved_6")]
for _tag, _sp, _sc in (("", _SPECS, ["zero"]), ("_cost", _COST, list(COST_SCENARIOS)), ("_grid", grid_specs(), ["zero"])):
    CTE[f"runs{_tag}"] = _spec_values(_sp, _sc)
    CTE[f"realised{_tag}"] = _realised(f"runs{_tag}")
    CTE[f"steps{_tag}"] = _steps(f"runs{_tag}", f"realised{_tag}")
    CTE[f"fold{_tag}"] = fold_sql(f"steps{_tag}", f"fold{_tag}", ["strategy", "scenario"])
    CTE[f"curves{_tag}"] = _curve(f"fold{_tag}", f"runs{_tag}")
CTE["eval_curves"] = f"SELECT * FROM curves WHERE month >= {EVAL}"
CTE["holdings"] = """
SELECT x.strategy, x.month AS signal_month, x.ticker, x.sector, x.rank, x.score, c.per_position_dollars AS allocated_cash,
       x.gross AS gross_stock_return, x.drag AS cost_drag_per_holding, x.net AS realized_stock_return
FROM realised x JOIN curves c ON c.strategy = x.strategy AND c.month = x.month AND x.rank <= c.n_positions"""


# -------------------------------------------------------------- performance


def student_p(t: str, dof: str) -> str:
    """Two-sided t p-value by the same finite series, with gamma functions."""
    th = f"atan(abs({t}) / sqrt({dof}))"
    odd = (
        f"(2 / pi()) * ({th} + CASE WHEN {dof} > 1 THEN sin({th}) * list_sum(list_transform(range(0, ({dof} - 1) // 2), "
        f"lambda k: exp(ln(pi()) / 2 - ln(2.0) + lgamma(k + 1.0) - lgamma(k + 1.5) + (2 * k + 1) * ln(cos({th}))))) ELSE 0 END)"
    )
    even = (
        f"sin({th}) * list_sum(list_transform(range(0, {dof} // 2), "
        f"lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) - ln(pi()) / 2 + 2 * k * ln(cos({th})))))"
    )
    return f"(CASE WHEN {dof} >= 1 THEN greatest(0, 1 - CASE WHEN {dof} % 2 = 1 THEN {odd} ELSE {even} END) END)"


def normal_p(z: str) -> str:
    x = f"least(abs({z}) / sqrt(2.0), 6.0)"
    series = (
        f"list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln({x}) - ln(2.0) + ln(pi()) / 2 "
        f"- lgamma(k + 1.5))))"
    )
    return f"greatest(0, 1 - {series} * exp(-{x} * {x}) * 2 / sqrt(pi()))"


def perf_sql(src: str, keys: str, ret: str = "portfolio_return", order: str = "month", where: str = "TRUE") -> str:
    return f"""
SELECT *, {student_p('t_stat', '(n_periods - 1)')} AS p_value, {CFG.initial_cash} * (1 + cumulative_return) AS final_equity,
       cumulative_return AS total_return FROM (
SELECT {keys}, count(r) AS n_periods, avg(r) AS avg_period_return, stddev_samp(r) AS period_volatility,
       avg(r) * 12 AS annualized_return_approx, stddev_samp(r) * sqrt(12) AS annualized_volatility,
       sqrt(12) * avg(r) / nullif(stddev_samp(r), 0) AS annualized_sharpe,
       CASE WHEN count(r) > 2 THEN avg(r) / nullif(stddev_samp(r) / sqrt(count(r)), 0) END AS t_stat,
       product(1 + r) - 1 AS cumulative_return, min(dd) AS max_drawdown, max(r) AS best_month, min(r) AS worst_month,
       min(o) AS first_period, max(o) AS last_period
FROM (SELECT *, wealth / max(wealth) OVER (PARTITION BY {keys} ORDER BY o) - 1 AS dd
      FROM (SELECT *, {ret} AS r, {order} AS o, product(1 + {ret}) OVER (PARTITION BY {keys} ORDER BY {order}) AS wealth
            FROM {src} WHERE {ret} IS NOT NULL AND {where})) GROUP BY {keys})"""


CTE["metrics"] = perf_sql("curves", "strategy", where=f"month >= {EVAL}")
CTE["metrics_cost"] = perf_sql("curves_cost", "strategy, scenario", where=f"month >= {EVAL}")
CTE["avg_pos"] = "SELECT strategy, avg(n_positions) AS avg_positions FROM eval_curves GROUP BY strategy"
CTE["segments"] = f"SELECT *, CASE WHEN month <= {TRAIN} THEN 'train' ELSE 'test' END AS segment FROM eval_curves"
CTE["segments_full"] = f"""
SELECT *, 'full' AS segment FROM eval_curves UNION ALL SELECT * FROM segments"""
CTE["grid_seg"] = f"""
SELECT *, unnest(['full', CASE WHEN month <= {TRAIN} THEN 'train' ELSE 'test' END]) AS segment
FROM curves_grid WHERE month >= {EVAL}"""
CTE["grid_perf"] = perf_sql("grid_seg", "strategy, segment")
_P = {
    "full_sharpe": ("full", "annualized_sharpe"),
    "full_final_equity": ("full", "final_equity"),
    "full_max_drawdown": ("full", "max_drawdown"),
    "train_sharpe": ("train", "annualized_sharpe"),
    "train_total_return": ("train", "total_return"),
    "train_max_drawdown": ("train", "max_drawdown"),
    "test_sharpe": ("test", "annualized_sharpe"),
    "test_total_return": ("test", "total_return"),
    "test_max_drawdown": ("test", "max_drawdown"),
    "test_avg_positions": ("test", "ap"),
}
CTE["grid"] = (
    "SELECT g.*, r.stop_loss, r.take_profit, dense_rank() OVER (ORDER BY r.stop_loss) - 1 AS stop_idx, "
    "dense_rank() OVER (ORDER BY r.take_profit) - 1 AS take_idx FROM (SELECT strategy, "
    + ", ".join(f"max({c}) FILTER (segment = '{s}') AS {k}" for k, (s, c) in _P.items())
    + " FROM grid_perf JOIN (SELECT strategy, segment, avg(n_positions) AS ap FROM grid_seg GROUP BY ALL) "
    "USING (strategy, segment) GROUP BY strategy) g JOIN runs_grid r USING (strategy)"
)
CTE["grid_pairs"] = """
SELECT a.strategy, b.strategy AS neighbour, b.train_sharpe, b.test_sharpe FROM grid a JOIN grid b
ON abs(a.stop_idx - b.stop_idx) <= 1 AND abs(a.take_idx - b.take_idx) <= 1 AND a.strategy <> b.strategy"""
CTE["grid_stab"] = """
SELECT *, train_sharpe - neighbor_train_sharpe_median AS train_stability_gap,
       train_sharpe + coalesce(train_max_drawdown, 0) - coalesce(abs(train_sharpe - neighbor_train_sharpe_median), 0)
         AS robust_train_score
FROM (SELECT g.*, s.neighbor_train_sharpe_median, s.neighbor_test_sharpe_median,
             coalesce(s.neighbor_count, 0) AS neighbor_count
      FROM grid g LEFT JOIN (SELECT strategy, median(train_sharpe) AS neighbor_train_sharpe_median,
             median(test_sharpe) AS neighbor_test_sharpe_median, count(*) AS neighbor_count
             FROM grid_pairs GROUP BY strategy) s USING (strategy))"""
CTE["aligned"] = """
SELECT c.strategy, c.month, c.portfolio_return, b.benchmark_return FROM eval_curves c JOIN bench b USING (month)
WHERE b.benchmark_return IS NOT NULL"""
CTE["exposure"] = """
SELECT p.month, max(p.index_close) AS index_close, max(p.sma_10m) AS sma_10m, bool_or(p.regime_on) AS regime_on,
       max(c.n_positions) AS n_positions, max(c.portfolio_return) AS portfolio_return,
       coalesce(max(c.n_positions) > 0, FALSE) AS invested
FROM panel p LEFT JOIN (SELECT * FROM curves WHERE strategy = 'improved_5') c USING (month) GROUP BY p.month"""

# ------------------------------------------------------------------- trades
CTE["trade_signals"] = """
SELECT h.strategy, last_day(h.signal_month + INTERVAL 1 DAY) AS month, h.ticker, max(h.allocated_cash) AS cash, max(r.stop_loss) AS stop,
       max(r.take_profit) AS take
FROM holdings h JOIN runs r USING (strategy) GROUP BY ALL"""
CTE["trade_bars"] = """
SELECT ticker, date, adjOpen AS open, adjHigh AS high, adjLow AS low, adjClose AS close, last_day(date) AS month,
       row_number() OVER w AS i, coalesce(lag(last_day(date)) OVER w <> last_day(date), TRUE) AS first_bar
FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date)"""
CTE["trade_heads"] = """
SELECT n.strategy, h.ticker, h.i, h.close, t.ticker IS NOT NULL AS wanted, t.cash, t.stop, t.take,
       min(CASE WHEN t.ticker IS NULL THEN h.i END) OVER (
         PARTITION BY n.strategy, h.ticker ORDER BY h.i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_i
FROM trade_bars h JOIN (SELECT DISTINCT strategy, ticker FROM trade_signals) n ON n.ticker = h.ticker AND h.first_bar
LEFT JOIN trade_signals t ON t.strategy = n.strategy AND t.ticker = h.ticker AND t.month = h.month"""
CTE["trade_entries"] = """
SELECT h.strategy, h.ticker, h.i AS c, e.date AS entry_date, e.open AS entry, floor(h.cash / h.close)::BIGINT AS shares, h.end_i,
       e.open * (1 - h.stop) AS low_level, e.open * (1 + h.take) AS high_level,
       h.end_i + CASE WHEN h.stop IS NULL AND h.take IS NULL THEN 1 ELSE 2 END AS out_i
FROM trade_heads h JOIN trade_bars e ON e.ticker = h.ticker AND e.i = h.i + 1 WHERE h.wanted AND floor(h.cash / h.close) > 0"""
CTE["trade_hits"] = """
SELECT e.strategy, e.ticker, e.c, min(b.i) AS i FROM trade_entries e JOIN trade_bars b ON b.ticker = e.ticker
  AND b.i > e.c + 1 AND b.i <= coalesce(e.end_i, 1000000000) AND (b.low <= e.low_level OR b.high >= e.high_level)
GROUP BY ALL"""
CTE["trade_paths"] = """
SELECT e.strategy, e.ticker, e.c, e.entry_date, e.entry, e.shares, b.date AS exit_date, b.i AS exit_i,
       CASE WHEN h.i IS NULL THEN b.open WHEN coalesce(b.low <= e.low_level, FALSE) THEN least(b.open, e.low_level)
            ELSE greatest(b.open, e.high_level) END AS exit_price,
       CASE WHEN b.i IS NULL THEN NULL WHEN h.i IS NULL THEN 'rebalance_exit' WHEN coalesce(b.low <= e.low_level, FALSE) THEN 'stop_loss'
            ELSE 'take_profit' END AS reason,
       b.i - e.c - 1 AS bar_len
FROM trade_entries e LEFT JOIN trade_hits h USING (strategy, ticker, c)
LEFT JOIN trade_bars b ON b.ticker = e.ticker AND b.i = coalesce(h.i, e.out_i)"""
CTE["trade_next"] = """
SELECT p.strategy, p.ticker, p.c, min(n.c) AS c_next FROM trade_paths p LEFT JOIN trade_paths n
  ON n.strategy = p.strategy AND n.ticker = p.ticker AND n.c >= p.exit_i GROUP BY ALL"""
CTE["walk"] = """
SELECT strategy, ticker, min(c) AS c FROM trade_paths GROUP BY strategy, ticker
UNION ALL
SELECT w.strategy, w.ticker, n.c_next FROM walk w JOIN trade_next n USING (strategy, ticker, c) WHERE n.c_next IS NOT NULL"""
CTE["exits"] = """
SELECT strategy, ticker, entry_date, entry AS entry_price, shares, exit_date, exit_price, reason, bar_len
FROM trade_paths JOIN walk USING (strategy, ticker, c)"""
CTE["trade_log"] = """
SELECT strategy, ticker, exit_date AS date, shares * (exit_price - entry_price) AS pnl, bar_len, reason FROM exits
WHERE exit_date IS NOT NULL"""
CTE["positions"] = """
SELECT strategy, date, ticker, entry_date, shares, price, shares * price AS market_value FROM (
  SELECT e.strategy, d.date, e.ticker, e.entry_date, e.shares, last_value(p.adjClose IGNORE NULLS) OVER (
         PARTITION BY e.strategy, e.ticker, e.entry_date ORDER BY d.date) AS price
  FROM exits e JOIN index_daily d ON d.date >= e.entry_date AND coalesce(d.date < e.exit_date, TRUE)
  LEFT JOIN prices p ON p.ticker = e.ticker AND p.date = d.date)"""
CTE["mtm"] = f"""
SELECT strategy, date, cash, market_value, cash + market_value AS value FROM (
  SELECT s.strategy, d.date, {CFG.initial_cash} + sum(coalesce(f.flow, 0)) OVER (PARTITION BY s.strategy ORDER BY d.date) AS cash,
         coalesce(v.mv, 0) AS market_value
  FROM (SELECT DISTINCT strategy FROM exits) s CROSS JOIN (SELECT date FROM index_daily) d
  LEFT JOIN (SELECT strategy, date, sum(flow) AS flow FROM (
       SELECT strategy, entry_date AS date, -shares * entry_price AS flow FROM exits
       UNION ALL SELECT strategy, exit_date, shares * exit_price FROM exits WHERE exit_date IS NOT NULL) GROUP BY ALL) f
    ON f.strategy = s.strategy AND f.date = d.date
  LEFT JOIN (SELECT strategy, date, sum(market_value) AS mv FROM positions GROUP BY ALL) v
    ON v.strategy = s.strategy AND v.date = d.date)"""


# --------------------------------------------------------------------- live
def live_sql(month, top_n: int) -> str:
    zs = ["roe_z", "pe_z", "momentum_z", "trend_expanding_z"]
    return f"""
SELECT month, rank, ticker, score, close FROM (
  SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, ticker) AS rank FROM (
    SELECT *, {composite(zs)} AS score FROM panel WHERE month = DATE '{month}' AND close > {CFG.price_floor}
      AND coalesce({', '.join(zs)}) IS NOT NULL) WHERE score IS NOT NULL) WHERE rank <= {top_n}"""


def portfolios_sql(month) -> str:
    return " UNION ALL ".join(
        f"SELECT '{p.name}' AS strategy, * FROM ({live_sql(month, p.top_n)}) q" for p in LIVE_PORTFOLIOS
    )


CTE["live"] = portfolios_sql(LIVE_MONTH)
CTE["live_prev"] = portfolios_sql(PREVIOUS_MONTH)
CTE["diff"] = """
SELECT coalesce(c.strategy, t.strategy) AS strategy, coalesce(c.ticker, t.ticker) AS ticker,
       CASE WHEN t.ticker IS NULL THEN 'exit' WHEN c.ticker IS NULL THEN 'enter' ELSE 'hold' END AS action
FROM live_prev c FULL OUTER JOIN live t ON c.strategy = t.strategy AND c.ticker = t.ticker"""


# --------------------------------------------------------------- resampling
def hash_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12))::BIGINT"


CTE["universe"] = """
SELECT month, ticker, next_open, next_high, next_low, next_ret_oc, row_number() OVER (PARTITION BY month ORDER BY ticker) AS idx
FROM panel WHERE eligible AND next_ret_oc IS NOT NULL"""
CTE["mc_grid"] = f"""
SELECT sim::INT AS sim, month, coalesce(n, 0) AS n FROM range({CFG.mc_sims}) r(sim) CROSS JOIN months
LEFT JOIN (SELECT month, count(*) AS n FROM universe GROUP BY month) USING (month)"""
_MOST = max(s.top_n for s in _SPECS)
_keys = ", ".join(f"{hash_sql(str(CFG.seed), 'sim', 'month', str(i))} % 2147483647 AS k{i}" for i in range(4))
CTE["mc_walk0"] = f"""
SELECT *, c // b AS l, c % b AS r FROM (
  SELECT *, unnest(range(a * b)) AS c FROM (SELECT *, ceil(n / a)::BIGINT AS b, {_keys} FROM (
    SELECT *, ceil(sqrt(n))::BIGINT AS a FROM mc_grid WHERE n > 0)))"""
for _i, (_side, _other, _size) in enumerate([("l", "r", "a"), ("r", "l", "b")] * 2):
    _y = f"(({_other} + k{_i}) % 2147483647)"
    _moved = f"({_side} + ({_y} * {_y} % 2147483647) * {_y} % 2147483647) % {_size}"
    CTE[f"mc_walk{_i + 1}"] = f"SELECT * REPLACE ({_moved} AS {_side}) FROM mc_walk{_i}"
CTE["mc_draws"] = f"""
SELECT sim, month, l * b + r + 1 AS idx, row_number() OVER (PARTITION BY sim, month ORDER BY c) AS rank
FROM mc_walk4 WHERE l * b + r < n QUALIFY rank <= {_MOST}"""
CTE["mc_runs"] = _spec_values(_SPECS, ["none"])
CTE["mc_returns"] = f"""
SELECT r.strategy, sim, month, d.rank, CASE
    WHEN coalesce(next_high / next_open - 1 >= r.take_profit, FALSE) AND NOT coalesce(next_low / next_open - 1 <= -r.stop_loss, FALSE)
      THEN r.take_profit
    WHEN r.stop_loss IS NOT NULL AND NOT coalesce(next_low / next_open - 1 > -r.stop_loss, FALSE) THEN -r.stop_loss
    ELSE next_ret_oc END AS r
FROM mc_draws d
JOIN universe USING (month, idx) JOIN months USING (month)
JOIN mc_runs r ON d.rank <= r.top_n AND (NOT r.regime_filter OR coalesce(months.regime_on, TRUE))"""
CTE["mc_steps"] = """
SELECT r.strategy, g.sim, g.month, row_number() OVER (PARTITION BY r.strategy, g.sim ORDER BY g.month) AS i,
       coalesce(x.rets, []) AS rets, r.top_n, r.sizing_method, r.pct
FROM mc_grid g CROSS JOIN mc_runs r
LEFT JOIN (SELECT strategy, sim, month, list(r ORDER BY rank) AS rets FROM mc_returns GROUP BY ALL) x
  ON x.strategy = r.strategy AND x.sim = g.sim AND x.month = g.month"""
CTE["mc_fold"] = fold_sql("mc_steps", "mc_fold", ["strategy", "sim"])
CTE["mc_perf"] = perf_sql("mc_fold", "strategy, sim", where=f"i > 0 AND month >= {EVAL}")
CTE["mc_test"] = """
SELECT sim, annualized_sharpe, final_equity, strategy, strategy_sharpe,
       avg(CASE WHEN annualized_sharpe >= strategy_sharpe THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY strategy) AS p_value
FROM (SELECT strategy, sim, annualized_sharpe, final_equity FROM mc_perf)
JOIN (SELECT strategy, annualized_sharpe AS strategy_sharpe FROM metrics) USING (strategy)"""


def block_sql(src: str, value: str, seed: int, sims: int = CFG.bootstrap_reps, block: int = CFG.block_size) -> str:
    h = hash_sql(str(seed), "strategy", "sim", "blk")
    return f"""
SELECT d.strategy, d.sim, d.pos, s.r FROM (
  SELECT strategy, sim, blk * {block} + o AS pos, {h} % (n - {block} + 1) + o AS i, n FROM (
    SELECT strategy, n, unnest(range(0, ceil(n / {block}.0)::BIGINT)) AS blk, sim, o FROM (
      SELECT DISTINCT strategy, n FROM ({_indexed(src, value)})) CROSS JOIN range({sims}) a(sim) CROSS JOIN range({block}) b(o)
    WHERE n >= {block})) d
JOIN ({_indexed(src, value)}) s ON s.strategy = d.strategy AND s.i = d.i WHERE d.pos < d.n"""


def _indexed(src: str, value: str) -> str:
    return (
        f"SELECT strategy, row_number() OVER (PARTITION BY strategy ORDER BY month) - 1 AS i, "
        f"count(*) OVER (PARTITION BY strategy) AS n, {value} AS r FROM {src} WHERE {value} IS NOT NULL"
    )


CTE["boot_rows"] = block_sql("eval_curves", "portfolio_return", CFG.seed + 1)
CTE["boot_perf"] = perf_sql("boot_rows", "strategy, sim", "r", "pos")
CTE["excess"] = """
SELECT strategy, month, portfolio_return - coalesce(benchmark_return, 0) AS excess
FROM eval_curves LEFT JOIN bench USING (month)"""
CTE["excess_boot"] = block_sql("excess", "excess", CFG.seed + 2)
_T = "(SELECT count(DISTINCT month) FROM excess)"
CTE["sb_draws"] = f"""
SELECT rep, t, ((s + t - t0) % n)::INT AS idx FROM (
  SELECT rep, t, n, last_value(CASE WHEN restart THEN start END IGNORE NULLS) OVER w AS s,
         last_value(CASE WHEN restart THEN t END IGNORE NULLS) OVER w AS t0
  FROM (SELECT rep, t, n, t = 0 OR {hash_sql(str(CFG.seed + 3), "'restart'", "rep", "t")} / 281474976710656.0::DOUBLE
               < 1.0::DOUBLE / {CFG.block_size} AS restart, {hash_sql(str(CFG.seed + 3), "'start'", "rep", "t")} % n AS start
        FROM range({CFG.bootstrap_reps}) a(rep) CROSS JOIN (SELECT unnest(range({_T})) AS t, {_T} AS n))
  WINDOW w AS (PARTITION BY rep ORDER BY t))"""
CTE["sb_means"] = """
SELECT d.rep, e.strategy, avg(e.excess) AS boot_mean FROM sb_draws d JOIN (
  SELECT *, dense_rank() OVER (ORDER BY month) - 1 AS idx FROM excess) e USING (idx) GROUP BY d.rep, e.strategy"""
CTE["sb_demeaned"] = """
SELECT strategy, row_number() OVER (PARTITION BY strategy ORDER BY month) AS t, count(*) OVER (PARTITION BY strategy) AS n,
       excess - avg(excess) OVER (PARTITION BY strategy) AS d FROM excess"""
_Q = f"(1.0::DOUBLE - 1.0::DOUBLE / {CFG.block_size})"
CTE["sb_var"] = f"""
SELECT a.strategy, sum(a.d * b.d * CASE WHEN a.t = b.t THEN 1 ELSE 2 * ((1 - (b.t - a.t) / a.n) * pow({_Q}, b.t - a.t)
       + (b.t - a.t) / a.n * pow({_Q}, a.n - (b.t - a.t))) END) / max(a.n) AS v
FROM sb_demeaned a JOIN sb_demeaned b ON a.strategy = b.strategy AND b.t >= a.t GROUP BY a.strategy"""
CTE["sb_stats"] = """
SELECT strategy, mean, n, sqrt(v / n) AS se, mean / nullif(sqrt(v / n), 0) AS t_stat FROM
  (SELECT strategy, avg(excess) AS mean, count(*) AS n FROM excess GROUP BY strategy) JOIN sb_var USING (strategy)"""
CTE["sb_z"] = """
SELECT rep, strategy, t_stat, mean, n, (boot_mean - greatest(mean, 0)) / se AS zl,
       (boot_mean - CASE WHEN t_stat >= -sqrt(2 * ln(ln(n))) THEN mean ELSE 0 END) / se AS zc, (boot_mean - mean) / se AS zu
FROM sb_means JOIN sb_stats USING (strategy)"""
CTE["spa_reps"] = """
SELECT rep, max(t_stat) AS stat, max(n) AS n, count(*) AS k, max(zl) AS zl, max(zc) AS zc, max(zu) AS zu FROM sb_z GROUP BY rep"""
CTE["stepm_crit"] = """
SELECT strategy, max(t_stat) AS t_stat, max(mean) AS mean_excess, quantile_cont(mx, 0.95) AS critical_value FROM (
  SELECT rep, strategy, t_stat, mean, max(zc) OVER (PARTITION BY rep ORDER BY t_stat, strategy DESC
         ROWS UNBOUNDED PRECEDING) AS mx FROM sb_z) GROUP BY strategy"""
CTE["stepm"] = """
SELECT *, bool_and(t_stat > critical_value) OVER (ORDER BY t_stat DESC, strategy ROWS UNBOUNDED PRECEDING) AS superior
FROM stepm_crit"""
CTE["fmp_both"] = """
SELECT 'portfolio_sort' AS approach, factor, month, portfolio_fmp_return AS r FROM fmp_portfolio
UNION ALL SELECT 'cross_sectional_regression', factor, month, regression_fmp_return FROM fmp_regression"""
CTE["fmp_perf"] = perf_sql("fmp_both", "approach, factor", "r")


def _t(c: str) -> str:
    return f"CASE WHEN count({c}) > 2 THEN avg({c}) / nullif(stddev_samp({c}) / sqrt(count({c})), 0) END"


CTE["ic_sum"] = f"""
SELECT factor, avg(ic) AS avg_ic, avg(rank_ic) AS avg_rank_ic, {_t('ic')} AS ic_t, {_t('rank_ic')} AS rank_ic_t
FROM ic GROUP BY factor"""

# ------------------------------------------------------- fitted regressions


def regression_chain(tag: str, src: str, xs: list[str]) -> None:
    """Least squares of y on 1 + xs per key ``g`` by successive orthogonalisation.

    ``src`` has columns g, o (row order), y and xs. Yields ``{tag}_b`` (one row
    per g with b0, b_<x>, n, r2) and ``{tag}_w`` (rows with the residual u and
    the weights w0, w_<x> that turn y into each coefficient).
    """
    k = len(xs)
    centred = ", ".join(f"{x} - avg({x}) OVER (PARTITION BY g) AS {x}" for x in ["y", *xs])
    CTE[f"{tag}_s0"] = f"SELECT g, o, {centred} FROM {src}"
    for j in range(k):
        a = xs[j]
        later = xs[j + 1 :]
        slopes = ", ".join(f"sum({a} * {m}) / nullif(sum({a} * {a}), 0) AS r_{m}" for m in [*later, "y"])
        CTE[f"{tag}_r{j}"] = f"SELECT g, sum({a} * {a}) AS d, {slopes} FROM {tag}_s{j} GROUP BY g"
        moved = ", ".join(f"{m} - coalesce(r_{m}, 0) * {a} AS {m}" for m in [*later, "y"])
        kept = ", ".join(xs[: j + 1])
        CTE[f"{tag}_s{j + 1}"] = f"SELECT g, o, {kept}, {moved} FROM {tag}_s{j} JOIN {tag}_r{j} USING (g)"
    # Back substitution from the last regressor, for coefficients and for row weights.
    b = f"SELECT g, count(*) AS n, avg(y) AS my, {', '.join(f'avg({x}) AS m_{x}' for x in xs)}, var_pop(y) * count(*) AS syy FROM {src} GROUP BY g"
    w = f"SELECT g, o, y AS u, {', '.join(xs)} FROM {tag}_s{k}"
    for j in reversed(range(k)):
        a, later = xs[j], xs[j + 1 :]
        minus_b = "".join(f" - coalesce(r.r_{m}, 0) * b_{m}" for m in later)
        minus_w = "".join(f" - coalesce(r.r_{m}, 0) * w_{m}" for m in later)
        b = f"SELECT t.*, coalesce(r.r_y, 0){minus_b} AS b_{a} FROM ({b}) t JOIN {tag}_r{j} r USING (g)"
        w = f"SELECT t.*, coalesce(t.{a} / nullif(r.d, 0), 0){minus_w} AS w_{a} FROM ({w}) t JOIN {tag}_r{j} r USING (g)"
    b0 = " ".join(f"- m_{x} * b_{x}" for x in xs)
    CTE[f"{tag}_b"] = (
        f"SELECT t.*, my {b0} AS b0, 1 - e.ee / nullif(syy, 0) AS r2 FROM ({b}) t "
        f"JOIN (SELECT g, sum(y * y) AS ee FROM {tag}_s{k} GROUP BY g) e USING (g)"
    )
    w0 = " ".join(f"- m_{x} * w_{x}" for x in xs)
    CTE[f"{tag}_w"] = f"SELECT t.*, 1.0 / n {w0} AS w0 FROM ({w}) t JOIN {tag}_b USING (g)"


def hac_chain(tag: str, xs: list[str]) -> None:
    """``{tag}_p``: coefficients with their normal p-values under a Bartlett window of three lags."""
    names = ["0", *[f"_{x}" for x in xs]]
    terms = []
    for v in names:
        e = f"w{v} * u"
        lags = "".join(
            f" + {2 * (1 - lag / 4)} * ({e}) * coalesce(lag({e}, {lag}) OVER ww, 0)" for lag in (1, 2, 3)
        )
        terms.append(f"({e}) * ({e}){lags} AS v{v}")
    CTE[f"{tag}_v"] = f"SELECT g, {', '.join(terms)} FROM {tag}_w WINDOW ww AS (PARTITION BY g ORDER BY o)"
    sums = ", ".join(f"sum(v{v}) AS v{v}" for v in names)
    ps = ", ".join(
        f"CASE WHEN z{v} IS NULL OR z{v} = 0 THEN NULL ELSE {normal_p(f'z{v}')} END AS p{v}" for v in names
    )
    zs = ", ".join(f"b{v} / nullif(sqrt(greatest(v{v}, 0)), 0) AS z{v}" for v in names)
    CTE[f"{tag}_p"] = (
        f"SELECT *, {ps} FROM (SELECT b.*, {zs} FROM {tag}_b b JOIN (SELECT g, {sums} FROM {tag}_v GROUP BY g) s USING (g))"
    )


def selection_chain(tag: str, src: str, xs: list[str]) -> None:
    """Fit, keep regressors with p <= 0.05, refit. Dropped columns become zero."""
    regression_chain(f"{tag}a", src, xs)
    hac_chain(f"{tag}a", xs)
    kept = ", ".join(f"CASE WHEN p_{x} <= {CFG.trend_alpha} THEN s.{x} ELSE 0 END AS {x}" for x in xs)
    CTE[f"{tag}_kept"] = f"SELECT s.g, s.o, s.y, {kept} FROM {src} s JOIN {tag}a_p USING (g)"
    regression_chain(f"{tag}b", f"{tag}_kept", xs)
    hac_chain(f"{tag}b", xs)


_DEV = [f"ma_dev_{n}" for n in W]
_RAT = [f"ma_ratio_{n}" for n in W]
_FULL_DEV = " AND ".join(f"{c} IS NOT NULL" for c in _DEV)
CTE["hist_rows"] = f"""
SELECT m.month AS o, m.next_ret AS y, {', '.join(_DEV)} FROM index_months m JOIN idx_ma USING (month)
WHERE m.next_ret IS NOT NULL AND {_FULL_DEV}"""
CTE["full_rows"] = f"""
SELECT 'index' AS g, * FROM hist_rows WHERE (SELECT count(*) FROM hist_rows) >= {CFG.trend_min_obs}"""
CTE["exp_rows"] = f"""
SELECT * FROM (SELECT s.month AS g, h.*, count(*) OVER (PARTITION BY s.month) AS k FROM index_months s
               JOIN hist_rows h ON h.o < s.month) WHERE k >= {CFG.trend_min_obs}"""
selection_chain("ft", "full_rows", _DEV)
selection_chain("et", "exp_rows", _DEV)
CTE["trend_fit"] = (
    "SELECT ticker, s.month, f.b0"
    + "".join(f" + f.b_{c} * s.{c}" for c in _DEV)
    + " AS trend_raw, e.b0"
    + "".join(f" + e.b_{c} * s.{c}" for c in _DEV)
    + " AS trend_expanding_raw FROM ma_sig s LEFT JOIN ftb_b f ON f.g = 'index' LEFT JOIN etb_b e ON e.g = s.month"
)
panel_chain("_fit", "trend_fit", "hzz_m")
CTE["hzz_rows"] = f"""
SELECT * FROM (SELECT month AS g, ticker AS o, next_ret_cc AS y, {', '.join(_RAT)}, count(*) OVER (PARTITION BY month) AS k
               FROM stock_months JOIN ma_ratios USING (ticker, month) WHERE eligible_price AND next_ret_cc IS NOT NULL AND
               {' AND '.join(f'{c} IS NOT NULL' for c in _RAT)}) WHERE k >= {CFG.min_names_multivariate}"""
regression_chain("hz", "hzz_rows", _RAT)
CTE["hzz_smooth"] = (
    "SELECT month, CASE WHEN c = 12 THEN a0 END AS b0, "
    + ", ".join(f"CASE WHEN c = 12 THEN a_{x} END AS b_{x}" for x in _RAT)
    + " FROM (SELECT g AS month, count(*) OVER w AS c, avg(b0) OVER w AS a0, "
    + ", ".join(f"avg(b_{x}) OVER w AS a_{x}" for x in _RAT)
    + " FROM hz_b WINDOW w AS (ORDER BY g ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))"
)
CTE["hzz_fit"] = (
    "SELECT r.ticker, r.month, b0" + "".join(f" + b_{x} * r.{x}" for x in _RAT)
    + " AS trend_hzz_raw FROM ma_ratios r LEFT JOIN hzz_smooth USING (month)"
)
panel_chain("_hzz", "trend_m", "hzz_fit")

_ORDER = list(CTE)


def _needs(body: str) -> set[str]:
    refs = re.findall(r"\b(?:FROM|JOIN)\s+\(?\s*([A-Za-z_]\w*)", body)
    commas = re.findall(r"\b(?:FROM|JOIN)\s+([A-Za-z_]\w*)", body)
    return {r for r in [*refs, *commas] if r in CTE}


def _hint(name: str) -> str:
    """Recursive expressions cannot be materialised explicitly; chains of the fits should be."""
    return "MATERIALIZED " if re.match(r"(ft|et|hz)[ab]?_", name) else ""


def oracle(query: str) -> str:
    """The query with every expression it depends on, in dependency order."""
    todo, seen = list(_needs(query)), set()
    while todo:
        name = todo.pop()
        if name in seen:
            continue
        seen.add(name)
        todo.extend(_needs(CTE[name]) - seen)
    parts = [f"{n} AS {_hint(n)}({CTE[n].strip()})" for n in _ORDER if n in seen]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + query.strip()
