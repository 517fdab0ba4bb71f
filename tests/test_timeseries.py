"""Bars, as-of joins, regressions and the no-look-ahead property."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from factorlab.config import EngineConfig
from factorlab.operators import bars, joins, portfolio, regress

CFG = EngineConfig(ma_windows=(3, 5), trend_min_obs=20, min_names_multivariate=10)


def month_ends(n, start="2000-01-31"):
    return [d.date() for d in pd.date_range(start, periods=n, freq="ME")]


def test_first_last_skip_nulls(spark):
    rows = [
        ("A", dt.date(2001, 1, 2), None, 10.0, 9.0, 9.5, 9.6, 100.0),
        ("A", dt.date(2001, 1, 3), 9.4, 11.0, 8.0, 9.7, 9.8, 50.0),
        ("A", dt.date(2001, 1, 4), 9.9, 10.5, 8.5, None, None, 25.0),
    ]
    df = spark.createDataFrame(
        rows, "ticker string, date date, adjOpen double, adjHigh double, adjLow double, adjClose double, close double, adjVolume double"
    )
    r = bars.monthly_bars(df).collect()[0]
    assert (r["open"], r["high"], r["low"], r["close"], r["raw_close"], r["volume"]) == (9.4, 11.0, 8.0, 9.7, 9.8, 175.0)
    assert r["last_date"] == dt.date(2001, 1, 4)
    same = bars.monthly_bars_with_signals(df, (2,)).collect()[0]
    assert (same["open"], same["close"], same["ma_dev_2"]) == (9.4, 9.7, None)


def test_moving_averages_match_pandas(spark):
    rng = np.random.default_rng(1)
    rows = []
    for t in ("A", "B"):
        for i, d in enumerate(pd.bdate_range("2001-01-01", periods=90)):
            rows.append((t, d.date(), None if (t == "B" and i == 40) else float(rng.uniform(50, 60))))
    df = spark.createDataFrame(rows, "ticker string, date date, p double")
    got = bars.ma_deviation(df, (3, 10, 30), "p").toPandas().set_index(["ticker", "month"]).sort_index()
    pdf = pd.DataFrame(rows, columns=["ticker", "date", "p"])
    pdf["month"] = (pd.to_datetime(pdf["date"]) + pd.offsets.MonthEnd(0)).dt.date
    for w in (3, 10, 30):
        ma = pdf.groupby("ticker")["p"].transform(lambda s, w=w: s.rolling(w, min_periods=w).mean())
        pdf[f"ma_dev_{w}"] = ma / pdf["p"] - 1
    want = pdf.sort_values("date").groupby(["ticker", "month"]).tail(1).set_index(["ticker", "month"]).sort_index()
    for w in (3, 10, 30):
        assert np.allclose(got[f"ma_dev_{w}"].astype(float), want[f"ma_dev_{w}"], equal_nan=True)


def test_latest_moving_averages_match_the_full_history(spark):
    """Short, long and gappy histories: the rank limit may drop no bar that a window needs."""
    rng = np.random.default_rng(3)
    rows = []
    for ticker, n in (("A", 90), ("B", 5), ("C", 4), ("D", 1), ("E", 60)):
        days = pd.bdate_range("2001-01-01", periods=n)
        price = [None if ticker == "E" and rng.random() < 0.2 else float(p) for p in 50 + rng.normal(size=n).cumsum()]
        rows += [(ticker, d.date(), p) for d, p in zip(days, price, strict=True)]
    rows += [("F", dt.date(2001, 1, d), None if d == 9 else 10.0) for d in range(1, 10)]
    df = spark.createDataFrame(rows, "ticker string, date date, p double").repartition(5)
    latest = bars.ma_deviation_latest(df, (3, 5), "p")
    whole = bars.ma_deviation(df, (3, 5), "p").toPandas().sort_values("month").groupby("ticker").tail(1)
    got = latest.toPandas().sort_values("ticker").reset_index(drop=True)
    want = whole.sort_values("ticker").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)
    # Limited by rank on the map side, then one exchange.
    plan = bars.ma_deviation_latest(df, (3, 5), "p")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") == 1


def test_lag_counts_rows_not_months(spark):
    rows = [("A", m, float(i + 1)) for i, m in enumerate(month_ends(16)) if i != 5]
    df = spark.createDataFrame(rows, "ticker string, month date, close double")
    got = bars.momentum_k(df, 12).orderBy("month").toPandas()
    assert got["momentum_12m"].notna().sum() == 3
    assert abs(got["momentum_12m"].iloc[12] - (rows[12][2] / rows[0][2] - 1)) < 1e-12


def test_asof_matches_null_rows_and_breaks_ties(spark):
    left = spark.createDataFrame([("A", m) for m in month_ends(6)], "ticker string, month date")
    stm = spark.createDataFrame(
        [
            ("A", dt.date(2000, 2, 15), 1999, 4, "roe", 0.1),
            ("A", dt.date(2000, 2, 15), 1999, 0, "roe", 0.2),  # annual row wins the tie
            ("A", dt.date(2000, 4, 30), 2000, 1, "roe", None),  # exact match, null value stays null
            ("A", dt.date(2000, 6, 1), 2000, 2, "other", 9.9),
        ],
        "ticker string, date_available date, fiscal_year int, fiscal_quarter int, data_code string, value double",
    )
    got = joins.asof_fundamental(left, stm).orderBy("month").toPandas()["roe"]
    assert got.isna().tolist() == [True, False, False, True, True, True]
    assert got[1] == 0.2 and got[2] == 0.2


def ols(y, x):
    d = np.column_stack([np.ones(len(y)), x])
    b, *_ = np.linalg.lstsq(d, y, rcond=None)
    return b, 1 - ((y - d @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_multivariate_betas_match_lstsq(spark):
    rng = np.random.default_rng(2)
    xs = ["ma_ratio_3", "ma_ratio_5"]
    frames, rows = {}, []
    for m in month_ends(3):
        a = 1 + 0.01 * rng.normal(size=60)
        b = a + 0.001 * rng.normal(size=60)  # nearly collinear, as moving averages are
        y = 0.02 + 0.5 * a - 0.3 * b + 0.05 * rng.normal(size=60)
        frames[m] = (y, np.column_stack([a, b]))
        rows += [(m, f"T{i}", float(y[i]), float(a[i]), float(b[i])) for i in range(60)]
    rows.append((month_ends(3)[0], "NULL", None, 1.0, 1.0))
    df = spark.createDataFrame(rows, "month date, ticker string, y double, ma_ratio_3 double, ma_ratio_5 double")
    for r in regress.xs_multivariate_betas(df, "y", xs, 10).collect():
        beta, r2 = ols(*frames[r["month"]])
        assert np.allclose([r["intercept"], r["ma_ratio_3"], r["ma_ratio_5"]], beta, rtol=1e-7)
        assert abs(r["r_squared"] - r2) < 1e-9 and r["n_obs"] == 60
    assert regress.xs_multivariate_betas(df, "y", xs, 61).count() == 0


def hac_by_loops(y, x, lags=3):
    """Covariance summed pair by pair, to check the matrix form."""
    d = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(d.T @ d)
    b = inv @ d.T @ y
    u = y - d @ b
    s = np.zeros((d.shape[1], d.shape[1]))
    for t in range(len(y)):
        for k in range(-lags, lags + 1):
            if 0 <= t + k < len(y):
                s += (1 - abs(k) / (lags + 1)) * u[t] * u[t + k] * np.outer(d[t], d[t + k])
    return b, np.sqrt(np.diag(inv @ s @ inv))


def history(spark, n=60, seed=4, bump=None):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = 0.01 + 0.8 * a + 0.5 * rng.normal(size=n)
    if bump is not None:
        y[bump:] += 5.0
        a[bump:] -= 3.0
    rows = [("index", m, float(y[i]), float(a[i]), float(b[i])) for i, m in enumerate(month_ends(n))]
    return spark.createDataFrame(rows, "series_id string, month date, next_ret double, ma_dev_3 double, ma_dev_5 double"), y, np.column_stack([a, b])


def test_full_sample_trend_selects_and_refits(spark):
    df, y, x = history(spark)
    got = {r["term"]: r for r in regress.index_trend_full(df, CFG.dev_cols, CFG).collect()}
    assert got["ma_dev_3"]["selected"] and not got["ma_dev_5"]["selected"]
    b, se = hac_by_loops(y, x[:, :1])
    assert np.allclose([got["const"]["coefficient"], got["ma_dev_3"]["coefficient"]], b)
    assert got["ma_dev_5"]["coefficient"] == 0.0 and got["ma_dev_5"]["refit_p_value"] is None
    full_b, full_se = hac_by_loops(y, x)
    import math

    want = math.erfc(abs(full_b[2] / full_se[2]) / math.sqrt(2))
    assert abs(got["ma_dev_5"]["full_model_p_value"] - want) < 1e-9


def test_expanding_trend_has_no_look_ahead(spark):
    cut = 45
    base, y, x = history(spark)
    bumped, *_ = history(spark, bump=cut)
    a = regress.expanding_trend_betas(base, CFG.dev_cols, CFG).toPandas().sort_values("month").reset_index(drop=True)
    b = regress.expanding_trend_betas(bumped, CFG.dev_cols, CFG).toPandas().sort_values("month").reset_index(drop=True)
    months = month_ends(60)
    early = a["month"] <= months[cut]
    assert a.loc[early, "intercept"].equals(b.loc[early, "intercept"])
    assert not a.loc[~early, "intercept"].equals(b.loc[~early, "intercept"])
    first = a.iloc[0]
    assert first["month"] == months[20] and first["n_obs"] == 20
    want, _ = hac_by_loops(y[:20], x[:20, :1])
    assert abs(first["ma_dev_3"] - want[1]) < 1e-9


def test_smoothing_excludes_current_row(spark):
    rows = [(m, i, float(i), float(i)) for i, m in enumerate(month_ends(5))]
    df = spark.createDataFrame(rows, "month date, n_obs int, intercept double, ma_ratio_3 double")
    got = regress.smooth_betas(df, ["ma_ratio_3"], 3).orderBy("month").toPandas()
    assert got["intercept"].isna().tolist() == [True, True, True, False, False]
    assert got["intercept"].tolist()[3:] == [1.0, 2.0]


def test_alpha_beta_matches_loops(spark):
    rng = np.random.default_rng(9)
    b = rng.normal(0, 0.04, 60)
    r = 0.004 + 0.7 * b + rng.normal(0, 0.02, 60)
    rows = [("s", m, float(r[i]), float(b[i])) for i, m in enumerate(month_ends(60))]
    df = spark.createDataFrame(rows, "strategy string, month date, portfolio_return double, benchmark_return double")
    got = regress.benchmark_alpha_beta(df).collect()[0]
    coef, se = hac_by_loops(r, b[:, None])
    assert np.allclose([got["monthly_alpha"], got["beta"]], coef)
    assert abs(got["alpha_t_stat"] - coef[0] / se[0]) < 1e-8


def test_one_exchange_and_one_sort_for_signals(spark):
    df = spark.createDataFrame([("A", dt.date(2001, 1, 1), 1.0)], "ticker string, date date, p double")
    plan = bars.ma_deviation(df, (3, 5, 10, 20), "p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1
    assert plan.count("Sort [ticker") == 1
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_scan_pushes_projection_and_cutoff(spark, ws):
    from factorlab.sources import scans

    df = spark.range(50).select(
        F.lit("A").alias("ticker"), F.date_add(F.lit(dt.date(2001, 1, 1)), F.col("id").cast("int")).alias("date"),
        *[F.col("id").cast("double").alias(c) for c in "open high low close volume adjOpen adjHigh adjLow adjClose adjVolume".split()],
    )
    path = ws.path("scan")
    df.write.parquet(path)
    got = scans.scan_prices(spark, path, dt.date(2001, 1, 20)).select("ticker", "adjClose")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(date), LessThanOrEqual(date,2001-01-20)]" in plan
    assert "adjOpen" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert got.count() == 20


def test_moving_averages_recover_from_a_nan(spark):
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=i) for i in range(200)]
    rows = [("A", d, float("nan") if i == 6 else 50.0 + i) for i, d in enumerate(days)]
    got = bars.ma_deviation(spark.createDataFrame(rows, "ticker string, date date, p double"), (3,), "p").toPandas()
    assert got["ma_dev_3"].notna().all()


def test_trend_without_a_fit_is_null(spark):
    terms = spark.createDataFrame([], "term string, coefficient double")
    row = regress.coefficients_wide(terms, ["ma_dev_3"]).first()
    assert row["intercept"] is None and row["ma_dev_3"] is None


def test_rebalance_keeps_strategies_apart(spark):
    held = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", "Y")], "strategy string, ticker string")
    wanted = spark.createDataFrame([("a", "Y"), ("b", "X")], "strategy string, ticker string")
    got = {(r.strategy, r.ticker): r.action for r in portfolio.rebalance_diff(held, wanted).collect()}
    assert got == {("a", "X"): "exit", ("a", "Y"): "hold", ("b", "Y"): "exit", ("b", "X"): "enter"}


def test_trend_fits_match_numpy_for_all_windows(spark):
    """Eleven regressors, two series at once, p-values within 1e-8; a repeated regressor gets no coefficient."""
    import math
    from dataclasses import replace

    rng = np.random.default_rng(21)
    cfg = replace(CFG, trend_min_obs=40, ma_windows=(3, 5, 10, 20, 50, 100, 200, 400, 600, 800, 1000))
    xs, n = cfg.dev_cols, 90
    months = [d.date() for d in pd.date_range("1990-01-31", periods=n, freq="ME")]
    frames = []
    for sid in ("a", "b"):
        x = rng.normal(size=(n, 11)) @ np.diag(np.linspace(0.01, 2, 11)) + 1
        y = 0.5 + x[:, 2] * 0.3 - x[:, 9] * 0.4 + rng.normal(0, 0.2, n)
        frames.append(pd.DataFrame(x, columns=xs).assign(next_ret=y, series_id=sid, month=months))
    both = pd.concat(frames)
    got = regress.index_trend_full(spark.createDataFrame(both).repartition(7), xs, cfg).toPandas().set_index(["series_id", "term"])

    def fit(y, x):
        d = np.column_stack([np.ones(n), x])
        inv = np.linalg.inv(d.T @ d)
        beta = inv @ d.T @ y
        s = d * (y - d @ beta)[:, None]
        meat = s.T @ s
        for k in range(1, cfg.hac_lags + 1):
            g = s[k:].T @ s[:-k]
            meat += (1 - k / (cfg.hac_lags + 1)) * (g + g.T)
        se = np.sqrt(np.diag(inv @ meat @ inv))
        return beta, [math.erfc(abs(b / e) / math.sqrt(2)) for b, e in zip(beta, se)]

    for sid, f in zip(("a", "b"), frames):
        y, x = f["next_ret"].to_numpy(), f[xs].to_numpy()
        _, p = fit(y, x)
        chosen = [j for j in range(11) if p[j + 1] <= cfg.trend_alpha]
        beta, q = fit(y, x[:, chosen])
        assert abs(got.loc[(sid, "const"), "full_model_p_value"] - p[0]) < 1e-8
        assert abs(got.loc[(sid, "const"), "coefficient"] - beta[0]) < 1e-9
        for j, c in enumerate(xs):
            r = got.loc[(sid, c)]
            assert abs(r["full_model_p_value"] - p[j + 1]) < 1e-8 and r["selected"] == (j in chosen)
            want = beta[1 + chosen.index(j)] if j in chosen else 0.0
            assert abs(r["coefficient"] - want) < 1e-9
            assert pd.isna(r["refit_p_value"]) if j not in chosen else abs(r["refit_p_value"] - q[1 + chosen.index(j)]) < 1e-8
    twin = both.assign(**{xs[5]: both[xs[2]]})
    again = regress.index_trend_full(spark.createDataFrame(twin), xs, cfg).toPandas().set_index(["series_id", "term"])
    assert again.loc[("a", xs[5]), "coefficient"] == 0.0 and pd.isna(again.loc[("a", xs[5]), "full_model_p_value"])


def test_panel_moves_ticks_once(spark, ws):
    """Bars that carry their metrics give the panel of separate tables, and no row of the panel is moved."""
    from dataclasses import replace

    from factorlab.catalog.context import CFG, lab
    from factorlab.plans import panel

    sf = "/root/testdata/sf0.001"
    lb = lab(spark, sf)
    whole = panel.raw_panel(lb.market, CFG, lb.trend_coefs, lb.expanding_coefs, lb.smoothed_betas)
    moved = [x for x in whole._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(ticker" in x]
    # Ticks by ticker; statement sums, statements by date, statements by ticker; names, unless they are broadcast.
    assert len(moved) <= 5 and not any("month" in x for x in moved)
    apart = replace(lb.market, prices=lb.prices, daily_metrics=lb.daily_metrics)
    split = panel.raw_panel(apart, CFG, lb.trend_coefs, lb.expanding_coefs)
    split = split.join(regress.hzz_predict(bars.ma_ratio(lb.ma_signals, CFG.ma_windows), lb.smoothed_betas, CFG.ratio_cols), ["ticker", "month"], "left")
    got, want = (df.select(*sorted(split.columns)).orderBy("ticker", "month").toPandas() for df in (whole, split))
    assert len(got) and whole.filter("trend_hzz_raw is not null and roe is not null and pe_ratio is not null").count()
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)


def test_rank_queries_move_their_own_columns_only(spark):
    from factorlab.catalog import market
    from factorlab.catalog.context import lab

    assert market._panel_slice(lab(spark, "/root/testdata/sf0.001")).columns == ["month", "ticker", "roe_z"]
