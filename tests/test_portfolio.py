"""Exits, folds, trades and resampling against plain-Python brute force."""

import datetime as dt
import math
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlab.config import EngineConfig, Exits, StrategySpec, stop_take_specs
from factorlab.operators import perf, portfolio, resample, tables, trades

CFG = EngineConfig(initial_cash=1_000_000.0)


def month_ends(n, start="2000-01-31"):
    return [d.date() for d in pd.date_range(start, periods=n, freq="ME")]


def test_stop_take_rules(spark):
    rows = [
        (100.0, 105.0, 85.0, 0.03, -0.10),  # stop touched
        (100.0, 125.0, 95.0, 0.03, 0.20),  # take touched
        (100.0, 125.0, 85.0, 0.03, -0.10),  # both: stop wins
        (100.0, 105.0, 95.0, 0.03, 0.03),  # neither
        (100.0, 105.0, None, 0.03, -0.10),  # missing low counts as a stop
        (100.0, 125.0, None, 0.03, 0.20),  # missing low with a touched take
    ]
    df = spark.createDataFrame(rows, "next_open double, next_high double, next_low double, next_ret_oc double, want double")
    for r in df.select("want", portfolio.stop_take_return(F.lit(0.10), F.lit(0.20)).alias("got")).collect():
        assert abs(r["want"] - r["got"]) < 1e-12
    none = F.lit(None).cast("double")
    assert {r[0] for r in df.select(portfolio.stop_take_return(none, none)).collect()} == {0.03}


def test_fold_matches_loop(spark):
    rng = np.random.default_rng(0)
    months = month_ends(40)
    rows, want = [], []
    for run, sizing in (("cash", "fixed_cash"), ("pct", "percent_of_equity")):
        equity = 1_000_000.0
        for m in months:
            rets = [float(x) for x in rng.normal(-0.05, 0.2, rng.integers(0, 12))]
            rows.append((run, m, rets, 10, sizing, 0.10))
            limit = 10 if sizing != "fixed_cash" else max(0, int(equity // 100_000))
            n = min(10, limit, len(rets))
            size = 0.10 * equity if sizing != "fixed_cash" else 100_000.0
            pnl = size * sum(rets[:n])
            want.append((run, m, n, pnl, equity + pnl))
            equity += pnl
    df = spark.createDataFrame(
        rows, "run string, month date, returns array<double>, top_n int, sizing_method string, sizing_target_pct double"
    ).repartition(5)
    got = portfolio.fold_equity(df, ["run"], CFG).orderBy("run", "month").collect()
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g["run"], g["month"], g["n_positions"]) == w[:3]
        assert math.isclose(g["pnl"], w[3], abs_tol=1e-6) and math.isclose(g["equity"], w[4], abs_tol=1e-6)


def walk_by_hand(bars, stop, take):
    """The stated daily rules as a plain loop over one ticker's bars."""
    out, held, entry, entry_i, shares, buying, selling = [], False, None, 0, 0, 0, 0
    for i, b in enumerate(bars, 1):
        exit_price, reason = None, None
        was_held, leaving = held, selling
        if held and selling == 1:
            exit_price, reason, held, selling = b["open"], "rebalance_exit", False, 0
        else:
            selling = max(selling - 1, 0)
            if not held and buying:
                held, entry, entry_i, shares = True, b["open"], i, buying
            elif was_held and leaving == 0:
                if stop is not None and b["low"] <= entry * (1 - stop):
                    exit_price, reason, held = min(b["open"], entry * (1 - stop)), "stop_loss", False
                elif take is not None and b["high"] >= entry * (1 + take):
                    exit_price, reason, held = max(b["open"], entry * (1 + take)), "take_profit", False
        if reason:
            out.append((entry, shares, exit_price, reason, i - entry_i))
        buying = 0
        if b["first"] and held and not b["target"] and selling == 0:
            selling = 1 if stop is None and take is None else 2
        if b["first"] and not held and b["target"]:
            buying = int(100_000 // b["close"])
    return [*out, (entry, shares, None, None, None)] if held else out


@pytest.mark.parametrize("stop,take", [(0.05, 0.10), (None, None), (0.03, None)])
def test_first_touch_matches_loop(spark, stop, take):
    rng = np.random.default_rng(7)
    prices, signals, want = [], [], 0
    days = list(pd.bdate_range("2000-01-03", periods=260))
    for t in ("A", "B", "C"):
        level = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, len(days))))
        held_months = {m for m in month_ends(12) if rng.random() < 0.5}
        signals += [("s", m, t) for m in held_months]
        bars, prev = [], None
        for d, c in zip(days, level):
            o = c * (1 + rng.normal(0, 0.01))
            hi, lo = max(o, c) * 1.01, min(o, c) * 0.99
            prices.append((t, d.date(), float(o), float(hi), float(lo), float(c)))
            before = (d.replace(day=1) - pd.Timedelta(days=1)).date()
            bars.append({"open": o, "high": hi, "low": lo, "close": c, "first": d.month != prev, "target": before in held_months})
            prev = d.month
        if held_months:
            want = (want or []) + [(t, *x) for x in walk_by_hand(bars, stop, take)]
    pdf = spark.createDataFrame(prices, "ticker string, date date, adjOpen double, adjHigh double, adjLow double, adjClose double")
    sig = spark.createDataFrame(signals, "strategy string, month date, ticker string")
    got = trades.first_touch_exits(trades.rebalance_bars(sig, pdf), stop, take, CFG).orderBy("ticker", "entry_date").collect()
    assert len(got) == len(want) > 3
    for g, (t, entry, shares, price, reason, n) in zip(got, want):
        assert (g["ticker"], g["shares"], g["reason"], g["bar_len"]) == (t, shares, reason, n)
        assert math.isclose(g["entry_price"], entry) and (g["exit_price"] is price if price is None else math.isclose(g["exit_price"], price))


def test_position_held_to_the_end_is_valued(spark):
    """Two wanted months and a price that rises to the last bar: no exit, and the account rises with it."""
    days = [d.date() for d in pd.bdate_range("2000-02-01", "2000-03-31")]
    prices = spark.createDataFrame([("A", d, *[50.0 + i] * 4) for i, d in enumerate(days)], "ticker string, date date, adjOpen double, adjHigh double, adjLow double, adjClose double")
    sig = spark.createDataFrame([("s", m, "A") for m in month_ends(2)], "strategy string, month date, ticker string")
    exits = trades.first_touch_exits(trades.rebalance_bars(sig, prices), 0.5, 9.0, CFG)
    assert [(r["exit_date"], r["reason"], r["shares"]) for r in exits.collect()] == [(None, None, 2000)]
    cal = prices.select("date")
    account = trades.mark_to_market(exits, trades.daily_positions(exits, prices, cal), cal, ["s"], CFG).orderBy("date").collect()
    assert account[-1]["market_value"] == 2000 * (50.0 + len(days) - 1)
    assert account[-1]["value"] == CFG.initial_cash + 2000 * (len(days) - 2)
    assert trades.trade_log(exits).count() == 0


def test_random_subset_draws_without_replacement(spark):
    df = spark.range(3000).select(
        "id", resample.random_subset(F.lit(5), F.lit(12), 1, F.col("id")).alias("s")
    )
    rows = [r["s"] for r in df.collect()]
    assert all(len(set(s)) == 5 and min(s) >= 1 and max(s) <= 12 for s in rows)
    for position in range(5):
        counts = np.bincount([s[position] for s in rows], minlength=13)[1:]
        assert counts.min() > 180 and counts.max() < 320  # expected 250 each
    whole = spark.range(5).select(resample.random_subset(F.lit(4), F.lit(4), 1, F.col("id")).alias("s")).collect()
    assert all(sorted(r["s"]) == [1, 2, 3, 4] for r in whole)


def test_draws_do_not_depend_on_partitioning(spark):
    def run(parts):
        df = spark.range(200).repartition(parts).select("id", resample.random_subset(F.lit(3), F.lit(50), 9, F.col("id")).alias("s"))
        return sorted((r["id"], tuple(r["s"])) for r in df.collect())

    assert run(1) == run(7)


def returns_frame(spark, data):
    months = month_ends(len(next(iter(data.values()))))
    rows = [(k, m, float(v[i])) for k, v in data.items() for i, m in enumerate(months)]
    return spark.createDataFrame(rows, "strategy string, month date, portfolio_return double")


def test_block_bootstrap_uses_contiguous_blocks(spark):
    df = returns_frame(spark, {"a": np.arange(20) / 1000.0, "short": np.arange(4)[:4].tolist() + [0.0] * 16})
    rows = resample.indexed_series(df, ["strategy"], "portfolio_return")
    draws = resample.block_draws(rows.select("strategy", "n").distinct(), ["strategy"], 30, 6, 1).toPandas()
    assert (draws.groupby(["strategy", "sim"]).size() == 20).all()
    inner = draws.sort_values(["strategy", "sim", "pos"])
    step = inner.groupby(["strategy", "sim"])["i"].diff()
    assert (step[(inner["pos"] % 6) != 0].dropna() == 1).all()
    assert inner["i"].between(0, 19).all() and inner["i"].max() == 19
    few = df.filter("month < '2000-05-01'")
    assert resample.block_bootstrap(few, ["strategy"], 5, 6, 1).count() == 0


def test_spa_and_stepm_size_and_power(spark):
    rng = np.random.default_rng(11)
    noise = {f"n{i}": rng.normal(0, 0.03, 120) for i in range(4)}
    bench = spark.createDataFrame([(m, 0.0) for m in month_ends(120)], "month date, benchmark_return double")
    null = resample.excess_matrix(returns_frame(spark, noise), bench)
    p = resample.hansen_spa(null, 300, 6, 2).collect()[0]
    assert p["p_value_lower"] <= p["p_value_consistent"] <= p["p_value_upper"]
    assert p["p_value_consistent"] > 0.05
    assert not any(r["superior"] for r in resample.romano_wolf_stepm(null, 300, 6, 2).collect())
    good = resample.excess_matrix(returns_frame(spark, {**noise, "good": rng.normal(0.03, 0.03, 120)}), bench)
    assert resample.hansen_spa(good, 300, 6, 2).collect()[0]["p_value_consistent"] < 0.05
    sup = {r["strategy"]: r["superior"] for r in resample.romano_wolf_stepm(good, 300, 6, 2).collect()}
    assert sup.pop("good") and not any(sup.values())


def test_stationary_variance_predicts_the_bootstrap(spark):
    rng = np.random.default_rng(13)
    x = np.convolve(rng.normal(0, 0.03, 123), np.ones(4) / 2, mode="valid")  # autocorrelated
    ex = returns_frame(spark, {"a": x.tolist()}).withColumnRenamed("portfolio_return", "excess")
    boot = resample.bootstrap_means(ex, 3000, 6, 5).toPandas()["boot_mean"]
    r = resample.stationary_variance(ex, 6).collect()[0]
    assert abs(r["se"] / boot.std() - 1) < 0.06
    d, n, q = x - x.mean(), len(x), 5 / 6
    v = (d @ d) / n
    for i in range(1, n):
        v += 2 * ((1 - i / n) * q**i + i / n * q ** (n - i)) * (d[:-i] @ d[i:]) / n
    assert math.isclose(r["se"], math.sqrt(v / n), rel_tol=1e-9)


def test_stepm_equals_iterated_step_down(spark):
    rng = np.random.default_rng(12)
    data = {f"s{i}": rng.normal(0.004 * i, 0.03, 120) for i in range(6)}
    bench = spark.createDataFrame([(m, 0.0) for m in month_ends(120)], "month date, benchmark_return double")
    ex = resample.excess_matrix(returns_frame(spark, data), bench)
    rows = resample.studentised(ex, 200, 6, 3).toPandas().rename(columns={"z_consistent": "z"})
    z, t = rows.pivot(index="rep", columns="strategy", values="z"), rows.groupby("strategy")["t_stat"].first()
    left, rejected = set(t.index), set()
    while left:
        crit = z[sorted(left)].max(axis=1).quantile(0.95)
        new = {s for s in left if t[s] > crit}
        if not new:
            break
        rejected |= new
        left -= new
    got = {r["strategy"] for r in resample.romano_wolf_stepm(ex, 200, 6, 3).filter("superior").collect()}
    assert got == rejected and 0 < len(rejected) < 6


def test_perf_metrics_match_pandas(spark):
    rng = np.random.default_rng(6)
    r = pd.Series(rng.normal(0.01, 0.04, 50))
    got = perf.perf_metrics(returns_frame(spark, {"a": r.tolist()}), ["strategy"]).collect()[0]
    wealth = (1 + r).cumprod()
    assert math.isclose(got["annualized_sharpe"], math.sqrt(12) * r.mean() / r.std())
    assert math.isclose(got["max_drawdown"], (wealth / wealth.cummax() - 1).min())
    assert math.isclose(got["cumulative_return"], wealth.iloc[-1] - 1)
    assert got["max_drawdown"] <= 0 and got["n_periods"] == 50


def test_grid_has_no_take_below_stop(spark):
    specs = stop_take_specs()
    assert len(specs) == 33 - 1 and len({s.name for s in specs}) == len(specs)
    grid = spark.createDataFrame(
        [(f"c{i}{j}", i, j, float(i + j), float(i * j), 0.1, -0.1) for i in range(3) for j in range(3)],
        "strategy string, stop_idx int, take_idx int, train_sharpe double, test_sharpe double, train_total_return double, train_max_drawdown double",
    )
    got = {r["strategy"]: r for r in tables.grid_stability(grid).collect()}
    assert got["c11"]["neighbor_count"] == 8 and got["c00"]["neighbor_count"] == 3
    assert got["c00"]["neighbor_train_sharpe_median"] == 1.0


def test_state_round_trip(spark, ws):
    from factorlab.sources import sinks

    held = spark.createDataFrame([("a", "T2"), ("a", "T1"), ("b", "T9")], "strategy string, ticker string")
    path = sinks.write_state(held, ws.path("state"), "2001-01-31")
    got = sorted((r["strategy"], r["ticker"]) for r in sinks.read_state(spark, path).collect())
    assert got == [("a", "T1"), ("a", "T2"), ("b", "T9")]
    assert sinks.read_state(spark, path + "-absent").count() == 0


def test_missing_tables_are_named(spark, ws):
    from factorlab.sources import scans

    with pytest.raises(FileNotFoundError, match="panel"):
        scans.scan_panel_checkpoint(spark, {"panel": ws.path("nothing")})


def test_workspace_clears_only_its_own_run(spark, ws):
    from factorlab.sources.scans import _exists
    from factorlab.sources.workspace import Workspace

    mine, keep = Workspace(spark), ws.materialise(spark.range(3), "keep")
    mine.materialise(spark.range(2), "gone")
    assert _exists(spark, mine.root)
    mine.clear()
    assert not _exists(spark, mine.root) and keep.count() == 3


def test_spec_variants_share_scores():
    a = StrategySpec("a", exits=Exits(stop=0.1))
    assert a.score_variant == StrategySpec("b", exits=Exits(take=0.2)).score_variant
    assert a.score_variant != StrategySpec("c", trend="trend_expanding_z").score_variant
    assert StrategySpec("x").scores_like(StrategySpec("base")) and not a.scores_like(StrategySpec("base"))


def test_cutoff_guard(spark):
    from factorlab.sources import scans

    df = spark.createDataFrame([(dt.date(2001, 1, 1),), (dt.date(2001, 2, 1),)], "date date")
    assert scans.assert_no_rows_after(df, dt.date(2001, 3, 1)).count() == 2
    with pytest.raises(Exception, match="cut-off"):
        scans.assert_no_rows_after(df, dt.date(2001, 1, 15)).collect()


def test_fold_is_linear_over_many_periods(spark):
    """5,000 periods equal the loop, and twice the periods take no more than some three times as long."""
    import time

    rng = np.random.default_rng(3)
    days = [d.date() for d in pd.date_range("1900-01-01", periods=5_000, freq="W")]
    rets = [[float(x) for x in rng.normal(0.001, 0.02, 10)] for _ in days]
    schema = "run string, month date, returns array<double>, top_n int, sizing_method string, sizing_target_pct double"

    def frame(n):
        return spark.createDataFrame([(s, d, r, 10, s, 0.1) for s in ("fixed_cash", "percent_of_equity") for d, r in zip(days[:n], rets)], schema).cache()

    took = []
    for n in (2_500, 5_000):
        df = frame(n)
        df.count()
        t = time.perf_counter()
        got = {(r["run"], r["month"]): r["equity"] for r in portfolio.fold_equity(df, ["run"], CFG).collect()}
        took.append(time.perf_counter() - t)
    assert took[1] < 3 * took[0] + 1
    for s in ("fixed_cash", "percent_of_equity"):
        equity = 1_000_000.0
        for d, r in zip(days, rets):
            n = 10 if s != "fixed_cash" else min(10, max(0, int(equity // 100_000)))
            equity += (0.1 * equity if s != "fixed_cash" else 100_000.0) * sum(r[:n])
            assert math.isclose(got[s, d], equity, rel_tol=1e-9)


def test_joined_block_summaries_equal_the_laid_out_path(spark):
    """10,000 resamples: joined summaries against every month laid out, and a series that loses everything."""
    rng = np.random.default_rng(11)
    rows = [(s, m, float(r)) for s, k in (("a", 46), ("b", 30), ("gone", 20)) for m, r in zip(month_ends(k), rng.normal(0.01, 0.08, k))]
    rows += [("gone", d, -1.0) for d in month_ends(1, "2020-01-31")]
    df = spark.createDataFrame(rows, "strategy string, month date, portfolio_return double")
    sims = {"a": 10_000, "b": 300, "gone": 50}
    for name, n in sims.items():
        one = df.filter(F.col("strategy") == name)
        got = {r["sim"]: r for r in resample.block_bootstrap(one, ["strategy"], n, 6, 9).collect()}
        assert len(got) == n
        src = resample.indexed_series(one, ["strategy"], "portfolio_return")
        draws = resample.block_draws(src.select("strategy", "n").distinct(), ["strategy"], min(n, 200), 6, 9)
        laid = draws.join(src.drop("n"), ["strategy", "i"]).toPandas().sort_values(["sim", "pos"])
        for sim, g in laid.groupby("sim"):
            w = np.cumprod(1 + g["r"].to_numpy())
            with np.errstate(all="ignore"):
                fall = np.nanmin(w / np.maximum.accumulate(w) - 1)
            assert math.isclose(got[sim]["cumulative_return"], w[-1] - 1, abs_tol=1e-9)
            assert math.isclose(got[sim]["max_drawdown"], fall, abs_tol=1e-9)
            assert math.isclose(got[sim]["annualized_sharpe"], g["r"].mean() / g["r"].std() * 12**0.5, rel_tol=1e-9)


def test_block_sums_equal_the_drawn_months(spark):
    rng = np.random.default_rng(12)
    rows = [(s, m, float(r)) for s in "ab" for m, r in zip(month_ends(37), rng.normal(0, 0.05, 37))]
    ex = spark.createDataFrame(rows, "strategy string, month date, excess double")
    means = {(r["rep"], r["strategy"]): r["boot_mean"] for r in resample.bootstrap_means(ex, 200, 6, 4).collect()}
    idx = resample.stationary_bootstrap_indices(ex.agg(F.count_distinct("month").alias("n")), 200, 6, 4).toPandas().sort_values(["rep", "t"])
    assert len(idx) == 200 * 37
    by = {s: np.array([r for q, _, r in rows if q == s]) for s in "ab"}
    for rep, g in idx.groupby("rep"):
        for s in "ab":
            assert math.isclose(means[rep, s], by[s][g["idx"].to_numpy()].mean(), abs_tol=1e-12)


def test_large_subsets_exhaust_small_universes(spark):
    df = spark.range(1, 60).select(F.col("id").alias("n"), resample.random_subset(F.lit(50), F.col("id"), 3, F.col("id")).alias("s"))
    for r in df.collect():
        k = min(50, r["n"])
        assert len(set(r["s"])) == len(r["s"]) == k and min(r["s"]) >= 1 and max(r["s"]) <= r["n"]


def test_state_versions(spark, ws):
    """A failed write keeps the old state, a second writer is refused, a folder may be read while it is written."""
    from factorlab.plans import live
    from factorlab.sources import sinks

    path = ws.path("state")
    schema = "strategy string, ticker string"

    def held(version=None):
        return sorted(r["ticker"] for r in sinks.read_state(spark, path, version).collect())

    sinks.write_state(spark.createDataFrame([("a", "T1"), ("a", "T2")], schema), path, "2001-01-31")
    assert sinks.state_version(spark, path) == 1
    broken = spark.createDataFrame([("a", "T3")], schema).withColumn("ticker", F.when(F.rand() < 2, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_state(broken, path, "2001-02-28")
    assert held() == ["T1", "T2"] and sinks.state_version(spark, path) == 1

    orders = portfolio.rebalance_diff(sinks.read_state(spark, path), spark.createDataFrame([("a", "T2"), ("a", "T4")], schema))
    live.rebalance_and_store(orders, path, pd.Timestamp("2001-02-28").date(), base=1)
    assert held() == ["T2", "T4"] and held(1) == ["T1", "T2"]
    with pytest.raises(sinks.StateConflict):
        live.rebalance_and_store(orders, path, pd.Timestamp("2001-02-28").date(), base=1)

    assert sinks._claim(spark, path, 3)  # a writer that never came back
    with pytest.raises(sinks.StateConflict):
        sinks.write_state(spark.createDataFrame([("a", "T5")], schema), path, "2001-03-31")
    sinks.write_state(spark.createDataFrame([("a", "T5")], schema), path, "2001-03-31", take_over=True)
    assert held() == ["T5"] and sinks.state_version(spark, path) == 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables absent")
def test_trades_read_the_bars_of_wanted_names_alone(spark):
    """No bar of another ticker is written or moved for trades, and the trades are those of the whole table."""
    from factorlab.catalog.context import Lab, all_specs

    lab = Lab(spark, "/root/testdata/sf0.001")
    names = [r["ticker"] for r in lab.prices.select("ticker").distinct().orderBy("ticker").limit(3).collect()]
    rows = [(all_specs()[i % 2].name, m, t, 50_000.0) for i, t in enumerate(names) for m in month_ends(24, "1998-01-31")]
    lab.__dict__["holdings"] = spark.createDataFrame(rows, "strategy string, signal_month date, ticker string, allocated_cash double")
    got = sorted(lab.exits.collect(), key=repr)
    assert got and "tables" not in lab.__dict__
    assert {r["ticker"] for r in lab.held_prices.select("ticker").collect()} == set(names)
    book = trades.rebalance_bars(lab.trade_signals, lab.prices)
    assert got == sorted(trades.first_touch_exits(book, None, None, lab.cfg, lab.trade_levels).collect(), key=repr)


def test_a_written_table_frees_its_shuffle_files(spark, ws):
    from factorlab.sources.workspace import CLEANUP

    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        found = set()
        while files.hasNext():
            name = files.next().getName()
            if name.startswith("shuffle_"):
                found.add(name)
        return found

    before, setting = held(), spark.conf.get(CLEANUP, None)
    out = ws.materialise(spark.range(50_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and spark.conf.get(CLEANUP, None) == setting
    assert sorted(r["count"] for r in out.collect()) == [7142] + [7143] * 6
