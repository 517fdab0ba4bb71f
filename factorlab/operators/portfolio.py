"""Portfolio selection, exits, costs and the monthly equity path.

The equity recursion is an ordered fold: picks are reduced in parallel to one
small array per (run, month), and one higher-order ``aggregate`` per run walks
the months. Runs (specs, cost scenarios, simulations) are the parallel axis.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlab.config import CENTRAL_COST_BPS, COST_SCENARIOS, EngineConfig, StrategySpec, specs_frame
from factorlab.functions.nulls import ratio
from factorlab.operators.joins import nearest_year_join


def stop_take_return(stop: Column, take: Column, field: Callable[[str], Column] = F.col) -> Column:
    """Realised return of a monthly bar under optional stop and take levels.

    A touched stop wins over a touched take. A missing low or high counts as a
    touched stop (comparison with missing is false) and an untouched take.
    ``field`` finds the bar's columns, by default in the row.
    """
    low = ratio(field("next_low"), field("next_open")) - 1
    high = ratio(field("next_high"), field("next_open")) - 1
    stopped = stop.isNotNull() & ~F.coalesce(low > -F.abs(stop), F.lit(False))
    hit_stop = F.coalesce(low <= -F.abs(stop), F.lit(False))
    taken = F.coalesce(high >= F.abs(take), F.lit(False)) & ~hit_stop
    return F.when(taken, F.abs(take)).when(stopped, -F.abs(stop)).otherwise(field("next_ret_oc"))


def conditional_overwrite(value: Column, condition: Column, replacement: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), replacement).otherwise(value)


def topn_by_score(scores: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Best n rows per group. The rank limit is applied on the map side first
    (WindowGroupLimit), so a hot month sends n rows per task, not the month."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "ticker")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def regime_by_month(panel: DataFrame) -> DataFrame:
    """Months of the panel with their regime flag; a month without one counts as on."""
    return panel.groupBy("month").agg(F.max("regime_on").alias("_r")).select(
        "month", F.coalesce("_r", F.lit(True)).alias("regime_on")
    )


def cost_schedule(spark: SparkSession, scenarios: dict[str, float] = COST_SCENARIOS) -> DataFrame:
    """Year by scenario cost table (a literal of a few dozen rows)."""
    central = spark.createDataFrame(
        [(y, c, s) for y, (c, s) in CENTRAL_COST_BPS.items()], "year int, commission double, slippage double"
    )
    pairs = F.array(
        *[F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("scenario_multiplier")) for k, v in scenarios.items()]
    )
    out = central.select("*", F.inline(pairs))
    commission = F.col("commission") * F.col("scenario_multiplier")
    slippage = F.col("slippage") * F.col("scenario_multiplier")
    return out.select(
        "year",
        "scenario",
        "scenario_multiplier",
        commission.alias("commission_bps_per_side"),
        slippage.alias("slippage_bps_per_side"),
        (2.0 * (commission + slippage)).alias("round_trip_bps"),
    )


def monthly_costs(months: DataFrame, schedule: DataFrame, scenarios: list[str]) -> DataFrame:
    """(scenario, month, cost columns). Scenario "none" is the cost-free case."""
    grid = months.select("month", F.explode(F.array(*[F.lit(s) for s in scenarios])).alias("scenario"))
    priced = nearest_year_join(grid, schedule).drop("schedule_year", "scenario_multiplier")
    return priced


def spec_runs(spark: SparkSession, specs: list[StrategySpec], scenarios: list[str] | None = None) -> DataFrame:
    """Runs = specs x cost scenarios as a literal table."""
    labels = F.array(*[F.lit(s) for s in (scenarios or ["zero"])])
    return specs_frame(spark, specs).withColumn("scenario", F.explode(labels))


def realised_picks(picks: DataFrame, runs: DataFrame, costs: DataFrame) -> DataFrame:
    """Top picks x runs with gross, cost and net return. Runs and costs are literal
    or calendar-sized tables; picks are at most top_n rows per (variant, month)."""
    r = runs.select("strategy", "scenario", "variant", "top_n", "stop_loss", "take_profit", "regime_filter")
    joined = picks.join(F.broadcast(r), "variant").filter(F.col("rank") <= F.col("top_n"))
    joined = joined.join(F.broadcast(costs.select("scenario", "month", "round_trip_bps")), ["scenario", "month"], "left")
    drag = F.coalesce(F.col("round_trip_bps"), F.lit(0.0)) / 10_000.0
    gross = stop_take_return(F.col("stop_loss"), F.col("take_profit"))
    return (
        joined.withColumn("gross_stock_return", gross)
        .withColumn("cost_drag_per_holding", drag)
        .withColumn("realized_stock_return", F.col("gross_stock_return") - F.col("cost_drag_per_holding"))
    )


_STEP = (
    "array<struct<month: date, portfolio_return: double, pnl: double, equity: double, prev_equity: double, "
    "n_positions: int, per_position_dollars: double>>"
)


#: Months whose path is copied while it grows; finished stretches are only linked.
_STRETCH = 64


def fold_equity(monthly: DataFrame, keys: list[str], cfg: EngineConfig) -> DataFrame:
    """Walk each run's months in order, carrying equity.

    ``monthly`` has one row per (run, month): ``returns`` (realised returns by
    rank), ``top_n``, ``sizing_method``, ``sizing_target_pct``. An array holds
    at most top_n returns and a run at most one row per calendar month.

    The months are walked in stretches: a month is appended to the path of its
    own stretch alone, so the work is linear in the number of months.
    """
    steps = monthly.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct("month", "returns", "top_n", "sizing_method", "sizing_target_pct"))
        ).alias("_steps")
    )
    starts = F.sequence(F.lit(1), F.size("_steps"), F.lit(_STRETCH))
    stretches = steps.select(*keys, F.transform(starts, lambda i: F.slice("_steps", i, _STRETCH)).alias("_stretches"))

    def step(acc: Column, m: Column) -> Column:
        equity = acc["equity"]
        pct = m["sizing_method"] == "percent_of_equity"
        affordable = F.greatest(F.floor(equity / cfg.cash_per_trade), F.lit(0)).cast("int")
        limit = F.when(pct, m["top_n"]).otherwise(affordable)
        size = F.when(pct, m["sizing_target_pct"] * equity).otherwise(F.lit(cfg.cash_per_trade))

        def earn(b: Column) -> Column:
            total = F.aggregate(F.slice(m["returns"], 1, b["n"]), F.lit(0.0), lambda a, r: a + r)
            return b.withField("pnl", F.when(b["n"] > 0, b["size"] * total).otherwise(F.lit(0.0)))

        def book(b: Column) -> Column:
            ret = F.when(b["n"] > 0, F.when(equity > 0, b["pnl"] / equity)).otherwise(F.lit(0.0))
            row = F.struct(
                m["month"].alias("month"),
                ret.alias("portfolio_return"),
                b["pnl"].alias("pnl"),
                (equity + b["pnl"]).alias("equity"),
                equity.alias("prev_equity"),
                b["n"].alias("n_positions"),
                b["size"].alias("per_position_dollars"),
            )
            path = F.concat(acc["path"], F.array(row).cast(_STEP))
            return F.struct((equity + b["pnl"]).alias("equity"), path.alias("path"))

        # Positions, then profit, then the row: each is worked out once.
        begun = F.array(F.struct(F.least(m["top_n"], limit, F.size(m["returns"])).alias("n"), size.alias("size")))
        return F.get(F.transform(F.transform(begun, earn), book), F.lit(0))

    def begin(equity: Column) -> Column:
        return F.struct(equity.alias("equity"), F.array().cast(_STEP).alias("path"))

    def stretch(acc: Column, months: Column) -> Column:
        # One evaluation of the walk through the stretch, taken apart twice.
        walked = F.array(F.aggregate(months, begin(acc["equity"]), step))
        linked = F.transform(walked, lambda w: F.struct(w["equity"].alias("equity"), F.concat(acc["paths"], F.array(w["path"])).alias("paths")))
        return F.get(linked, F.lit(0))

    start = F.struct(F.lit(cfg.initial_cash).alias("equity"), F.array().cast(f"array<{_STEP}>").alias("paths"))
    return stretches.select(*keys, F.inline(F.flatten(F.aggregate("_stretches", start, stretch, lambda acc: acc["paths"]))))


def run_array(specs: list[StrategySpec], scenarios: list[str]) -> Column:
    """The runs as an array literal, to be exploded per month."""
    return F.array(
        *[
            F.struct(
                F.lit(s.name).alias("strategy"),
                F.lit(sc).alias("scenario"),
                F.lit(s.top_n).alias("top_n"),
                F.lit(s.sizing.method).alias("sizing_method"),
                F.lit(s.sizing.share).alias("sizing_target_pct"),
            )
            for s in specs
            for sc in scenarios
        ]
    )


def vector_backtest(
    picks: DataFrame, specs: list[StrategySpec], scenarios: list[str], months: DataFrame, costs: DataFrame, cfg: EngineConfig
):
    """Curves and picks of every run (spec x cost scenario) in one job.

    ``months`` is the panel's (month, regime_on) spine: months without picks stay
    in the curve with a zero return.
    """
    runs = spec_runs(picks.sparkSession, specs, scenarios)
    real = realised_picks(picks, runs, costs).withColumnRenamed("regime_filter", "_gate")
    real = real.join(F.broadcast(months), "month").filter(~F.col("_gate") | F.col("regime_on"))
    arrays = real.groupBy("strategy", "scenario", "month").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "realized_stock_return"))), lambda s: s["realized_stock_return"]
        ).alias("returns")
    )
    spine = months.select("month", F.inline(run_array(specs, scenarios)))
    monthly = spine.join(arrays, ["strategy", "scenario", "month"], "left").withColumn(
        "returns", F.coalesce("returns", F.array().cast("array<double>"))
    )
    path = fold_equity(monthly, ["strategy", "scenario"], cfg)
    curve = (
        path.join(F.broadcast(months), "month")
        .join(F.broadcast(costs), ["scenario", "month"], "left")
        .join(F.broadcast(runs.select("strategy", "scenario", "sizing_method")), ["strategy", "scenario"])
    )
    bps = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("commission_bps_per_side", "slippage_bps_per_side", "round_trip_bps")}
    curve = curve.withColumns(bps).withColumn(
        "cost_dollars", F.col("per_position_dollars") * F.col("round_trip_bps") / 10_000.0 * F.col("n_positions")
    )
    return curve, real


def holdings_log(curve: DataFrame, real: DataFrame) -> DataFrame:
    """Names actually held: picks whose rank fits the month's position count."""
    held = curve.select("strategy", "scenario", "month", "n_positions", "per_position_dollars")
    return (
        real.join(F.broadcast(held), ["strategy", "scenario", "month"])
        .filter(F.col("rank") <= F.col("n_positions"))
        .select(
            "strategy",
            "scenario",
            F.col("month").alias("signal_month"),
            "ticker",
            "sector",
            "rank",
            "score",
            F.col("per_position_dollars").alias("allocated_cash"),
            "gross_stock_return",
            "cost_drag_per_holding",
            "realized_stock_return",
        )
    )


def signals(holdings: DataFrame) -> DataFrame:
    """Signal month to ranked names."""
    return holdings.select("strategy", F.col("signal_month").alias("month"), "rank", "ticker")


def position_size(equity: Column, sizing_method: Column, target_pct: Column, cash: float) -> Column:
    return F.when(sizing_method == "percent_of_equity", target_pct * equity).otherwise(F.lit(cash))


def fixed_cash_shares(price: Column, cash: float, minimum: int = 0) -> Column:
    shares = F.coalesce(F.floor(ratio(F.lit(cash), price)), F.lit(0))
    return F.greatest(F.when(price > 0, shares).otherwise(F.lit(0)), F.lit(minimum)).cast("long")


def pct_equity_shares(price: Column, equity: Column, pct: float, minimum: int = 0) -> Column:
    shares = F.coalesce(F.floor(ratio(F.lit(pct) * equity, price)), F.lit(0))
    return F.greatest(F.when((price > 0) & (equity > 0), shares).otherwise(F.lit(0)), F.lit(minimum)).cast("long")


def bracket_prices(entry: Column, stop: float, take: float) -> tuple[Column, Column]:
    return F.round(entry * (1 - stop), 2), F.round(entry * (1 + take), 2)


def rebalance_diff(current: DataFrame, target: DataFrame) -> DataFrame:
    """Exit, enter or hold per ticker, within each strategy where the tables have one."""
    keys = [c for c in ("strategy", "ticker") if c in current.columns and c in target.columns]
    both = current.select(*keys).distinct().withColumn("_cur", F.lit(True)).join(
        target.select(*keys).distinct().withColumn("_tgt", F.lit(True)), keys, "full_outer"
    )
    action = F.when(F.col("_tgt").isNull(), "exit").when(F.col("_cur").isNull(), "enter").otherwise("hold")
    return both.select(*keys, action.alias("action"))


def long_only_check(positions: DataFrame, column: str = "shares") -> DataFrame:
    """Smallest position; the row's status is FAIL when any position is short."""
    return positions.agg(F.min(column).alias("min_size")).select(
        "min_size", F.when(F.coalesce(F.col("min_size") >= 0, F.lit(True)), "OK").otherwise("FAIL").alias("status")
    )
