"""Comparison tables over small summary frames, and the stop/take grid analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlab.functions.stats import significance_stars
from factorlab.operators.xsection import unpivot


def union_runs(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def order_by_metric(metrics: DataFrame, metric: str) -> DataFrame:
    return metrics.orderBy(F.desc_nulls_last(metric), "strategy")


def metrics_enrich(metrics: DataFrame, log: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    out = metrics.join(log, "strategy", "left")
    return out if bench is None else out.join(bench, "strategy", "left")


def staged_role_order(metrics: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Role label and its position for the staged strategies, in ladder order."""
    role = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])[F.col("strategy")]
    position = F.array_position(F.array(*[F.lit(r) for r in roles.values()]), role)
    return metrics.withColumn("role", role).filter(F.col("role").isNotNull()).withColumn("role_order", position)


def ordinal_index(df: DataFrame, column: str, levels: list[float], out: str) -> DataFrame:
    """Position of a level in its sorted list, 0-based."""
    ordered = F.array(*[F.lit(float(v)) for v in sorted(levels)])
    return df.withColumn(out, (F.array_position(ordered, F.col(column)) - 1).cast("int"))


def grid_neighbour_join(grid: DataFrame) -> DataFrame:
    """Each grid cell beside its neighbours (index distance at most one, not itself).

    The one-step offsets are generated per cell, so the neighbours are found by
    an equi-join on the two indices.
    """
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    cell = grid.select(
        "strategy", F.col("stop_idx").alias("_s"), F.col("take_idx").alias("_t"), F.explode(steps).alias("_ds")
    ).select("strategy", "_s", "_t", "_ds", F.explode(steps).alias("_dt"))
    cell = cell.filter((F.col("_ds") != 0) | (F.col("_dt") != 0)).select(
        "strategy", (F.col("_s") + F.col("_ds")).alias("stop_idx"), (F.col("_t") + F.col("_dt")).alias("take_idx")
    )
    other = grid.select(
        F.col("strategy").alias("neighbour"), "stop_idx", "take_idx", "train_sharpe", "test_sharpe"
    )
    return cell.join(other, ["stop_idx", "take_idx"])


def grid_stability(grid: DataFrame) -> DataFrame:
    """Neighbour medians, stability gap and robust score of every grid cell."""
    stats = grid_neighbour_join(grid).groupBy("strategy").agg(
        F.percentile("train_sharpe", F.lit(0.5)).alias("neighbor_train_sharpe_median"),
        F.percentile("test_sharpe", F.lit(0.5)).alias("neighbor_test_sharpe_median"),
        F.count("*").alias("neighbor_count"),
    )
    out = grid.join(stats, "strategy", "left").withColumn("neighbor_count", F.coalesce("neighbor_count", F.lit(0)))
    gap = F.col("train_sharpe") - F.col("neighbor_train_sharpe_median")
    score = F.col("train_sharpe") + F.coalesce("train_max_drawdown", F.lit(0.0)) - F.coalesce(F.abs(gap), F.lit(0.0))
    return out.withColumn("train_stability_gap", gap).withColumn("robust_train_score", score)


def argmax_select(grid: DataFrame) -> DataFrame:
    """Best cell under the training-only eligibility rule, else best overall."""
    ok = (
        F.col("train_sharpe").isNotNull()
        & (F.col("train_total_return") > 0)
        & (F.col("train_max_drawdown") > -0.25)
        & (F.col("neighbor_count") >= 3)
    )
    return (
        grid.withColumn("grid_eligible", F.coalesce(ok, F.lit(False)))
        .orderBy(F.desc("grid_eligible"), F.desc_nulls_last("robust_train_score"), F.desc_nulls_last("train_sharpe"), "strategy")
        .limit(1)
    )


def top10_grid(grid: DataFrame) -> DataFrame:
    """Ten best cells by training score and, for the report, by test result."""

    def best(kind: str, *metrics: str) -> DataFrame:
        w = Window.partitionBy(F.lit(0)).orderBy(*[F.desc_nulls_last(m) for m in metrics], "strategy")  # grid-sized
        return (
            grid.withColumn("rank", F.row_number().over(w))
            .filter("rank <= 10")
            .select(F.lit(kind).alias("ranking"), "rank", "strategy", "robust_train_score", "train_sharpe", "test_sharpe")
        )

    return best("train", "robust_train_score", "train_sharpe").unionByName(
        best("test", "test_sharpe", "test_max_drawdown")
    )


def selected_flag(df: DataFrame, metric: str) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(metric), "strategy")  # one row per strategy
    return df.withColumn("selected", F.row_number().over(w) == 1)


def pivot_grid(grid: DataFrame, takes: list[float], metric: str) -> DataFrame:
    wide = grid.groupBy("stop_loss").pivot("take_profit", takes).agg(F.max(metric))
    return wide.select("stop_loss", *[F.col(f"`{t}`").alias(f"take_{round(t * 1000):03d}") for t in takes])


def scenario_pivot(grid: DataFrame, scenarios: list[str], metrics: list[str]) -> DataFrame:
    wide = grid.groupBy("strategy").pivot("scenario", scenarios).agg(*[F.max(m).alias(m) for m in metrics])
    return wide.select("strategy", *[F.col(f"{s}_{m}") for s in scenarios for m in metrics])


def scoreboard(metrics: DataFrame, mc: DataFrame, stepm: DataFrame) -> DataFrame:
    cols = ["annualized_sharpe", "annualized_return_approx", "max_drawdown", "cumulative_return", "final_equity"]
    return (
        metrics.select("strategy", *cols)
        .join(mc.select("strategy", F.col("p_value").alias("mc_p_value")), "strategy", "left")
        .join(stepm.select("strategy", F.col("superior").alias("beats_benchmark")), "strategy", "left")
        .withColumn("beats_benchmark", F.coalesce("beats_benchmark", F.lit(False)))
    )


def head_to_head(metrics: DataFrame, a: str, b: str, better: dict[str, str]) -> DataFrame:
    """Metric-by-metric comparison. ``better`` maps a metric to "high", "low" or
    "low_abs" (compare magnitudes, smaller wins)."""
    long = unpivot(metrics, ["strategy"], {m: m for m in better}, "metric", "value")
    rule = F.create_map(*[F.lit(x) for pair in better.items() for x in pair])[F.col("metric")]
    long = long.withColumn("rule", rule).withColumn(
        "value", F.when(F.col("rule") == "low_abs", F.abs("value")).otherwise(F.col("value"))
    )
    va = F.max(F.when(F.col("strategy") == a, F.col("value")))
    vb = F.max(F.when(F.col("strategy") == b, F.col("value")))
    wide = long.groupBy("metric", "rule").agg(va.alias("value_a"), vb.alias("value_b"))
    lead = F.col("value_a") - F.col("value_b")
    better_a = F.when(F.col("rule") == "high", lead > 0).otherwise(lead < 0)
    winner = F.when(lead.isNull(), "").when(lead == 0, "tie").when(better_a, a).otherwise(b)
    return wide.select("metric", "value_a", "value_b", lead.alias("delta"), winner.alias("winner"))


def vs_baseline_summary(frames: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Selected columns of several result tables stacked under a source label."""
    parts = [
        df.select(F.lit(label).alias("engine"), "strategy", *[c for c in columns if c in df.columns])
        for label, df in frames.items()
    ]
    return union_runs(*parts)


def factor_premia_table(summary: DataFrame) -> DataFrame:
    approach = (
        F.when(F.col("approach") == "portfolio_sort", "Portfolio")
        .when(F.col("approach") == "cross_sectional_regression", "Regression")
        .otherwise(F.col("approach"))
    )
    return summary.select(
        F.upper("factor").alias("factor"),
        approach.alias("approach"),
        "annualized_sharpe",
        "annualized_return_approx",
        "t_stat",
        "p_value",
        significance_stars(F.col("p_value")).alias("stars"),
        "avg_ic",
        "avg_rank_ic",
    )


def ic_means(ic: DataFrame) -> DataFrame:
    return ic.groupBy("factor").agg(F.avg("ic").alias("mean_ic"), F.avg("rank_ic").alias("mean_rank_ic"))


def median_diagnostics(betas: DataFrame, smoothed: DataFrame) -> DataFrame:
    b = betas.agg(
        F.count("*").alias("n_beta_months"),
        F.percentile("n_obs", F.lit(0.5)).alias("median_cross_section_size"),
        F.percentile("r_squared", F.lit(0.5)).alias("median_r_squared"),
    )
    usable = F.col("intercept").isNotNull()
    s = smoothed.agg(
        F.count_if(usable).alias("n_smoothed_months_usable"), F.min(F.when(usable, F.col("month"))).alias("first_usable_month")
    )
    # Two one-row tables side by side: stack them and keep each column's only value.
    both = b.unionByName(s, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def coverage_by_month(panel: DataFrame, signal: str) -> DataFrame:
    out = panel.groupBy("month").agg(
        F.count_if("eligible").alias("n_eligible"), F.count(signal).alias("n_signal")
    )
    return out.withColumn("coverage_pct", F.try_divide(F.col("n_signal") * 100.0, F.col("n_eligible")))
