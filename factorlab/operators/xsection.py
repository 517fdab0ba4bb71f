"""Cross-sectional operators: z-scores, information coefficients, factor portfolios.

The panel itself is never shuffled by month. Per-month statistics are partial
aggregates whose results are month-keyed, hence small enough to broadcast back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlab.functions.nulls import finite, ratio
from factorlab.operators import ranks
from factorlab.sources.workspace import Workspace

WINSOR = (0.01, 0.99)


def unpivot(df: DataFrame, ids: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """Long form of ``{label: column}``; a narrow projection, no shuffle."""
    pairs = F.array(*[F.struct(F.lit(k).alias(name), F.col(c).cast("double").alias(value)) for k, c in columns.items()])
    return df.select(*ids, F.inline(pairs))


def _winsor_moments(clean: DataFrame, targets: list[str], key: str, min_names: int) -> DataFrame:
    """Clip bounds, mean and deviation of the clipped values per month, one struct column per target.

    Only the brackets around the bounds are counted value by value; what lies between enters by its moments, so the
    clipped rows need no pass of their own. NULL below ``min_names`` values.
    """
    cells = ranks.quantile_cells(clean, [key], {t: f"_x_{t}" for t in targets}, list(WINSOR)).filter(F.col("n") >= min_names)
    group = Window.partitionBy(key, "_f")
    inner = F.col("_v").isNull() & (F.col("_region") == len(WINSOR))
    at = F.least(F.greatest(F.coalesce("_v", "_m"), F.col("q")[0]), F.col("q")[1])
    # Deviations from one of the clipped values: equal values give a deviation of exactly zero.
    cells = cells.withColumn("_at", at).withColumn("_ref", F.max("_at").over(group))
    cells = cells.withColumn("_mean", F.col("_ref") + F.sum(F.col("_c") * (F.col("_at") - F.col("_ref"))).over(group) / F.col("n"))
    spread = F.when(inner, F.col("_s")).otherwise(0.0) + F.pow(F.col("_at") - F.col("_mean"), 2)
    found = cells.groupBy(key, "_f").agg(
        F.first(F.col("q")[0]).alias("lo"),
        F.first(F.col("q")[1]).alias("hi"),
        F.first("_mean").alias("m"),
        F.sqrt(F.sum(F.col("_c") * spread) / F.sum("_c")).alias("d"),
    )
    packed = F.struct("lo", "hi", "m", "d")
    return found.groupBy(key).agg(*[F.max(F.when(F.col("_f") == t, packed)).alias(f"_q_{t}") for t in targets])


def winsor_zscore(
    panel: DataFrame, columns: dict[str, str], min_names: int, key: str = "month", ws: Workspace | None = None
) -> DataFrame:
    """Add z-scores ``{source: target}`` per month, clipped at the 1 % and 99 % quantiles.

    NULL when a month has fewer than ``min_names`` values or no dispersion. With a workspace the bounds and moments
    are written once: the scores are then a projection of the panel, which needs no copy of its own.
    """
    clean = panel.withColumns({f"_x_{t}": finite(s) for s, t in columns.items()})
    targets = list(columns.values())
    scores = {}
    for t in targets:
        x, s = F.col(f"_x_{t}"), F.col(f"_q_{t}")
        # least and greatest pass over NULL, so a missing value has to be asked for.
        clipped = F.when(x.isNotNull(), F.least(F.greatest(x, s["lo"]), s["hi"]))
        scores[t] = ratio(clipped - s["m"], s["d"])
    moments = _winsor_moments(clean, targets, key, min_names)
    if ws is not None:
        moments = ws.materialise(moments, "winsor_moments")
    # Month-keyed, hence bounded by the calendar.
    scored = clean.join(F.broadcast(moments), key, "left").withColumns(scores)
    return scored.select(*[c for c in panel.columns if c not in targets], *targets)


def factor_long(panel: DataFrame, factors: dict[str, str], min_names: int) -> DataFrame:
    """(month, factor, ticker, z, ret, n) for eligible rows of large enough cross-sections."""
    rows = (
        unpivot(
            panel.filter("eligible").withColumn("ret", finite("next_ret_cc")), ["month", "ticker", "ret"], factors, "factor", "z"
        )
        .withColumn("z", finite("z"))
        .dropna(subset=["z", "ret"])
    )
    sizes = rows.groupBy("month", "factor").agg(F.count("*").alias("n")).filter(F.col("n") >= min_names)
    return rows.join(F.broadcast(sizes), ["month", "factor"])


def quintile_legs(long: DataFrame, ws: Workspace) -> DataFrame:
    ranked = ranks.rank_first(long, ["month", "factor"], ["z", "ticker"], "rank", ws)
    return ranked.withColumn("quintile", ranks.quintile_bucket(F.col("rank"), F.col("n")))


def fmp_portfolio_sort(legs: DataFrame) -> DataFrame:
    """Top minus bottom quintile mean return per (month, factor)."""

    def leg(q: int):
        return F.when(F.col("quintile") == q, F.col("ret"))

    out = legs.groupBy("month", "factor").agg(
        F.avg(leg(5)).alias("top_return"),
        F.avg(leg(1)).alias("bottom_return"),
        F.count(leg(5)).alias("n_top"),
        F.count(leg(1)).alias("n_bottom"),
    )
    return out.withColumn("portfolio_fmp_return", F.col("top_return") - F.col("bottom_return"))


def fmp_weights(legs: DataFrame) -> DataFrame:
    """+1/n for the top leg and -1/n for the bottom leg, per name."""
    sizes = (
        legs.filter(F.col("quintile").isin(1, 5))
        .groupBy("month", "factor", "quintile")
        .agg(F.count("*").alias("_n"))
    )
    sign = F.when(F.col("quintile") == 5, 1.0).otherwise(-1.0)
    return legs.join(F.broadcast(sizes), ["month", "factor", "quintile"]).select(
        "month", "factor", "ticker", (sign / F.col("_n")).alias("weight")
    )


def xs_univariate_fmp(long: DataFrame) -> DataFrame:
    """Cross-sectional OLS of the next return on one z-score, per (month, factor)."""
    m = long.groupBy("month", "factor").agg(
        F.regr_slope("ret", "z").alias("regression_fmp_return"),
        F.regr_r2("ret", "z").alias("regression_r2"),
        F.regr_sxx("ret", "z").alias("_sxx"),
        F.regr_syy("ret", "z").alias("_syy"),
        F.regr_sxy("ret", "z").alias("_sxy"),
        F.count("*").alias("n_obs"),
    )
    slope = F.col("regression_fmp_return")
    s2 = ratio(F.col("_syy") - slope * F.col("_sxy"), F.col("n_obs") - 2)
    t = ratio(slope, F.sqrt(ratio(s2, F.col("_sxx"))))
    return m.withColumn("regression_t_stat", t).drop("_sxx", "_syy", "_sxy")


def information_coefficients(long: DataFrame, ws: Workspace) -> DataFrame:
    """Pearson and Spearman correlation of z and next return per (month, factor)."""
    keys = ["month", "factor"]
    both = ranks.rank_average(long, keys, "z", "ticker", "_rz", ws)
    both = ranks.rank_average(both, keys, "ret", "ticker", "_rr", ws)
    return both.groupBy(*keys).agg(
        F.corr("z", "ret").alias("ic"), F.corr("_rz", "_rr").alias("rank_ic"), F.count("*").alias("n_obs")
    )


def pearson_ic(long: DataFrame) -> DataFrame:
    return long.groupBy("month", "factor").agg(F.corr("z", "ret").alias("ic"), F.count("*").alias("n_obs"))


def ic_summary(ic: DataFrame) -> DataFrame:
    def t_stat(c: str):
        t = ratio(F.avg(c), F.stddev_samp(c) / F.sqrt(F.count(c)))
        return F.when(F.count(c) > 2, t)

    return ic.groupBy("factor").agg(
        F.avg("ic").alias("avg_ic"),
        F.avg("rank_ic").alias("avg_rank_ic"),
        t_stat("ic").alias("ic_t"),
        t_stat("rank_ic").alias("rank_ic_t"),
    )


def mean_std_count_by_factor(ic: DataFrame) -> DataFrame:
    return ic.groupBy("factor").agg(
        F.avg("rank_ic").alias("mean"), F.stddev_samp("rank_ic").alias("std"), F.count("rank_ic").alias("count")
    )


def selected_date_snapshot(df: DataFrame, target, column: str = "month") -> DataFrame:
    """Rows of the latest month not after ``target``."""
    newest = df.filter(F.col(column) <= F.lit(target)).agg(F.max(column).alias(column))
    return df.join(F.broadcast(newest), column, "left_semi")


def common_start_filter(df: DataFrame, key: str = "factor") -> DataFrame:
    """Rows from the first month at which every key has started."""
    starts = df.groupBy(key).agg(F.min("month").alias("_s"))
    # One row per factor.
    latest = F.max("_s").over(Window.partitionBy(F.lit(0)))
    starts = starts.select(key, latest.alias("common_start"))
    return df.join(F.broadcast(starts), key).filter(F.col("month") >= F.col("common_start"))


def top_weights(weights: DataFrame, k: int = 20) -> DataFrame:
    """Largest k weights per factor at the latest month."""
    newest = weights.agg(F.max("month").alias("month"))
    w = Window.partitionBy("factor").orderBy(F.desc("weight"), "ticker")
    return (
        weights.join(F.broadcast(newest), "month", "left_semi")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
    )
