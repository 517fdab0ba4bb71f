"""Composite scores and factor weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlab.config import FACTORS, StrategySpec
from factorlab.functions.nulls import _c, ratio


def composite(columns: list[str | Column], need: int = 3) -> Column:
    """Mean of the available values, NULL when fewer than ``need`` are present."""
    cols = [_c(c) for c in columns]
    count = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(count >= need, total / count)


def composite_min3(panel: DataFrame, columns: list[str], out: str = "composite_score") -> DataFrame:
    return panel.withColumn(out, composite(columns, 3))


def weighted_score(values: list[Column], weights: list[Column]) -> Column:
    """Weighted sum over total absolute weight; NULL when any factor is missing."""
    num = sum((v * w for v, w in zip(values[1:], weights[1:])), values[0] * weights[0])
    den = sum((F.abs(w) for w in weights[1:]), F.abs(weights[0]))
    return ratio(num, den)


def static_weights(months: DataFrame, spec: StrategySpec) -> DataFrame:
    """Normalised constant weights, one row per month."""
    total = sum(abs(w) for w in spec.weights.values())
    return months.select(
        "month",
        F.lit(spec.name).alias("strategy"),
        F.lit("static").alias("method"),
        F.lit(None).cast("int").alias("lookback_months"),
        F.lit(None).cast("int").alias("min_periods"),
        F.lit(None).cast("double").alias("shrink_to_equal"),
        F.lit(None).cast("double").alias("min_factor_weight"),
        F.lit(None).cast("double").alias("max_factor_weight"),
        *[F.lit(w / total).alias(f"weight_{f}") for f, w in spec.weights.items()],
    )


def bounded_simplex(raw: Column, size: int, lower: float, upper: float) -> Column:
    """Project non-negative raw weights onto bounds that sum to one.

    Each pass rescales the free weights to the remaining mass and pins those
    outside the bounds; every pass but the last pins at least one, so ``size``
    passes suffice. Native higher-order functions, no UDF.
    """
    if lower * size > 1.0 or upper * size < 1.0:
        raise ValueError(f"{size} weights between {lower} and {upper} cannot sum to one")
    clean = F.transform(raw, lambda v: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)))
    total = F.aggregate(clean, F.lit(0.0), lambda a, v: a + v)
    base = F.transform(clean, lambda v: F.when(total > 0, v / total).otherwise(F.lit(1.0 / size)))
    state = F.transform(base, lambda v: F.struct(v.alias("raw"), F.lit(0.0).alias("val"), F.lit(False).alias("pinned")))

    def one_pass(s: Column, _: Column) -> Column:
        free_sum = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.when(x["pinned"], 0.0).otherwise(x["raw"]))
        free_n = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.when(x["pinned"], 0.0).otherwise(1.0))
        mass = F.lit(1.0) - F.aggregate(s, F.lit(0.0), lambda a, x: a + x["val"])

        def candidate(x: Column) -> Column:
            return F.when(free_sum > 0, x["raw"] / free_sum * mass).otherwise(mass / free_n)

        def outside(x: Column) -> Column:
            return ~x["pinned"] & ((candidate(x) < lower) | (candidate(x) > upper))

        any_out = F.exists(s, outside)

        def settle(x: Column) -> Column:
            c = candidate(x)
            pinned = F.when(c < lower, F.lit(lower)).when(c > upper, F.lit(upper)).otherwise(c)
            move = ~x["pinned"] & (~any_out | (c < lower) | (c > upper))
            return F.struct(
                x["raw"].alias("raw"),
                F.when(move, pinned).otherwise(x["val"]).alias("val"),
                (x["pinned"] | move).alias("pinned"),
            )

        return F.transform(s, settle)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(size)), state, one_pass)
    mass = F.aggregate(done, F.lit(0.0), lambda a, x: a + x["val"])
    return F.transform(done, lambda x: x["val"] / mass)


def trailing_ic_stats(months: DataFrame, ic: DataFrame, lookback: int) -> DataFrame:
    """Per (month, factor): mean, std and count of rank IC over the last ``lookback``
    months that have any IC, strictly before the month; plus how many such months.

    All tables here have one row per calendar month and factor.
    """
    usable = ic.filter(F.col("rank_ic").isNotNull()).select("month", "factor", "rank_ic")
    has_ic = usable.select("month").distinct().withColumn("_has", F.lit(1))
    before = Window.partitionBy(F.lit(0)).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    spine = months.join(F.broadcast(has_ic), "month", "left").withColumn(
        "_before", F.coalesce(F.sum("_has").over(before), F.lit(0))
    )
    grid = spine.select("month", "_before", F.explode(F.array(*[F.lit(f) for f in FACTORS])).alias("factor"))
    grid = grid.join(F.broadcast(usable), ["month", "factor"], "left").withColumn("_i", F.col("_before") + 1)
    w = Window.partitionBy("factor").orderBy("_i")
    w = w.rangeBetween(-lookback, -1) if lookback > 0 else w.rangeBetween(Window.unboundedPreceding, -1)
    n_months = F.least(F.lit(lookback), F.col("_before")) if lookback > 0 else F.col("_before")
    return grid.select(
        "month",
        "factor",
        F.avg("rank_ic").over(w).alias("mean"),
        F.stddev_samp("rank_ic").over(w).alias("std"),
        F.count("rank_ic").over(w).alias("count"),
        n_months.alias("n_months"),
    )


def rolling_ic_weights(months: DataFrame, ic: DataFrame, spec: StrategySpec) -> DataFrame:
    """Past-only factor weights from the information ratio of rank IC."""
    stats = trailing_ic_stats(months, ic, spec.weighting.lookback)
    strength = F.coalesce(F.greatest(ratio(F.col("mean"), F.nullif(F.col("std"), F.lit(0.0))), F.lit(0.0)), F.lit(0.0))
    per = stats.withColumn("_s", strength).groupBy("month").agg(
        F.max("n_months").alias("_n"),
        *[F.max(F.when(F.col("factor") == f, F.col("_s"))).alias(f"_s_{f}") for f in FACTORS],
    )
    total = sum((F.col(f"_s_{f}") for f in FACTORS[1:]), F.col(f"_s_{FACTORS[0]}"))
    equal = 1.0 / len(FACTORS)
    young = F.col("_n") < spec.weighting.min_periods
    method = (
        F.when(young, "equal_until_min_history").when(total <= 0, "equal_no_positive_ic_ir").otherwise("rolling_rank_ic_ir")
    )
    shrink = spec.weighting.shrink
    shrunk = F.array(
        *[
            F.lit(shrink * equal) + (1.0 - shrink) * F.when(total > 0, F.col(f"_s_{f}") / total).otherwise(equal)
            for f in FACTORS
        ]
    )
    bounded = bounded_simplex(shrunk, len(FACTORS), spec.weighting.lower, spec.weighting.upper)
    weights = F.when(young, F.array(*[F.lit(equal) for _ in FACTORS])).otherwise(bounded)
    return per.withColumn("_w", weights).select(
        "month",
        F.lit(spec.name).alias("strategy"),
        method.alias("method"),
        F.lit(spec.weighting.lookback).alias("lookback_months"),
        F.lit(spec.weighting.min_periods).alias("min_periods"),
        F.lit(shrink).alias("shrink_to_equal"),
        F.lit(spec.weighting.lower).alias("min_factor_weight"),
        F.lit(spec.weighting.upper).alias("max_factor_weight"),
        *[F.col("_w")[i].alias(f"weight_{f}") for i, f in enumerate(FACTORS)],
    )


def weight_history(months: DataFrame, specs: list[StrategySpec], ic_by_trend: dict[str, DataFrame]) -> DataFrame:
    """One weight row per (strategy, month), static or rolling by specification."""
    out = None
    for spec in specs:
        part = (
            rolling_ic_weights(months, ic_by_trend[spec.trend], spec)
            if spec.weighting.method == "rolling_rank_ic"
            else static_weights(months, spec)
        )
        out = part if out is None else out.unionByName(part)
    return out


def scores_by_variant(panel: DataFrame, specs: list[StrategySpec], weights: dict[str, DataFrame] | None = None) -> DataFrame:
    """Long (variant, month, ticker, score, ...) with one row per distinct score.

    Specs that differ only in exits, costs or sizing share a variant, so a grid
    of specs scores the panel once. ``weights`` holds month-keyed weight tables
    for the rolling variants; they are broadcast.
    """
    variants = {s.score_variant: s for s in specs}
    df = panel
    pairs = []
    for i, (variant, spec) in enumerate(variants.items()):
        factors = list(spec.weights)
        values = [F.col(spec.factor_column(f)) for f in factors]
        if spec.weighting.method == "rolling_rank_ic":
            w = weights[variant].select("month", *[F.col(f"weight_{f}").alias(f"_w{i}_{f}") for f in factors])
            df = df.join(F.broadcast(w), "month", "left")
            ws = [F.col(f"_w{i}_{f}") for f in factors]
        else:
            ws = [F.lit(float(spec.weights[f])) for f in factors]
        pairs.append(F.struct(F.lit(variant).alias("variant"), weighted_score(values, ws).alias("score")))
    keep = ["month", "ticker", "sector", "next_open", "next_high", "next_low", "next_ret_oc"]
    return df.filter("eligible").select(*keep, F.inline(F.array(*pairs))).filter(F.col("score").isNotNull())


def factor_coverage(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null count per score column beside the row count, long form."""
    counts = panel.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("n_available")) for c in columns])
    return counts.select("n_rows", F.inline(pairs))
