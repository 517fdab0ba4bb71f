"""Regressions. Spark aggregates rows to second moments; a sweep over their array solves them.

Cross-sectional fits reduce millions of rows to one row of moments per month.
Time-series fits see one row per calendar month of a series; residuals and row
weights give their covariance. Everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlab.functions.nulls import finite, gated_avg, ratio
from factorlab.functions.stats import normal_two_sided_p, student_two_sided_p

#: A regressor whose variance given those before it is a smaller share of its own than this adds nothing and gets 0.
RANK_TOLERANCE = 1e-12

# -------------------------------------------------------------- dense solver


def sweep(matrix: Column, n: int, pivots: Column) -> Column:
    """Sweep a symmetric n x n matrix, an array row by row, on the positions in ``pivots``.

    On centred cross products with unit diagonal this leaves the coefficients beside the swept
    positions, the residual share on the others' diagonal and minus the inverse within. A pivot
    below the rank tolerance has its row and column cleared instead.
    """

    def step(a: Column, p: Column) -> Column:
        d = F.get(a, p * n + p)
        full = d > RANK_TOLERANCE

        def cell(v: Column, at: Column) -> Column:
            i, j = F.floor(at / n).cast("int"), at % n
            left, right = F.get(a, i * n + p), F.get(a, p * n + j)
            swept = F.when((i == p) & (j == p), -1 / d).when((i == p) | (j == p), v / d).otherwise(v - left * right / d)
            return F.when(full, swept).when((i == p) | (j == p), F.lit(0.0)).otherwise(v)

        return F.transform(a, cell)

    return F.aggregate(pivots, matrix, step)


def unit_moments(cross: Column, n: int) -> tuple[Column, Column]:
    """(matrix with unit diagonal, scales) from the upper triangle of centred cross products."""
    place = {}
    for i in range(n):
        for j in range(i, n):
            place[i, j] = place[j, i] = len(set(place.values()))
    # Literal lists and long sums are given as SQL text: one call instead of thousands.
    scales = F.transform(
        F.expr(f"array({', '.join(str(place[i, i]) for i in range(n))})"),
        lambda at: F.when(F.get(cross, at) > 0, F.sqrt(F.get(cross, at))).otherwise(1.0),
    )
    where = F.expr(f"array({', '.join(str(place[i, j]) for i in range(n) for j in range(n))})")

    def unit(s: Column) -> Column:
        return F.transform(where, lambda w, at: F.get(cross, w) / F.get(s, F.floor(at / n).cast("int")) / F.get(s, at % n))

    return F.get(F.transform(F.array(scales), unit), F.lit(0)), scales


# ---------------------------------------------------------------- cross-section


def xs_moments(rows: DataFrame, y: str, xs: list[str], key: str, min_obs: int) -> DataFrame:
    """Means and centred second moments per group, in two partial/final aggregates.

    The regressors are nearly collinear and close to one, so moments are centred
    on exact group means before products are summed.
    """
    cols = [y, *xs]
    full = rows.select(key, *[finite(c).alias(c) for c in cols]).dropna()
    means = (
        full.groupBy(key)
        .agg(F.count("*").alias("n_obs"), *[F.avg(c).alias(f"_m_{c}") for c in cols])
        .filter(F.col("n_obs") >= min_obs)
    )
    # One row per month.
    centred = full.join(F.broadcast(means), key).select(
        key, "n_obs", *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in cols], *[f"_m_{c}" for c in cols]
    )
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    out = centred.groupBy(key).agg(
        F.first("n_obs").alias("n_obs"),
        F.array(*[F.first(f"_m_{c}") for c in cols]).alias("means"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("cross"),
    )
    return out


def xs_multivariate_betas(rows: DataFrame, y: str, xs: list[str], min_obs: int, key: str = "month") -> DataFrame:
    """OLS of y on 1 + xs per month: one coefficient row per month."""
    moments = xs_moments(rows, y, xs, key, min_obs)
    n = len(xs) + 1
    matrix, scales = unit_moments(F.col("cross"), n)
    swept = moments.withColumn("_s", scales).withColumn("_a", matrix)
    swept = swept.withColumn("_a", sweep(F.col("_a"), n, F.array(*[F.lit(i) for i in range(1, n)])))

    def beta(j: int) -> Column:
        return F.get("_a", F.lit(j * n)) * F.get("_s", F.lit(0)) / F.get("_s", F.lit(j))

    out = swept.select(key, "n_obs", "means", (1 - F.get("_a", F.lit(0))).alias("_r2"), F.get("cross", F.lit(0)).alias("_syy"), *[beta(j + 1).alias(c) for j, c in enumerate(xs)])
    intercept = F.get("means", F.lit(0))
    for j, c in enumerate(xs):
        intercept = intercept - F.col(c) * F.get("means", F.lit(j + 1))
    return out.select(key, F.col("n_obs").cast("long").alias("n_obs"), F.when(F.col("_syy") > 0, F.col("_r2")).alias("r_squared"), intercept.alias("intercept"), *xs)


def smooth_betas(betas: DataFrame, xs: list[str], window: int) -> DataFrame:
    """Mean of the previous ``window`` coefficient rows, the current one excluded."""
    w = Window.partitionBy(F.lit(0)).orderBy("month").rowsBetween(-window, -1)  # one row per month
    return betas.select(
        "month",
        *[gated_avg(c, w, window).alias(c) for c in ["intercept", *xs]],
        F.lit(window).alias("smoothed_window"),
        gated_avg(F.col("n_obs").cast("double"), w, window).alias("smoothed_n_obs"),
    )


def linear_prediction(intercept: Column, terms: list[tuple[Column, Column]]) -> Column:
    out = intercept
    for b, x in terms:
        out = out + b * x
    return out


def hzz_predict(ratios: DataFrame, smoothed: DataFrame, xs: list[str], out: str = "trend_hzz_raw") -> DataFrame:
    """intercept + sum beta * ratio; NULL when any input is missing."""
    betas = smoothed.select("month", F.col("intercept").alias("_b0"), *[F.col(c).alias(f"_b_{c}") for c in xs])
    joined = ratios.join(F.broadcast(betas), "month", "left")
    value = linear_prediction(F.col("_b0"), [(F.col(f"_b_{c}"), F.col(c)) for c in xs])
    return joined.select("ticker", "month", finite(value).alias(out))


def with_hzz(monthly: DataFrame, smoothed: DataFrame, windows, out: str = "trend_hzz_raw") -> DataFrame:
    """The same prediction beside the deviations of a monthly table, whose ratios are deviation plus one."""
    xs = [f"ma_ratio_{n}" for n in windows]
    betas = smoothed.select("month", F.struct("intercept", *xs).alias("_b"))
    value = linear_prediction(F.col("_b.intercept"), [(F.col(f"_b.ma_ratio_{n}"), F.col(f"ma_dev_{n}") + 1.0) for n in windows])
    # Month-keyed, hence bounded by the calendar.
    return monthly.join(F.broadcast(betas), "month", "left").select(*monthly.columns, finite(value).alias(out))


# ------------------------------------------------------------------ time series


def _fit(moments: DataFrame, xs: list[str], pivots: Column) -> DataFrame:
    """Every row of moments with the coefficients ``_c`` (intercept first), ``_inv`` and ``_r2`` of the fit on ``pivots``.

    Regressors out of the fit have neither a coefficient nor a weight in anyone else's.
    """
    n = len(xs) + 1
    swept = moments.withColumn("_pivots", pivots).withColumn("_a", sweep(F.col("_unit"), n, F.col("_pivots")))

    def within(at: Column) -> Column:
        return F.array_contains("_pivots", F.floor(at / n).cast("int")) & F.array_contains("_pivots", (at % n).cast("int"))

    slopes = F.transform(
        F.sequence(F.lit(1), F.lit(n - 1)),
        lambda j: F.when(F.array_contains("_pivots", j), F.get("_a", j * n) * F.get("_s", F.lit(0)) / F.get("_s", j)).otherwise(0.0),
    )
    out = swept.withColumn("_b", slopes)
    from_means = F.aggregate(F.zip_with("_b", F.slice("_m", 2, n - 1), lambda b, m: b * m), F.lit(0.0), lambda acc, v: acc + v)
    return out.withColumns(
        {
            "_c": F.concat(F.array(F.get("_m", F.lit(0)) - from_means), F.col("_b")),
            "_inv": F.transform("_a", lambda v, at: F.when(within(at), -v).otherwise(0.0)),
            "_r2": F.when(F.size("_pivots") > 0, 1 - F.get("_a", F.lit(0))).otherwise(0.0),
        }
    ).drop("_a", "_b")


def _with_hac_p(rows: DataFrame, fit: DataFrame, keys: list[str], order: str, y: str, xs: list[str], lags: int) -> DataFrame:
    """The rows of ``fit`` with ``_p``: normal p-values of its coefficients under a Bartlett-weighted covariance.

    A coefficient is a weighted sum of y; its variance is that of the weighted residuals with their lagged products.
    The rows of the fit travel along, so that what follows needs no join back to them.
    """
    n = len(xs) + 1
    carried = [c for c in fit.columns if c not in keys]
    z = F.expr(f"array({', '.join(f'(`{x}` - _m[{j + 1}]) / _s[{j + 1}]' for j, x in enumerate(xs))})")
    fitted = F.expr(f"_c[0] + {' + '.join(f'_c[{j + 1}] * `{x}`' for j, x in enumerate(xs))}")
    joined = rows.join(fit, keys).select(*keys, order, F.struct(*carried).alias("_fit"), "_m", "_s", "_inv", "n_obs", z.alias("_z"), (F.col(y) - fitted).alias("_u"))

    def weight(j: Column) -> Column:
        products = F.zip_with(F.slice("_inv", j * n + 2, n - 1), "_z", lambda a, v: a * v)
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v) / F.get("_s", j)

    joined = joined.withColumn("_w", F.transform(F.sequence(F.lit(1), F.lit(n - 1)), weight))
    first = 1.0 / F.col("n_obs") - F.aggregate(F.zip_with("_w", F.slice("_m", 2, n - 1), lambda w, m: w * m), F.lit(0.0), lambda acc, v: acc + v)
    scores = joined.select(*keys, order, "_fit", F.transform(F.concat(F.array(first), F.col("_w")), lambda w: w * F.col("_u")).alias("_e"))
    w = Window.partitionBy(*keys).orderBy(order)
    lagged = scores.select(*keys, "_fit", "_e", *[F.lag("_e", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])

    def spread(j: int) -> str:
        across = "".join(f" + {2 * (1 - k / (lags + 1))}D * _e[{j}] * coalesce(_l{k}[{j}], 0D)" for k in range(1, lags + 1))
        return f"sum(_e[{j}] * _e[{j}]{across})"

    summed = lagged.groupBy(*keys).agg(F.first("_fit").alias("_fit"), F.expr(f"array({', '.join(map(spread, range(n)))})").alias("_var")).select(*keys, "_fit.*", "_var")
    score = F.zip_with("_c", "_var", lambda c, v: F.try_divide(c, F.sqrt(F.greatest(v, F.lit(0.0)))))
    return summed.withColumn("_p", F.transform(score, normal_two_sided_p)).drop("_var")


def selected_trend_fits(rows: DataFrame, keys: list[str], order: str, y: str, xs: list[str], cfg) -> DataFrame:
    """One row per key: fit on all regressors, keep those with a small p-value, fit again on these.

    (keys, n_obs, r2, b0, slopes, p_full, p_refit, chosen); slopes of regressors left out are 0, ``chosen`` counts
    regressors from 1. Keys with fewer than ``trend_min_obs`` rows have none. The rows are read once for the
    means, the cross products and either fit; each step feeds the next alone.
    """
    n = len(xs) + 1
    cols = [y, *xs]
    average = F.expr(f"array({', '.join(f'avg(`{c}`)' for c in cols)})")
    means = rows.groupBy(*keys).agg(F.count("*").alias("n_obs"), average.alias("_m")).filter(F.col("n_obs") >= cfg.trend_min_obs)
    centred = rows.join(means, keys)
    products = [f"sum((`{a}` - _m[{i}]) * (`{b}` - _m[{j}]))" for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    moments = centred.groupBy(*keys).agg(F.first("n_obs").alias("n_obs"), F.first("_m").alias("_m"), F.expr(f"array({', '.join(products)})").alias("cross"))
    matrix, scales = unit_moments(F.col("cross"), n)
    moments = moments.select(*keys, "n_obs", "_m", scales.alias("_s"), matrix.alias("_unit"))
    full = _fit(moments, xs, F.sequence(F.lit(1), F.lit(n - 1)))
    judged = _with_hac_p(rows, full, keys, order, y, xs, cfg.hac_lags).withColumnRenamed("_p", "p_full")
    small = F.filter(F.sequence(F.lit(1), F.lit(n - 1)), lambda j: F.coalesce(F.get("p_full", j) <= cfg.trend_alpha, F.lit(False)))
    again = judged.select(*keys, "n_obs", "_m", "_s", "_unit", "p_full", small.alias("chosen"))
    refit = _with_hac_p(rows, _fit(again, xs, F.col("chosen")), keys, order, y, xs, cfg.hac_lags)
    return refit.select(
        *keys, "n_obs", F.col("_r2").alias("r2"), F.get("_c", F.lit(0)).alias("b0"), F.slice("_c", 2, n - 1).alias("slopes"),
        "p_full", F.col("_p").alias("p_refit"), "chosen",
    )


def _whole(history: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    return history.select(*keep, *[finite(F.col(c).cast("double")).alias(c) for c in columns]).dropna(subset=columns)


def _names(xs: list[str]) -> Column:
    return F.transform("chosen", lambda j: F.get(F.array(*[F.lit(x) for x in xs]), j - 1))


def index_trend_full(history: DataFrame, xs: list[str], cfg, series: str = "series_id") -> DataFrame:
    """Full-sample predictive regression per series, keeping significant regressors.

    One long row per term. A series shorter than ``trend_min_obs`` yields no rows.
    """
    rows = _whole(history, ["next_ret", *xs], [series, "month"])
    fits = selected_trend_fits(rows, [series], "month", "next_ret", xs, cfg)
    used = [F.array_contains("chosen", j + 1) for j in range(len(xs))]

    def term(name: str, value: Column, j: int, chosen: Column) -> Column:
        return F.struct(
            F.lit(name).alias("term"), value.alias("coefficient"), F.get("p_full", F.lit(j)).alias("full_model_p_value"),
            F.when(chosen, F.get("p_refit", F.lit(j))).alias("refit_p_value"), chosen.alias("selected"),
        )

    terms = F.array(
        term("const", F.col("b0"), 0, F.lit(True)), *[term(x, F.get("slopes", F.lit(j)), j + 1, used[j]) for j, x in enumerate(xs)]
    )
    tail = [F.col("n_obs").cast("long").alias("n_obs"), F.col("r2").alias("r_squared_refit"), _names(xs).alias("selected_variables")]
    return fits.select(series, F.inline(terms), *tail)


def expanding_trend_betas(history: DataFrame, xs: list[str], cfg, series: str = "series_id", months: list | None = None) -> DataFrame:
    """The same regression for every signal month, or the given ones, on the rows strictly before it.

    Signal months are keys of one job, so no series is fitted in one task.
    """
    signal = history.select(series, F.col("month").alias("_at")).distinct()
    if months is not None:
        signal = signal.filter(F.col("_at").isin(months))
    rows = _whole(history, ["next_ret", *xs], [series, "month"])
    past = signal.join(rows, series).filter(F.col("month") < F.col("_at"))
    fits = selected_trend_fits(past, [series, "_at"], "month", "next_ret", xs, cfg)
    return fits.select(
        series, F.col("_at").alias("month"), F.col("n_obs").cast("long").alias("n_obs"), F.col("r2").alias("r_squared_refit"),
        _names(xs).alias("selected_variables"), F.col("b0").alias("intercept"), *[F.get("slopes", F.lit(j)).alias(x) for j, x in enumerate(xs)],
    )


def coefficients_wide(terms: DataFrame, xs: list[str]) -> DataFrame:
    """Long coefficient table to a single row (intercept, xs...).

    A term that the fit left out counts 0; without a fitted constant there is no
    trend, and all coefficients are NULL.
    """

    def pick(t: str) -> Column:
        return F.max(F.when(F.col("term") == t, F.col("coefficient")))

    fitted = pick("const").isNotNull()
    return terms.agg(
        pick("const").alias("intercept"), *[F.when(fitted, F.coalesce(pick(c), F.lit(0.0))).alias(c) for c in xs]
    )


def with_trends(signals: DataFrame, coefs: dict[str, DataFrame], xs: list[str]) -> DataFrame:
    """Add intercept + sum b * deviation for several coefficient tables in one pass.

    ``coefs`` maps an output column to a table of one row, which becomes a scalar
    subquery, or of one row per month, which is broadcast.
    """
    out = signals
    values = {}
    for i, (name, table) in enumerate(coefs.items()):
        if "month" in table.columns:
            packed = table.select("month", F.struct("intercept", *xs).alias(f"_b{i}"))
            out = out.join(F.broadcast(packed), "month", "left")
            intercept, betas = F.col(f"_b{i}.intercept"), {c: F.col(f"_b{i}.{c}") for c in xs}
        else:
            out = out.withColumn(f"_b{i}", table.select(F.struct("intercept", *xs)).scalar())
            intercept, betas = F.col(f"_b{i}.intercept"), {c: F.col(f"_b{i}.{c}") for c in xs}
        values[name] = finite(linear_prediction(intercept, [(betas[c], F.col(c)) for c in xs]))
    return out.select(*signals.columns, *[v.alias(n) for n, v in values.items()])


def apply_trend(signals: DataFrame, coefs: DataFrame, xs: list[str], out: str) -> DataFrame:
    return with_trends(signals, {out: coefs}, xs).select("ticker", "month", out)


def selected_variables(terms: DataFrame) -> DataFrame:
    """Lag number of every moving-average term with its selection flag."""
    lag = F.regexp_extract("term", r"^ma_dev_(\d+)$", 1)
    return terms.filter(F.col("term").startswith("ma_dev_")).select(
        lag.cast("int").alias("lag"), "coefficient", "selected"
    )


def benchmark_alpha_beta(aligned: DataFrame, lags: int = 3, min_months: int = 24, key: str = "strategy") -> DataFrame:
    """Per strategy: r = alpha + beta b with a Bartlett-weighted (HAC) covariance.

    Pure window and aggregate SQL: the score vectors are (u, u b), their lagged
    products come from ``lag`` over one row per month.
    """
    stats = aligned.groupBy(key).agg(
        F.count("*").alias("n_months"),
        F.avg("portfolio_return").alias("avg_strategy_return"),
        F.avg("benchmark_return").alias("avg_benchmark_return"),
        F.avg(F.col("portfolio_return") - F.col("benchmark_return")).alias("avg_excess_return"),
        F.stddev_samp(F.col("portfolio_return") - F.col("benchmark_return")).alias("_sd_excess"),
        F.regr_slope("portfolio_return", "benchmark_return").alias("beta"),
        F.regr_intercept("portfolio_return", "benchmark_return").alias("monthly_alpha"),
        F.regr_r2("portfolio_return", "benchmark_return").alias("r_squared"),
        F.sum("benchmark_return").alias("_sb"),
        F.sum(F.col("benchmark_return") * F.col("benchmark_return")).alias("_sbb"),
    ).filter(F.col("n_months") >= min_months)
    u = F.col("portfolio_return") - F.col("monthly_alpha") - F.col("beta") * F.col("benchmark_return")
    w = Window.partitionBy(key).orderBy("month")
    rows = aligned.join(stats, key).withColumn("_u", u).withColumn("_ub", u * F.col("benchmark_return"))
    meat = {"_s00": F.col("_u") * F.col("_u"), "_s01": F.col("_u") * F.col("_ub"), "_s11": F.col("_ub") * F.col("_ub")}
    for lag in range(1, lags + 1):
        k = 1 - lag / (lags + 1)
        lu, lub = F.lag("_u", lag, 0.0).over(w), F.lag("_ub", lag, 0.0).over(w)
        meat["_s00"] = meat["_s00"] + 2 * k * F.col("_u") * lu
        meat["_s01"] = meat["_s01"] + k * (F.col("_u") * lub + F.col("_ub") * lu)
        meat["_s11"] = meat["_s11"] + 2 * k * F.col("_ub") * lub
    summed = rows.withColumns(meat).groupBy(key).agg(*[F.sum(c).alias(c) for c in meat])
    out = stats.join(summed, key)
    # First row of (X'X)^-1 is (sbb, -sb) / det.
    det = F.col("n_months") * F.col("_sbb") - F.col("_sb") * F.col("_sb")
    a, b = ratio(F.col("_sbb"), det), ratio(-F.col("_sb"), det)
    var = a * a * F.col("_s00") + 2 * a * b * F.col("_s01") + b * b * F.col("_s11")
    t = ratio(F.col("monthly_alpha"), F.sqrt(F.greatest(var, F.lit(0.0))))
    excess_t = ratio(F.col("avg_excess_return"), F.col("_sd_excess") / F.sqrt("n_months"))
    return out.select(
        key,
        "n_months",
        "avg_strategy_return",
        "avg_benchmark_return",
        "avg_excess_return",
        (F.col("avg_excess_return") * 12).alias("annualized_excess_return_approx"),
        excess_t.alias("excess_t_stat"),
        student_two_sided_p(excess_t, F.col("n_months") - 1).alias("excess_p_value"),
        "beta",
        "monthly_alpha",
        (F.col("monthly_alpha") * 12).alias("annualized_alpha_approx"),
        t.alias("alpha_t_stat"),
        normal_two_sided_p(t).alias("alpha_p_value"),
        "r_squared",
    )


def return_correlation(curves: DataFrame, key: str = "strategy") -> DataFrame:
    """Pairwise Pearson correlation of strategy returns over shared months.

    Strategies are rows of a literal spec table, so pairs are few; the join is
    an equi-join on month.
    """
    r = curves.groupBy("month", key).agg(F.avg("portfolio_return").alias("r"))
    a = r.select("month", F.col(key).alias("strategy_a"), F.col("r").alias("_a"))
    b = r.select("month", F.col(key).alias("strategy_b"), F.col("r").alias("_b"))
    return a.join(b, "month").groupBy("strategy_a", "strategy_b").agg(F.corr("_a", "_b").alias("correlation"))
