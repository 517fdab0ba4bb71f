"""Resampling tests. Every draw is a hash of its own identity (seed, simulation,
period, position), so a simulation is a set of rows that any task can produce.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlab.config import EngineConfig, StrategySpec
from factorlab.functions.nulls import ratio
from factorlab.functions.stats import hash_int
from factorlab.operators import perf, ranks
from factorlab.operators.portfolio import fold_equity, stop_take_return
from factorlab.sources.workspace import Workspace


#: Modulus of the rounds of a keyed permutation: cubes of smaller numbers stay within 64 bits step by step.
_PRIME = 2**31 - 1
_ROUNDS = 4


def random_subset(n_draws: Column, universe: Column, *identity: Column | int) -> Column:
    """Ordered draws without replacement from 1..universe as an array.

    A keyed permutation: positions 0, 1, 2, ... go through Feistel rounds on a rectangle
    of at least ``universe`` cells, and those that land outside are passed over. Each draw
    costs the same, however many were made before it.
    """
    wanted = F.greatest(F.least(n_draws, universe), F.lit(0)).cast("int")

    def move(side: str, other: str, size: Column, key: Column):
        def one(x: Column) -> Column:
            y = (x[other] + key) % _PRIME
            return x.withField(side, (x[side] + (y * y % _PRIME) * y % _PRIME) % size)

        return one

    def walk(named: Column, last: Column) -> Column:
        rows, columns = named[_ROUNDS], named[_ROUNDS + 1]
        at = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda c: F.struct(F.floor(c / columns).alias("l"), (c % columns).alias("r")))
        for i in range(0, _ROUNDS, 2):
            at = F.transform(at, move("l", "r", rows, named[i]))
            at = F.transform(at, move("r", "l", columns, named[i + 1]))
        cells = F.transform(at, lambda x: x["l"] * columns + x["r"])
        return F.slice(F.transform(F.filter(cells, lambda c: c < universe), lambda c: c + 1), 1, wanted)

    def drawn(named: Column) -> Column:
        # The rectangle has fewer than sqrt(universe) + 1 cells too many, so a few positions more nearly always do.
        whole = named[_ROUNDS] * named[_ROUNDS + 1] - 1
        some = F.least(whole, (wanted + wanted / 2).cast("long") + 8)
        near = F.array(walk(named, some))
        return F.get(F.transform(near, lambda v: F.when(F.size(v) >= wanted, v).otherwise(walk(named, whole))), F.lit(0))

    rows = F.greatest(F.ceil(F.sqrt(universe)), F.lit(1)).cast("long")
    columns = F.greatest(F.ceil(universe / rows), F.lit(1)).cast("long")
    # The keys of the rounds and the rectangle, worked out once per subset.
    named = F.array(*[hash_int(*identity, i) % _PRIME for i in range(_ROUNDS)], rows, columns)
    draws = F.get(F.transform(F.array(named), drawn), F.lit(0))
    return F.when(wanted > 0, draws).otherwise(F.array().cast("array<bigint>"))


def indexed_universe(panel: DataFrame, ws: Workspace) -> DataFrame:
    """Eligible names of each month numbered 1..N in ticker order."""
    rows = panel.filter(F.col("eligible") & F.col("next_ret_oc").isNotNull()).select(
        "month", "ticker", "next_open", "next_high", "next_low", "next_ret_oc"
    )
    return ranks.rank_first(rows, ["month"], ["ticker"], "idx", ws)


def monte_carlo(
    universe: DataFrame, months: DataFrame, specs: list[StrategySpec], cfg: EngineConfig, n_sims: int
) -> DataFrame:
    """Random-portfolio curves of every strategy: (strategy, sim, month, portfolio_return, ...).

    The universe is counted once per month; simulations draw index numbers and
    fetch only those rows, so work is sims x months x top_n rather than
    sims x universe. Strategies share the draws: one that holds fewer names takes
    the first of them, and each applies its own gate, exits and sizing.
    """
    sizes = universe.groupBy("month").agg(F.count("*").alias("_n"))
    spine = months.select("month", F.coalesce("regime_on", F.lit(True)).alias("_on")).join(F.broadcast(sizes), "month", "left")
    # Spread simulations over the cluster before any draw is made.
    every = F.sequence(F.lit(0), F.lit(n_sims - 1))
    grid = spine.select("month", "_on", F.coalesce("_n", F.lit(0)).alias("_n"), F.explode(every).alias("sim")).repartition("sim")
    want = F.least(F.lit(max(s.top_n for s in specs)), F.col("_n"))
    draws = grid.select(
        "sim",
        "month",
        F.posexplode_outer(random_subset(want, F.col("_n"), cfg.seed, F.col("sim"), F.col("month"))).alias("rank", "idx"),
    )
    bar = ["next_open", "next_high", "next_low", "next_ret_oc"]
    drawn = draws.join(universe.select("month", "idx", *bar), ["month", "idx"], "left")
    # At most the largest top_n rows a group; strategies meet the drawn bars once they are together.
    together = drawn.groupBy("sim", "month").agg(
        F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("rank", *bar)))).alias("_bars")
    )
    together = together.join(F.broadcast(spine.select("month", "_on")), "month")
    # One literal per strategy, so bounded by configuration.
    each = F.array(*[
        F.struct(
            F.lit(s.name).alias("strategy"), F.lit(s.top_n).alias("top_n"), F.lit(s.gated).alias("_gated"),
            F.lit(s.exits.stop).cast("double").alias("_stop"), F.lit(s.exits.take).cast("double").alias("_take"),
            F.lit(s.sizing.method).alias("sizing_method"), F.lit(s.sizing.share).alias("sizing_target_pct"),
        )
        for s in specs
    ])
    rows = together.select("*", F.inline(each))
    realised = F.transform(F.slice("_bars", 1, F.col("top_n")), lambda b: stop_take_return(F.col("_stop"), F.col("_take"), lambda c: b[c]))
    returns = F.when(F.col("_on") | ~F.col("_gated"), realised).otherwise(F.array().cast("array<double>"))
    monthly = rows.select("strategy", "sim", "month", "top_n", "sizing_method", "sizing_target_pct", returns.alias("returns"))
    return fold_equity(monthly, ["strategy", "sim"], cfg)


def monte_carlo_metrics(sim_curves: DataFrame, cfg: EngineConfig) -> DataFrame:
    m = perf.eval_metrics(sim_curves, ["strategy", "sim"], cfg.evaluation_start, cfg.initial_cash, p_value=False)
    return m.select("strategy", "sim", "annualized_sharpe", "final_equity")


def monte_carlo_test(sim_metrics: DataFrame, strategy_metrics: DataFrame) -> DataFrame:
    """Attach the strategy's Sharpe and the share of simulations that reach it."""
    s = strategy_metrics.select("strategy", F.col("annualized_sharpe").alias("strategy_sharpe"))
    joined = sim_metrics.join(F.broadcast(s), "strategy")  # one row per strategy
    hit = F.coalesce(F.col("annualized_sharpe") >= F.col("strategy_sharpe"), F.lit(False))
    p = joined.groupBy("strategy").agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("p_value"))
    return joined.join(F.broadcast(p), "strategy")


def mc_summary(tested: DataFrame) -> DataFrame:
    return tested.groupBy("strategy").agg(
        F.max("strategy_sharpe").alias("strategy_sharpe"),
        F.max("p_value").alias("p_value"),
        F.count("*").alias("n_sims"),
        F.max("annualized_sharpe").alias("random_max_sharpe"),
        F.percentile("annualized_sharpe", F.lit(0.5)).alias("random_median_sharpe"),
        F.min("annualized_sharpe").alias("random_min_sharpe"),
    )


# ------------------------------------------------------------- block bootstrap


def indexed_series(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows numbered 0..n-1 by month per key, with n. One row per calendar month."""
    w = Window.partitionBy(*keys)
    rows = series.filter(F.col(value).isNotNull())
    return rows.select(
        *keys,
        (F.row_number().over(w.orderBy("month")) - 1).alias("i"),
        F.count("*").over(w).alias("n"),
        F.col(value).alias("r"),
    )


def block_draws(sizes: DataFrame, keys: list[str], n_sims: int, block: int, seed: int) -> DataFrame:
    """(keys, sim, pos, i): source index of every position of every resample.

    Overlapping blocks with uniform starts in 0..n-block, truncated to length n.
    """
    sims = sizes.filter(F.col("n") >= block).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))))
    blocks = sims.withColumn("blk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    first = hash_int(seed, *[F.col(k) for k in keys], F.col("sim"), F.col("blk")) % (F.col("n") - block + 1)
    rows = blocks.withColumn("_first", first).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    return rows.select(
        *keys, "sim", (F.col("blk") * block + F.col("_o")).alias("pos"), (F.col("_first") + F.col("_o")).alias("i"), "n"
    ).filter(F.col("pos") < F.col("n"))


#: Rows that the resamples of one series are dealt to.
_DEALT = 64


def _joined(a: Column, b: Column) -> Column:
    """Summary of a path followed by another: an associative product, with nulls where nothing has happened yet."""
    return F.struct(
        (a["total"] + b["total"]).alias("total"),
        (a["squares"] + b["squares"]).alias("squares"),
        (a["growth"] * b["growth"]).alias("growth"),
        F.greatest(a["high"], a["growth"] * b["high"]).alias("high"),
        F.least(a["low"], a["growth"] * b["low"]).alias("low"),
        F.least(a["fall"], b["fall"], a["growth"] * b["low"] / a["high"] - 1).alias("fall"),
    )


def _nothing() -> Column:
    none = F.lit(None).cast("double")
    return F.struct(
        F.lit(0.0).alias("total"), F.lit(0.0).alias("squares"), F.lit(1.0).alias("growth"), none.alias("high"), none.alias("low"), none.alias("fall")
    )


def resampled_paths(series: DataFrame, keys: list[str], n_sims: int, block: int, seed: int) -> DataFrame:
    """(keys, sim, n, mean, squares, growth, fall) of every block resample of an indexed series.

    ``squares`` is the sum of squared deviations from the resample's mean, ``growth`` the product of
    1 + r and ``fall`` the deepest drawdown. Each possible block is summed up once; a resample joins
    the summaries of its blocks in order, so it costs blocks, not months. Needs returns above -1.
    """
    arrays = series.groupBy(*keys, "n").agg(
        F.avg("r").alias("_mid"), F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("_r")
    )
    arrays = arrays.filter(F.col("n") >= block)

    def one(v: Column) -> Column:
        d, g = v - F.col("_mid"), 1 + v
        return F.struct(d.alias("total"), (d * d).alias("squares"), g.alias("growth"), g.alias("high"), g.alias("low"), F.lit(0.0).alias("fall"))

    def summaries(length: Column) -> Column:
        starts = F.sequence(F.lit(1), (F.col("n") - block + 1).cast("int"))
        return F.transform(starts, lambda i: F.aggregate(F.slice("_r", i, length), _nothing(), lambda a, v: _joined(a, one(v))))

    blocks = F.ceil(F.col("n") / block).cast("int")
    # The last block is cut so that a resample is as long as the series.
    ready = arrays.select(
        *keys, "n", "_mid", blocks.alias("_blocks"), summaries(F.lit(block)).alias("_full"),
        summaries((F.col("n") - (blocks - 1) * block).cast("int")).alias("_cut"),
    )
    dealt = ready.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1)))).repartition(*keys, "_deal")
    sims = F.filter(F.sequence(F.lit(0), F.lit(n_sims - 1)), lambda s: s % _DEALT == F.col("_deal"))

    def resample(sim: Column) -> Column:
        def drawn(blk: Column) -> Column:
            first = (hash_int(seed, *[F.col(k) for k in keys], sim, blk) % (F.col("n") - block + 1)).cast("int")
            return F.get(F.when(blk == F.col("_blocks") - 1, F.col("_cut")).otherwise(F.col("_full")), first)

        # Drawn before they are joined, so that a draw is made once.
        picked = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), drawn)
        return F.struct(sim.alias("sim"), F.aggregate(picked, _nothing(), _joined).alias("p"))

    out = dealt.select(*keys, "n", "_mid", F.explode(F.transform(sims, resample)).alias("_s"))
    p = F.col("_s.p")
    return out.select(
        *keys, F.col("_s.sim").alias("sim"), "n", (F.col("_mid") + p["total"] / F.col("n")).alias("mean"),
        F.greatest(p["squares"] - p["total"] * p["total"] / F.col("n"), F.lit(0.0)).alias("squares"),
        p["growth"].alias("growth"), p["fall"].alias("fall"),
    )


def block_bootstrap(series: DataFrame, keys: list[str], n_sims: int, block: int, seed: int, value: str = "portfolio_return") -> DataFrame:
    """Sharpe, cumulative return and drawdown of every block resample.

    A series that loses everything in some month has no growth to join; its resamples are laid out month by month.
    """
    rows = indexed_series(series, keys, value)
    ruined = rows.groupBy(*keys).agg(F.min("r").alias("_least")).filter(F.col("_least") <= -1).select(*keys)
    paths = resampled_paths(rows.join(ruined, keys, "left_anti"), keys, n_sims, block, seed)
    ratio_ = ratio(F.col("mean"), F.sqrt(F.col("squares") / (F.col("n") - 1))) * 12**0.5
    quick = paths.select(*keys, "sim", ratio_.alias("annualized_sharpe"), (F.col("growth") - 1).alias("cumulative_return"), F.col("fall").alias("max_drawdown"))
    bad = rows.join(ruined, keys, "left_semi")
    draws = block_draws(bad.select(*keys, "n").distinct(), keys, n_sims, block, seed).drop("n")
    m = perf.perf_metrics(draws.join(bad.drop("n"), [*keys, "i"]), [*keys, "sim"], "r", "pos", p_value=False)
    return quick.unionByName(m.select(*keys, "sim", "annualized_sharpe", "cumulative_return", "max_drawdown"))


def bootstrap_ci(boot: DataFrame, keys: list[str], value: str = "annualized_sharpe", level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    return boot.groupBy(*keys).agg(q.alias("_q")).select(*keys, F.col("_q")[0].alias("ci_lo"), F.col("_q")[1].alias("ci_hi"))


def excess_bootstrap_ci(excess: DataFrame, keys: list[str], n_sims: int, block: int, seed: int, min_rows: int = 12) -> DataFrame:
    """Annualised mean excess return with a block-bootstrap 95 % interval."""
    rows = indexed_series(excess, keys, "excess").filter(F.col("n") >= min_rows)
    boot = resampled_paths(rows, keys, n_sims, block, seed).select(*keys, (F.col("mean") * 12).alias("m"))
    point = rows.groupBy(*keys).agg((F.avg("r") * 12).alias("ann_excess"))
    return point.join(bootstrap_ci(boot, keys, "m"), keys)


# ------------------------------------------- multiple comparison (SPA, StepM)


def excess_matrix(curves: DataFrame, bench: DataFrame) -> DataFrame:
    """(strategy, month, excess) over months where every strategy has a return."""
    rows = curves.join(F.broadcast(bench), "month", "left").select(
        "strategy", "month", (F.col("portfolio_return") - F.coalesce("benchmark_return", F.lit(0.0))).alias("excess")
    )
    # Rows are (strategy, calendar month); a month is complete when no strategy lacks it.
    total = rows.select("strategy").distinct().agg(F.count("*").alias("_k"))
    complete = rows.filter(F.col("excess").isNotNull()).groupBy("month").agg(F.count("*").alias("_c"))
    keep = complete.join(F.broadcast(total), F.col("_c") == F.col("_k"), "left_semi")
    return rows.join(F.broadcast(keep.select("month")), "month", "left_semi")


def stationary_blocks(length: DataFrame, reps: int, block: int, seed: int) -> DataFrame:
    """(rep, n, blocks): one row per resample with its circular blocks (t, size, start) in order.

    ``length`` is a one-row table (n). A new block starts where the hashed uniform falls below
    1/block, so sizes are geometric with mean ``block``.
    """
    every = length.select("n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).repartition("rep")

    def restart(t: Column) -> Column:
        return (t == 0) | (hash_int(seed, "restart", F.col("rep"), t) / float(2**48) < 1.0 / block)

    cuts = every.withColumn("_cuts", F.filter(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), restart))

    def piece(t: Column, k: Column) -> Column:
        size = F.coalesce(F.get("_cuts", k + 1), F.col("n").cast("int")) - t
        start = (hash_int(seed, "start", F.col("rep"), t) % F.col("n")).cast("int")
        return F.struct(t.alias("t"), size.alias("size"), start.alias("start"))

    return cuts.select("rep", "n", F.transform("_cuts", piece).alias("blocks"))


def stationary_bootstrap_indices(length: DataFrame, reps: int, block: int, seed: int) -> DataFrame:
    """(rep, t, idx): the source month of every month of every resample."""
    pieces = stationary_blocks(length, reps, block, seed).select("rep", "n", F.inline("blocks"))
    months = pieces.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    return months.select("rep", (F.col("t") + F.col("_o")).alias("t"), ((F.col("start") + F.col("_o")) % F.col("n")).cast("int").alias("idx"))


def stationary_variance(excess: DataFrame, block: int) -> DataFrame:
    """Mean and standard error of the mean per strategy under the stationary bootstrap.

    The resampling variance has a closed form (Politis and Romano 1994): all
    autocovariances weighted by how often a block keeps both months. A strategy
    is one array of at most one value per calendar month.
    """
    keep = 1.0 - 1.0 / block
    rows = excess.groupBy("strategy").agg(
        F.avg("excess").alias("mean"),
        F.count("*").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("month", "excess"))), lambda s: s["excess"]).alias("_x"),
    )
    d = F.transform("_x", lambda v: v - F.col("mean"))
    n = F.col("n").cast("double")

    def autocov(lag: Column) -> Column:
        size = F.size("_d") - lag
        products = F.zip_with(F.slice("_d", 1, size), F.slice("_d", lag + 1, size), lambda a, b: a * b)
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    def weighted(acc: Column, lag: Column) -> Column:
        kappa = (1 - lag / n) * F.pow(F.lit(keep), lag) + lag / n * F.pow(F.lit(keep), n - lag)
        return acc + 2 * kappa * autocov(lag)

    lags = F.sequence(F.lit(1), F.col("n").cast("int") - 1)
    variance = F.aggregate(lags, autocov(F.lit(0)), weighted) / n
    return rows.withColumn("_d", d).select("strategy", "mean", "n", F.sqrt(variance / n).alias("se"))


def bootstrap_means(excess: DataFrame, reps: int, block: int, seed: int) -> DataFrame:
    """Resampled mean per (rep, strategy).

    The sum over a block is a difference of running sums, so a resample costs its blocks and is one row
    until the means are ready. The running sums are one array per strategy, as long as the calendar.
    """
    upto = Window.partitionBy("strategy").orderBy("month")
    running = excess.withColumn("_c", F.sum("excess").over(upto)).groupBy("strategy").agg(
        F.concat(F.array(F.lit(0.0)), F.transform(F.array_sort(F.collect_list(F.struct("month", "_c"))), lambda x: x["_c"])).alias("c")
    )
    matrix = running.agg(F.array_sort(F.collect_list(F.struct("strategy", "c")))).scalar()
    length = excess.agg(F.count_distinct("month").alias("n"))
    blocks = stationary_blocks(length, reps, block, seed).withColumn("_m", matrix)
    n = F.col("n").cast("int")

    def mean(m: Column) -> Column:
        def add(total: Column, b: Column) -> Column:
            end = b["start"] + b["size"]
            upper = F.when(end <= n, F.get(m["c"], end)).otherwise(F.get(m["c"], n) + F.get(m["c"], end - n))
            return total + upper - F.get(m["c"], b["start"])

        return F.struct(m["strategy"].alias("strategy"), (F.aggregate("blocks", F.lit(0.0), add) / n).alias("boot_mean"))

    return blocks.select("rep", F.inline(F.transform("_m", mean)))


# Centre of the null distribution, by how strictly poor models are excluded.
RECENTRE = ("lower", "consistent", "upper")


def studentised(excess: DataFrame, reps: int, block: int, seed: int) -> DataFrame:
    """Per (rep, strategy): the sample statistic and the recentred resampled statistics."""
    stats = stationary_variance(excess, block).withColumn("t_stat", ratio("mean", "se"))
    boot = bootstrap_means(excess, reps, block, seed)
    # One row per strategy.
    rows = boot.join(F.broadcast(stats), "strategy")
    bound = -F.sqrt(2 * F.log(F.log(F.col("n"))))
    centre = {
        "lower": F.greatest(F.col("mean"), F.lit(0.0)),
        "consistent": F.when(F.col("t_stat") >= bound, F.col("mean")).otherwise(F.lit(0.0)),
        "upper": F.col("mean"),
    }
    return rows.withColumns({f"z_{k}": ratio(F.col("boot_mean") - c, F.col("se")) for k, c in centre.items()})


def hansen_spa(excess: DataFrame, reps: int, block: int, seed: int) -> DataFrame:
    """Superior predictive ability: p-values under three recentrings of the null.

    The p-value is the share of resamples whose best model exceeds the best
    observed statistic.
    """
    per_rep = (
        studentised(excess, reps, block, seed)
        .groupBy("rep")
        .agg(
            F.max("t_stat").alias("stat"),
            F.max("n").alias("n_periods"),
            F.count("*").alias("n_models"),
            *[F.max(f"z_{k}").alias(f"z_{k}") for k in RECENTRE],
        )
    )
    return per_rep.agg(
        F.max("n_models").alias("n_models"),
        F.max("n_periods").alias("n_periods"),
        F.count("*").alias("bootstrap_reps"),
        *[F.avg(F.when(F.col(f"z_{k}") > F.col("stat"), 1.0).otherwise(0.0)).alias(f"p_value_{k}") for k in RECENTRE],
    )


def romano_wolf_stepm(
    excess: DataFrame, reps: int, block: int, seed: int, size: float = 0.05, recentre: str = "consistent"
) -> DataFrame:
    """Step-down set of superior strategies.

    With models sorted by statistic, the set still in play at any step is a
    suffix of that order, so its critical value is a quantile of the running
    maximum from the weakest model up, and a model is superior when it and every
    stronger one exceed theirs: one window pass replaces the iteration.
    """
    rows = studentised(excess, reps, block, seed)
    weakest_up = Window.partitionBy("rep").orderBy("t_stat", F.desc("strategy"))
    running = F.max(f"z_{recentre}").over(weakest_up.rowsBetween(Window.unboundedPreceding, 0))
    crit = (
        rows.withColumn("_max", running)
        .groupBy("strategy")
        .agg(
            F.max("t_stat").alias("t_stat"),
            F.max("mean").alias("mean_excess"),
            F.percentile("_max", F.lit(1 - size)).alias("critical_value"),
        )
    )
    # One row per strategy.
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("t_stat"), "strategy").rowsBetween(Window.unboundedPreceding, 0)
    beats = F.coalesce(F.col("t_stat") > F.col("critical_value"), F.lit(False))
    return crit.withColumn("superior", F.min(beats).over(down))
