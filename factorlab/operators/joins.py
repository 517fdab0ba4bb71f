"""Point-in-time, enrichment and alignment joins.

Only month- or year-keyed tables are broadcast: the calendar bounds their size.
Ticker-keyed tables grow with the universe and are left to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlab.functions.nulls import finite, ratio


def distinct_pairs(df: DataFrame, keys=("ticker", "month")) -> DataFrame:
    return df.select(*keys).distinct()


def last_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep the last row per key under an explicit order, as one partial/final aggregate."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return packed.select(*keys, "_row.*")


def statement_values(statements: DataFrame, code: str, name: str) -> DataFrame:
    """One value per (ticker, availability date). Rows that share a date are ordered
    by fiscal year, then quarter, with the annual row (quarter 0) last."""
    quarter = F.when(F.col("fiscal_quarter") == 0, 5).otherwise(F.col("fiscal_quarter"))
    return (
        statements.filter(F.col("data_code") == code)
        .groupBy("ticker", F.col("date_available").alias("date"))
        .agg(F.max_by("value", F.col("fiscal_year") * 10 + quarter).alias(name))
    )


def asof_attach(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, value: str) -> DataFrame:
    """Backward as-of join with exact matches: union both sides, carry the last right row.

    One shuffle on the key and one running window; no range join, and every left
    column rides along. A matched row whose value is NULL yields NULL, so the
    value travels inside a struct. Both sides are unique per (key, date), hence
    bounded by the calendar per key.
    """
    lhs = left.withColumns({"_at": F.col(left_on), "_side": F.lit(1)})
    rhs = right.select(
        key, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_hit")
    )
    w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    carried = both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w))
    return carried.filter("_side = 1").select(*left.columns, F.col("_hit.v").alias(value))


def asof_fundamental(monthly: DataFrame, statements: DataFrame, code: str = "roe") -> DataFrame:
    """Latest statement value known at each month; ``monthly`` has one row per (ticker, month).

    A ticker's statements are one row, bounded by the calendar, so only they move: the months keep their ticker layout.
    """
    known = statement_values(statements, code, "_v").groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "_v"))).alias("_known"))
    past = F.filter("_known", lambda s: s["date"] <= F.col("month"))
    joined = monthly.join(known, "ticker", "left")
    return joined.select(*monthly.columns, F.get(past, F.size(past) - 1)["_v"].alias(code))


def panel_assembly(monthly: DataFrame, *tables: DataFrame) -> DataFrame:
    """Left-join monthly feature tables on (ticker, month).

    Every side is derived from a ticker-partitioned window or aggregate; hinting
    the base by ticker lets the joins reuse that layout.
    """
    out = monthly
    for t in tables:
        out = out.join(t, ["ticker", "month"], "left")
    return out


def sector_enrich(panel: DataFrame, constituents: DataFrame) -> DataFrame:
    c = constituents.select(F.col("Symbol").alias("ticker"), "Security", "sector", "sub_industry")
    return panel.join(c, "ticker", "left")


def index_enrich(panel: DataFrame, index_months: DataFrame) -> DataFrame:
    idx = index_months.select("month", F.col("close").alias("index_close"), "sma_10m", "regime_on")
    return panel.join(F.broadcast(idx), "month", "left")


def factor_history_join(index_months: DataFrame, index_ma: DataFrame, how: str = "left") -> DataFrame:
    return index_months.select("month", "next_ret").join(index_ma, "month", how)


def membership_filter(df: DataFrame, members: DataFrame, key: str = "ticker") -> DataFrame:
    return df.join(members.select(key), key, "left_semi")


def missing_tickers(requested: DataFrame, available: DataFrame, key: str = "ticker") -> DataFrame:
    return requested.select(key).distinct().join(available.select(key), key, "left_anti")


def benchmark_returns(index_months: DataFrame) -> DataFrame:
    return index_months.select("month", F.col("ret_1m").alias("benchmark_return"))


def benchmark_align_inner(curves: DataFrame, bench: DataFrame) -> DataFrame:
    return curves.join(F.broadcast(bench), "month").dropna(subset=["portfolio_return", "benchmark_return"])


def _for_each(spine: DataFrame, series: DataFrame, key: str) -> DataFrame:
    """The spine once per key of ``series``; keys are strategies, so their list is bounded by configuration."""
    names = series.select(F.array_sort(F.collect_set(key))).scalar()
    return spine.withColumn(key, F.explode(names))


def benchmark_align_outer(curve: DataFrame, bench: DataFrame, key: str | None = None) -> DataFrame:
    """Full outer alignment of a curve, or of every curve under ``key``, with the benchmark; gaps count as zero."""
    keys = [key] if key else []
    both = curve.select(*keys, "month", "portfolio_return").join(_for_each(bench, curve, key) if key else bench, [*keys, "month"], "full_outer")
    r, b = F.coalesce("portfolio_return", F.lit(0.0)), F.coalesce("benchmark_return", F.lit(0.0))
    return both.select(*keys, "month", r.alias("portfolio_return"), b.alias("benchmark_return"), (r - b).alias("excess"))


def reindex_to_spine(spine: DataFrame, series: DataFrame, value: str, fill: float = 0.0, key: str | None = None) -> DataFrame:
    """Every month of the spine, under every ``key`` of the series where one is given."""
    keys = [key] if key else []
    rows = _for_each(spine, series, key) if key else spine
    # One row per key and calendar month on the right.
    return rows.join(series.select(*keys, "month", value), [*keys, "month"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def multi_series_align(curves: DataFrame, strategies: list[str], value: str = "portfolio_return") -> DataFrame:
    """Months by strategies, keeping only months where every strategy has a value."""
    return curves.groupBy("month").pivot("strategy", strategies).agg(F.avg(value)).dropna("any")


def pairwise_curve_join(curves: DataFrame, a: str, b: str) -> DataFrame:
    def one(name: str, suffix: str) -> DataFrame:
        return curves.filter(F.col("strategy") == name).select(
            "month", F.col("portfolio_return").alias(f"portfolio_return_{suffix}")
        )

    return one(a, "a").join(one(b, "b"), "month")


def common_index(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("month").distinct().join(right.select("month").distinct(), "month")


def regime_exposure(panel: DataFrame, curve: DataFrame) -> DataFrame:
    """One regime row per month beside the curve's positions and return."""
    regime = panel.groupBy("month").agg(
        F.max("index_close").alias("index_close"), F.max("sma_10m").alias("sma_10m"), F.max("regime_on").alias("regime_on")
    )
    out = regime.join(F.broadcast(curve.select("month", "n_positions", "portfolio_return")), "month", "left")
    return out.withColumn("invested", F.coalesce(F.col("n_positions") > 0, F.lit(False)))


def nearest_year_join(months: DataFrame, schedule: DataFrame, keys=("scenario",)) -> DataFrame:
    """Schedule row of the month's year, else of the nearest year (earliest on ties).

    The schedule is a literal table of a few years, folded into one array per
    key; each month picks its row with a higher-order function.
    """
    rest = [c for c in schedule.columns if c not in keys]
    packed = schedule.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("_rows"))
    year = F.year("month")
    nearest = F.array_min(
        F.transform("_rows", lambda r: F.struct(F.abs(r["year"] - year).alias("gap"), r.alias("row")))
    )["row"]
    # packed holds one row per scenario: a literal-sized side.
    joined = months.join(F.broadcast(packed), list(keys)) if set(keys) <= set(months.columns) else None
    if joined is None:
        raise ValueError(f"months must carry the schedule keys {keys}")
    return joined.withColumn("_hit", nearest).select(
        *months.columns, *[F.col(f"_hit.{c}").alias("schedule_year" if c == "year" else c) for c in rest]
    )


def return_from_level(level: DataFrame, column: str = "value", order: str = "date", key: str | None = None) -> DataFrame:
    """Last row per date (and key), percentage change, first row zero."""
    keys = [key] if key else []
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)  # one row per trading day
    daily = last_per_key(level, [*keys, order], [F.col(column)]) if column != order else level
    chg = ratio(F.col(column), F.lag(column).over(w)) - 1
    return daily.withColumn("return", F.coalesce(finite(chg), F.lit(0.0)))
