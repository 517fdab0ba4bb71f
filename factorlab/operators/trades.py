"""Daily outcomes of monthly signals: exits, trades, positions and account value.

An entry is decided at the close of a ticker's first bar of the holding month and
made at its next open. Protective levels come from the entry price and are live
from the following bar; a gap through a level is met at the open. A name that
leaves the target is sold one bar later, or two if it is protected. After a
protective exit the name may be bought again in the next month it is wanted.

Exits are first passages. A ticker's months carry a sparse table of range extremes
(lowest low and highest high over 1, 2, 4, ... months), so the first month that
meets a level is found by halving steps and only that month's days are looked at.
The table is built once per ticker and serves every strategy. A scalar fold over a
name's possible entries then keeps those that begin when nothing is held. What is
still held at the last bar has no exit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlab.config import EngineConfig


def holding_spells(signals: DataFrame) -> DataFrame:
    """Consecutive panel months a name stays in the target (gaps and islands)."""
    months = signals.select("month").distinct()
    numbered = months.withColumn("_m", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("month")))
    w = Window.partitionBy("strategy", "ticker").orderBy("_m")
    islands = signals.join(F.broadcast(numbered), "month").withColumn("_g", F.col("_m") - F.row_number().over(w))
    return islands.groupBy("strategy", "ticker", "_g").agg(
        F.min("month").alias("start_month"), F.max("month").alias("end_month"), F.count("*").alias("n_months")
    ).drop("_g")


def range_extremes(low: Column, high: Column) -> Column:
    """Sparse table over two parallel arrays: array<struct(step, lo, hi)>, widest step first.

    ``lo[i]`` is the least of ``low`` over i .. i + step - 1, ``hi[i]`` the greatest of ``high``.
    """
    first = F.struct(F.lit(1).alias("step"), low.alias("lo"), high.alias("hi"))

    def double(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)

        def ahead(c: str) -> Column:
            return F.slice(last[c], last["step"] + 1, F.greatest(F.size(last[c]), F.lit(1)))

        wider = F.struct(
            (last["step"] * 2).alias("step"),
            F.zip_with(last["lo"], ahead("lo"), lambda x, y: F.least(x, y)).alias("lo"),
            F.zip_with(last["hi"], ahead("hi"), lambda x, y: F.greatest(x, y)).alias("hi"),
        )
        return F.concat(levels, F.array(wider))

    rounds = F.ceil(F.log2(F.greatest(F.size(low), F.lit(2)))).cast("int")
    return F.reverse(F.aggregate(F.sequence(F.lit(1), rounds), F.array(first), double))


def first_passage(levels: Column, start: Column, low_level: Column, high_level: Column) -> Column:
    """First index from ``start`` at which a level is met; the array's size or more if there is none."""

    def step(at: Column, level: Column) -> Column:
        met = F.coalesce(F.get(level["lo"], at) <= low_level, F.lit(False)) | F.coalesce(F.get(level["hi"], at) >= high_level, F.lit(False))
        return F.when(met, at).otherwise(at + level["step"])

    return F.aggregate(levels, start.cast("int"), step)


def ticker_book(prices: DataFrame) -> DataFrame:
    """One row per ticker: its daily bars, its months and their range extremes.

    Bars are unique per (ticker, date), so the calendar bounds a row. One exchange serves every step.
    """
    bars = prices.select(
        "ticker",
        "date",
        F.last_day("date").alias("month"),
        F.col("adjOpen").alias("open"),
        F.col("adjHigh").alias("high"),
        F.col("adjLow").alias("low"),
        F.col("adjClose").alias("close"),
    ).repartition("ticker")
    months = bars.groupBy("ticker", "month").agg(
        F.min("low").alias("lo"),
        F.max("high").alias("hi"),
        F.count("*").cast("int").alias("n"),
        F.array_sort(F.collect_list(F.struct("date", "open", "high", "low", "close"))).alias("d"),
    )
    last = F.sum("n").over(Window.partitionBy("ticker").orderBy("month")).cast("int")
    months = months.withColumn("last", last).withColumn("first", F.col("last") - F.col("n") + 1)
    whole = months.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("month", "first", "last", "lo", "hi", "d"))).alias("m"))
    return whole.select(
        "ticker",
        F.transform(
            F.flatten(F.transform("m", lambda x: x["d"])),
            lambda x, i: F.struct((i + 1).alias("i"), x["date"].alias("date"), x["open"].alias("open"), x["high"].alias("high"), x["low"].alias("low"), x["close"].alias("close")),
        ).alias("days"),
        F.transform("m", lambda x: F.struct(x["month"].alias("month"), x["first"].alias("first"), x["last"].alias("last"))).alias("months"),
        range_extremes(F.transform("m", lambda x: x["lo"]), F.transform("m", lambda x: x["hi"])).alias("levels"),
    )


def rebalance_bars(signals: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per (strategy, ticker) ever wanted: the ticker's book and the wanted months.

    The target of a bar's month is the signal of the calendar month before it.
    ``signals`` may carry ``cash``, what the strategy puts into the name in that month.
    """
    cash = F.col("cash").cast("double") if "cash" in signals.columns else F.lit(None).cast("double")
    wanted = signals.select("strategy", "ticker", F.last_day(F.add_months("month", 1)).alias("month"), cash.alias("cash"))
    # At most one row per calendar month of a name.
    wanted = wanted.groupBy("strategy", "ticker", "month").agg(F.max("cash").alias("cash"))
    targets = wanted.groupBy("strategy", "ticker").agg(F.array_sort(F.collect_list(F.struct("month", "cash"))).alias("targets"))
    held = prices.join(signals.select("ticker").distinct(), "ticker", "left_semi")
    return targets.join(ticker_book(held), "ticker")


def first_touch_exits(book: DataFrame, stop: float | None, take: float | None, cfg: EngineConfig, levels: DataFrame | None = None) -> DataFrame:
    """Trades with exit reason, price and bars held; a position open at the last bar has NULL in all of these.

    ``levels`` (strategy, stop, take) gives each strategy its own; else ``stop`` and ``take`` hold for all.
    A signal's cash, where given, else the configured amount, is divided by the close that decides the entry.
    """
    if levels is None:
        book = book.withColumn("stop", F.lit(stop).cast("double")).withColumn("take", F.lit(take).cast("double"))
    else:
        book = book.join(levels.select("strategy", "stop", "take"), "strategy")
    guarded = F.col("stop").isNotNull() | F.col("take").isNotNull()
    size = F.size("months")

    def put(x: Column, **more: Column) -> Column:
        for name, value in more.items():
            x = x.withField(name, value)
        return x

    def day(i: Column) -> Column:
        return F.get("days", i - 1)

    # Wanted months as possible entries; k counts months and i bars, k from 0 and i from 1.
    wanted = F.transform("months", lambda m: F.array_position(F.transform("targets", lambda t: t["month"]), m["month"]).cast("int"))
    book = book.withColumn("wanted", wanted).withColumn("inside", F.transform("wanted", lambda p: p > 0))
    heads = F.transform(
        F.filter(F.sequence(F.lit(0), size - 1), lambda k: F.get("inside", k)),
        lambda k: F.struct(
            k.alias("k"),
            F.get("months", k)["first"].alias("c"),
            F.get("months", k)["last"].alias("last"),
            F.get("targets", F.get("wanted", k) - 1)["cash"].alias("cash"),
            F.array_position(F.slice("inside", k + 2, size), False).cast("int").alias("gap"),
        ),
    )
    entries = F.transform(
        heads,
        lambda x: put(
            x,
            shares=cash_shares(F.coalesce(x["cash"], F.lit(cfg.cash_per_trade)), day(x["c"])["close"]),
            entry_date=day(x["c"] + 1)["date"],
            entry_price=day(x["c"] + 1)["open"],
            end=F.when(x["gap"] > 0, x["k"] + x["gap"]),
            # The month in which the first live bar lies.
            own=F.when(x["c"] == x["last"], x["k"] + 1).otherwise(x["k"]),
        ),
    )
    entries = F.filter(entries, lambda x: x["entry_date"].isNotNull() & (x["shares"] > 0))
    bounded = F.transform(
        entries,
        lambda x: put(
            x,
            low_level=x["entry_price"] * (1 - F.col("stop")),
            high_level=x["entry_price"] * (1 + F.col("take")),
            end_i=F.get("months", x["end"])["first"],
        ),
    )
    passed = F.transform(bounded, lambda x: put(x, met=F.least(first_passage(F.col("levels"), x["own"] + 1, x["low_level"], x["high_level"]), F.coalesce(x["end"], size))))
    found = F.transform(passed, lambda x: put(x, hit=_first_hit(x), out=day(x["end_i"] + F.when(guarded, 2).otherwise(1))))
    trades = F.transform(found, _trade)
    walk = book.select("strategy", "ticker", trades.alias("_all"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, i: Column) -> Column:
        t = F.get("_all", i)
        take_it = t["c"] >= s["free"]
        return F.struct(
            F.when(take_it, F.coalesce(t["exit_i"], F.lit(2**31 - 1))).otherwise(s["free"]).alias("free"),
            F.when(take_it, F.concat(s["kept"], F.array(i))).otherwise(s["kept"]).alias("kept"),
        )

    every = F.when(F.size("_all") > 0, F.sequence(F.lit(0), F.size("_all") - 1)).otherwise(F.array().cast("array<int>"))
    kept = walk.withColumn("_kept", F.aggregate(every, start, step, lambda s: s["kept"]))
    rows = kept.select("strategy", "ticker", F.inline(F.transform("_kept", lambda i: F.get("_all", i))))
    return rows.select("strategy", "ticker", "entry_date", "entry_price", "shares", "exit_date", "exit_price", "reason", "bar_len")


def cash_shares(cash: Column, price: Column) -> Column:
    return F.when(price > 0, F.coalesce(F.floor(cash / price), F.lit(0))).otherwise(F.lit(0)).cast("long")


def _first_hit(x: Column) -> Column:
    """The first live day of the entry's own month, else of the month that the search found, that meets a level."""

    def days(month: Column, least: Column) -> Column:
        m = F.get("months", month)
        first = F.greatest(m["first"], least)
        return F.slice("days", first, F.greatest(F.least(m["last"], F.coalesce(x["end_i"], m["last"])) - first + 1, F.lit(0)))

    live = F.concat(*[F.coalesce(days(m, x["c"] + 2), F.slice("days", 1, 0)) for m in (x["own"], x["met"])])
    met = F.filter(live, lambda d: F.coalesce(d["low"] <= x["low_level"], F.lit(False)) | F.coalesce(d["high"] >= x["high_level"], F.lit(False)))
    return F.get(met, F.lit(0))


def _trade(x: Column) -> Column:
    hit, out = x["hit"], x["out"]
    touched = hit.isNotNull()
    stopped = F.coalesce(hit["low"] <= x["low_level"], F.lit(False))
    price = F.when(stopped, F.least(hit["open"], x["low_level"])).otherwise(F.greatest(hit["open"], x["high_level"]))
    exit_i = F.when(touched, hit["i"]).otherwise(out["i"])
    return F.struct(
        x["c"].alias("c"),
        x["entry_date"].alias("entry_date"),
        x["entry_price"].alias("entry_price"),
        x["shares"].alias("shares"),
        F.when(touched, hit["date"]).otherwise(out["date"]).alias("exit_date"),
        F.when(touched, price).otherwise(out["open"]).alias("exit_price"),
        F.when(touched, F.when(stopped, "stop_loss").otherwise("take_profit")).when(out.isNotNull(), F.lit("rebalance_exit")).alias("reason"),
        (exit_i - x["c"] - 1).alias("bar_len"),
        exit_i.alias("exit_i"),
    )


def trade_log(exits: DataFrame) -> DataFrame:
    """Closed trades only."""
    pnl = F.col("shares") * (F.col("exit_price") - F.col("entry_price"))
    return exits.filter(F.col("exit_date").isNotNull()).select("strategy", "ticker", F.col("exit_date").alias("date"), pnl.alias("pnl"), "bar_len", "reason")


def daily_positions(exits: DataFrame, prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Positions valued on every trading day from entry to the day before exit, open ones to the last day.

    Trades and calendar meet on the month (an equi-join); a day on which the
    name has no bar carries its last close forward.
    """
    cal = calendar.select("date", F.last_day("date").alias("month"))
    first = F.trunc("entry_date", "month")
    last = calendar.select(F.max("date")).scalar()
    exits = exits.withColumn("_until", F.coalesce(F.col("exit_date"), last))
    until = F.trunc("_until", "month")
    months = F.when(until >= first, F.sequence(first, F.greatest(first, until), F.expr("interval 1 month")))
    days = (
        exits.select(
            "strategy", "ticker", "entry_date", "entry_price", "shares", "exit_date",
            F.explode(F.transform(months, lambda m: F.last_day(m))).alias("month"),
        )
        .join(F.broadcast(cal), "month")
        .filter((F.col("date") >= F.col("entry_date")) & F.coalesce(F.col("date") < F.col("exit_date"), F.lit(True)))
    )
    close = prices.select("ticker", "date", F.col("adjClose").alias("_close"))
    w = Window.partitionBy("strategy", "ticker", "entry_date").orderBy("date")
    joined = days.join(close, ["ticker", "date"], "left")
    price = F.last("_close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("price", price).select(
        "strategy", "date", "ticker", "entry_date", "shares", "price", (F.col("shares") * F.col("price")).alias("market_value")
    )


def mark_to_market(
    exits: DataFrame, positions: DataFrame, calendar: DataFrame, strategies: list[str], cfg: EngineConfig
) -> DataFrame:
    """Daily cash and account value of the named strategies."""
    flows = exits.select(
        "strategy",
        F.inline(
            F.array(
                F.struct(F.col("entry_date").alias("date"), (-F.col("shares") * F.col("entry_price")).alias("flow")),
                F.struct(F.col("exit_date").alias("date"), (F.col("shares") * F.col("exit_price")).alias("flow")),
            )
        ),
    )
    flow = flows.filter(F.col("date").isNotNull()).groupBy("strategy", "date").agg(F.sum("flow").alias("flow"))
    value = positions.groupBy("strategy", "date").agg(F.sum("market_value").alias("market_value"))
    names = F.array(*[F.lit(s) for s in strategies])
    spine = calendar.select("date", F.explode(names).alias("strategy"))
    w = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = spine.join(flow, ["strategy", "date"], "left").join(value, ["strategy", "date"], "left")
    cash = F.lit(cfg.initial_cash) + F.sum(F.coalesce("flow", F.lit(0.0))).over(w)
    mv = F.coalesce("market_value", F.lit(0.0))
    return out.select("strategy", "date", cash.alias("cash"), mv.alias("market_value"), (cash + mv).alias("value"))


def trade_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("strategy").agg(
        F.count("*").alias("n_trades"), F.avg("bar_len").alias("avg_bar_len"), F.min("date").alias("first_date")
    )


def pnl_histogram(log: DataFrame, low: float = -15000.0, high: float = 15000.0, bins: int = 49) -> DataFrame:
    """Trade counts in equal bins of a fixed axis; bin 0 and bin ``bins`` + 1 count the trades below and above it."""
    width = (high - low) / bins
    inside = F.least(F.floor((F.col("pnl") - low) / width) + 1, F.lit(bins))
    bucket = F.when(F.col("pnl") < low, 0).when(F.col("pnl") > high, bins + 1).otherwise(inside).cast("int")
    return log.groupBy("strategy", bucket.alias("bin")).agg(F.count("*").alias("n_trades"))
