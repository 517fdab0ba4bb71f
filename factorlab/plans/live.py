"""The monthly rebalance job: live panel, targets, difference to the held state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlab.config import Exits, Sizing
from factorlab.operators import portfolio, scoring
from factorlab.plans.panel import LIVE_Z
from factorlab.sources import sinks


def live_eligibility(panel: DataFrame, floor: float) -> DataFrame:
    """Close strictly above the floor and at least one factor score present."""
    any_z = F.coalesce(*LIVE_Z).isNotNull()
    return panel.withColumn("eligible", F.coalesce((F.col("close") > floor) & any_z, F.lit(False)))


@dataclass(frozen=True)
class LivePortfolio:
    """One traded portfolio: how many names, and how much of what for each."""

    name: str
    top_n: int
    sizing: Sizing
    exits: Exits


def live_targets(panel: DataFrame, month, top_n: int, floor: float) -> DataFrame:
    """Top names of one month by the skip-missing composite."""
    snap = live_eligibility(panel.filter(F.col("month") == F.lit(month)), floor)
    scored = snap.withColumn("score", scoring.composite(LIVE_Z, 3)).filter(F.col("eligible") & F.col("score").isNotNull())
    return portfolio.topn_by_score(scored, ["month"], top_n).select("month", "rank", "ticker", "score", "close")


def portfolio_targets(panel: DataFrame, month, portfolios: list[LivePortfolio], floor: float) -> DataFrame:
    """(strategy, ...) targets of all portfolios: the month is ranked once, to the largest of them."""
    ranked = live_targets(panel, month, max(p.top_n for p in portfolios), floor)
    which = F.array(*[F.struct(F.lit(p.name).alias("strategy"), F.lit(p.top_n).alias("_n")) for p in portfolios])
    return ranked.select("*", F.inline(which)).filter("rank <= _n").drop("_n")


def monthly_rebalance(
    panel: DataFrame, state: DataFrame, month, portfolios: list[LivePortfolio], floor: float, equity: float, cash: float
) -> DataFrame:
    """Order table per portfolio: action per name with size and bracket levels for entries."""
    target = portfolio_targets(panel, month, portfolios, floor)
    diff = portfolio.rebalance_diff(state, target)
    # The targets have at most top_n rows a portfolio.
    rows = diff.join(F.broadcast(target.select("strategy", "ticker", "rank", "score", "close")), ["strategy", "ticker"], "left")
    entering = F.col("action") == "enter"

    def by_portfolio(value) -> Column:
        out = F.lit(None)
        for p in portfolios:
            out = F.when(F.col("strategy") == p.name, value(p)).otherwise(out)
        return F.when(entering, out)

    def quantity(p: LivePortfolio) -> Column:
        if p.sizing.method == "percent_of_equity":
            return portfolio.pct_equity_shares(F.col("close"), F.lit(equity), p.sizing.share, minimum=1)
        return portfolio.fixed_cash_shares(F.col("close"), cash)

    def levels(p: LivePortfolio) -> tuple[Column, Column]:
        return portfolio.bracket_prices(F.col("close"), p.exits.stop, p.exits.take)

    return rows.select(
        "strategy", "ticker", "action", "rank", "score",
        by_portfolio(quantity).alias("quantity"),
        by_portfolio(lambda p: levels(p)[0]).alias("stop_price"),
        by_portfolio(lambda p: levels(p)[1]).alias("take_price"),
    )


def next_state(orders: DataFrame) -> DataFrame:
    """What every portfolio holds once its orders are done."""
    return orders.filter(F.col("action") != "exit").select("strategy", "ticker")


def rebalance_and_store(orders: DataFrame, path: str, month, base: int | None = None) -> str:
    """Write the state that the next month starts from.

    ``base`` is the version the orders were made from: they may come from the very folder that is
    written, and are refused if it has moved on meanwhile.
    """
    return sinks.write_state(next_state(orders), path, month.isoformat(), base)
