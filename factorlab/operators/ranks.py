"""Exact ranks and quantiles inside cross-sections of any size, with one plan for all sizes.

* ranks: one range partitioning over (group, order) splits hot groups and hot
  values alike; positions come from partition offsets, so no task sees a group.
* quantiles: a mergeable sketch brackets the requested order statistics, one exact
  count inside the brackets finds them; two passes over the rows, no row is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlab.functions.nulls import ratio
from factorlab.sources.workspace import Workspace

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits
_ACCURACY = 10_000
_MARGINS = (4e-4, 4e-3, 4e-2, 1.0)  # shares of a group on either side of a quantile
_MARGIN_ROWS = 4
_SALTS = 16


def range_positions(df: DataFrame, order: list[str], ws: Workspace) -> DataFrame:
    """Global 0-based position of every row under ``order``, from one range shuffle.

    The sorted rows are written once to the shared folder, because the offsets
    and the rows must see the same partitions even after a lost executor.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = ws.materialise(placed, "range_positions").withColumn("_part", F.shiftright("_id", _ROW_BITS))
    sizes = placed.groupBy("_part").count()
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition.
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part").withColumn("_pos", F.col("_offset") + local).drop("_id", "_part", "_offset")
    )


def rank_first(df: DataFrame, keys: list[str], order: list[str], out: str, ws: Workspace) -> DataFrame:
    """1..n rank inside each group under a total order (``order`` ends in a tie-break)."""
    placed = range_positions(df, [*keys, *order], ws)
    # Keys are (month, factor)-like, so the start table is bounded by the calendar.
    starts = placed.groupBy(*keys).agg(F.min("_pos").alias("_start"))
    ranked = placed.join(F.broadcast(starts), keys)
    return ranked.withColumn(out, (F.col("_pos") - F.col("_start") + 1).cast("int")).drop("_pos", "_start")


def rank_average(df: DataFrame, keys: list[str], value: str, tie: str, out: str, ws: Workspace) -> DataFrame:
    """Average rank of ``value`` inside each group (ties share the mean of their ranks)."""
    ranked = rank_first(df, keys, [value, tie], "_r", ws)
    # Partial aggregation collapses a repeated value to one row before the shuffle.
    tied = (
        ranked.groupBy(*keys, value)
        .agg(F.count("*").alias("_n"), ((F.min("_r") + F.max("_r")) / 2).alias("_mid"))
        .filter("_n > 1")
    )
    # Each tied value stands once per salt, so the rows of a hot value spread over the salts.
    salted = tied.select(*keys, value, "_mid", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt"))
    rows = ranked.withColumn("_salt", F.pmod(F.col("_r"), F.lit(_SALTS)))
    rank = F.coalesce(F.col("_mid"), F.col("_r").cast("double"))
    return rows.join(salted, [*keys, value, "_salt"], "left").withColumn(out, rank).drop("_r", "_mid", "_salt")


def quintile_bucket(rank: Column, n: Column, buckets: int = 5) -> Column:
    """Bucket of rank r among n by linear quantile edges (sizes differ from ntile)."""
    return F.greatest(F.lit(1), F.coalesce(F.ceil(ratio(buckets * (rank - 1), n - 1)), F.lit(1))).cast("int")


def sketched_brackets(df: DataFrame, keys: list[str], columns: dict[str, str], probs: list[float]) -> DataFrame:
    """Values that surely enclose the order statistics of each group: (keys, _f, n, _lo array, _hi array).

    ``columns`` maps labels to columns; every label becomes rows of its own. One mergeable sketch per group and
    label is off by at most n / _ACCURACY ranks, so a margin of that and a few rows encloses what is asked for.
    """
    edges = [f for p in probs for m in _MARGINS for f in (max(0.0, p - m), min(1.0, p + m))]
    made = [F.struct(F.count(c).alias("n"), F.percentile_approx(c, edges, _ACCURACY).alias("e")).alias(f"_s_{f}") for f, c in columns.items()]
    wide = df.groupBy(*keys).agg(*made)
    long = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("_f"), F.col(f"_s_{f}").alias("s")) for f in columns])).alias("x"))
    n, e = F.col("x.s.n"), F.col("x.s.e")
    fits = [(m - 1 / _ACCURACY) * n >= _MARGIN_ROWS for m in _MARGINS[:-1]]
    # The narrowest margin whose surplus over the sketch's error is worth a few rows; the last is the whole group.
    step = F.coalesce(*[F.when(ok, F.lit(i)) for i, ok in enumerate(fits)], F.lit(len(fits)))

    def side(offset: int) -> Column:
        return F.array(*[F.get(e, 2 * (step + len(_MARGINS) * i) + offset) for i in range(len(probs))])

    return long.filter(n > 0).select(*keys, F.col("x._f").alias("_f"), n.alias("n"), side(0).alias("_lo"), side(1).alias("_hi"))


def quantile_cells(df: DataFrame, keys: list[str], columns: dict[str, str], probs: list[float]) -> DataFrame:
    """Each (keys, _f) group cut at its brackets: (keys, _f, n, _region, _v, _c, _m, _s, q).

    Inside a bracket every distinct value is a cell (``_v``), the stretches between are one cell each (``_v`` NULL);
    ``_c``, ``_m`` and ``_s`` are a cell's count, mean and population variance, ``q`` the exact interpolated quantiles.
    Map-side combine leaves a stretch or a repeated value one row per task, so a hot group travels as its brackets.
    """
    found = sketched_brackets(df, keys, columns, probs)
    pairs = F.array(*[F.struct(F.lit(f).alias("_f"), F.col(c).alias("_v")) for f, c in columns.items()])
    rows = df.select(*keys, F.inline(pairs)).filter(F.col("_v").isNotNull())
    v, region, kept = F.col("_v"), F.lit(0), F.lit(False)
    for i in range(len(probs)):
        low, high = F.col("_lo")[i], F.col("_hi")[i]
        region = region + (v >= low).cast("int") + (v > high).cast("int")
        kept = kept | ((v >= low) & (v <= high))
    # Brackets are keyed by calendar and label.
    placed = rows.join(F.broadcast(found), [*keys, "_f"]).withColumn("_region", region).withColumn("_x", v)
    cells = placed.withColumn("_v", F.when(kept, v)).groupBy(*keys, "_f", "n", "_region", "_v")
    cells = cells.agg(F.count("*").alias("_c"), F.avg("_x").alias("_m"), F.var_pop("_x").alias("_s"))
    group = Window.partitionBy(*keys, "_f")
    upto = group.orderBy("_region", "_v").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_end", F.sum("_c").over(upto))

    def statistic(p: float, step: int) -> Column:
        at = F.least(F.floor(F.lit(p) * (F.col("n") - 1)) + step, F.col("n") - 1)
        return F.max(F.when((at < F.col("_end")) & (at >= F.col("_end") - F.col("_c")), F.col("_v"))).over(group)

    missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    interpolated = []
    for p in probs:
        frac = F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
        interpolated.append(F.coalesce((1 - frac) * statistic(p, 0) + frac * statistic(p, 1), missed))
    return cells.withColumn("q", F.array(*interpolated)).drop("_end")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group: (keys, n, q array). Nulls are ignored."""
    return quantile_cells(df, keys, {"q": value}, probs).groupBy(*keys, "n").agg(F.first("q").alias("q"))
