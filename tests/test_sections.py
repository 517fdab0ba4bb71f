"""Cross-sectional ranks, quantiles and z-scores against pandas."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorlab.functions.nulls import finite
from factorlab.functions.stats import normal_two_sided_p, student_two_sided_p
from factorlab.operators import ranks, scoring, xsection

M1, M2 = dt.date(2001, 1, 31), dt.date(2001, 2, 28)


def skewed(spark, n=4000):
    """One month holds most rows and one value holds a third of them."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=n)
    v[: n // 3] = 0.25
    v[-900:-600] = np.repeat(v[-900:-750], 2)  # pairs: ties below the hot threshold
    rows = [(M1 if i < n * 9 // 10 else M2, f"T{i:05d}", float(x)) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "month date, ticker string, v double"), pd.DataFrame(rows, columns=["month", "ticker", "v"])


def test_rank_first_is_total_order(spark, ws):
    df, pdf = skewed(spark)
    got = ranks.rank_first(df, ["month"], ["v", "ticker"], "r", ws).toPandas()
    want = pdf.sort_values(["month", "v", "ticker"])
    want["r"] = want.groupby("month").cumcount() + 1
    merged = got.merge(want, on=["month", "ticker"], suffixes=("", "_w"))
    assert len(merged) == len(pdf)
    assert (merged["r"] == merged["r_w"]).all()


def test_rank_average_matches_pandas(spark, ws):
    df, pdf = skewed(spark)
    got = ranks.rank_average(df, ["month"], "v", "ticker", "r", ws).toPandas().set_index("ticker")["r"]
    want = pdf.assign(r=pdf.groupby("month")["v"].rank()).set_index("ticker")["r"]
    assert np.allclose(got.sort_index(), want.sort_index())


def test_quantiles_match_pandas(spark):
    """Also with values packed into 0.1 % of each other, and with one far away."""
    df, pdf = skewed(spark)
    rng = np.random.default_rng(8)
    packed = [(dt.date(2001, 4, 30), f"P{i:04d}", 100 + 0.1 * float(x)) for i, x in enumerate(rng.random(2000))] + [(dt.date(2001, 4, 30), "FAR", -1e9)]
    df = df.union(spark.createDataFrame(packed, df.schema))
    pdf = pd.concat([pdf, pd.DataFrame(packed, columns=pdf.columns)])
    probs = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    got = {r["month"]: r["q"] for r in ranks.quantiles(df, ["month"], "v", probs).collect()}
    for month, g in pdf.groupby("month"):
        assert np.allclose(got[month], g["v"].quantile(probs))


def test_quantiles_of_every_size(spark):
    """Groups from one row to many times the sketch's size, with a value that repeats, signed zeros and all nulls."""
    rng = np.random.default_rng(4)
    sizes = {1: 1, 2: 2, 3: 7, 4: 90, 5: 1200, 6: 40_000}
    pdf = pd.concat([pd.DataFrame({"month": m, "v": np.round(rng.standard_t(2, n), 3)}) for m, n in sizes.items()])
    pdf.loc[rng.random(len(pdf)) < 0.3, "v"] = -0.0
    df = spark.createDataFrame(pdf).repartition(12).union(spark.range(9).selectExpr("7L", "CAST(NULL AS DOUBLE)"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r["month"]: r for r in ranks.quantiles(df, ["month"], "v", probs).collect()}
    assert set(got) == set(sizes)
    for month, g in pdf.groupby("month"):
        assert got[month]["n"] == len(g)
        assert np.allclose(got[month]["q"], g["v"].quantile(probs), rtol=1e-12)
    # A group of this size leaves the last aggregate only its brackets and the stretches between.
    cells = ranks.quantile_cells(df.filter("month = 6"), ["month"], {"q": "v"}, [0.01, 0.99])
    assert cells.count() < 200 and cells.agg(F.sum("_c")).first()[0] == sizes[6]


def test_zscore_of_hot_and_flat_months(spark):
    """A month with most rows and a month of one value that no binary fraction holds."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"month": 1, "ticker": np.arange(30_000), "v": np.exp(rng.normal(size=30_000) * 4), "w": rng.integers(0, 3, 30_000) / 10})
    flat = pd.DataFrame({"month": 2, "ticker": np.arange(31), "v": 0.1, "w": np.arange(31.0)})
    df = spark.createDataFrame(pd.concat([pdf, flat])).repartition(6)
    out = xsection.winsor_zscore(df, {"v": "vz", "w": "wz"}, 25).orderBy("month", "ticker").toPandas()
    assert out[out["month"] == 2]["vz"].isna().all() and out[out["month"] == 2]["wz"].notna().all()
    for name in "vw":
        x = pdf[name].clip(pdf[name].quantile(0.01), pdf[name].quantile(0.99))
        assert np.allclose(out[out["month"] == 1][f"{name}z"], (x - x.mean()) / x.std(ddof=0), rtol=1e-9)


def test_quintile_of_a_single_name(spark):
    assert spark.range(1).select(ranks.quintile_bucket(F.lit(1), F.lit(1)).alias("q")).first()["q"] == 1


def test_normal_tail_keeps_its_digits(spark):
    zs = [0.0, 0.5, 2.0, 2.83, 2.84, 6.0, 9.0, 20.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(normal_two_sided_p(F.col("z")).alias("p")).toPandas()["p"]
    assert np.allclose(got, [math.erfc(z / math.sqrt(2)) for z in zs], rtol=1e-9, atol=0)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(min_value=5, max_value=400))
def test_quintiles_match_qcut(spark, n):
    got = (
        spark.range(1, n + 1)
        .select(F.col("id"), ranks.quintile_bucket(F.col("id"), F.lit(n)).alias("q"))
        .orderBy("id")
        .toPandas()["q"]
    )
    want = pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False) + 1
    assert (got.to_numpy() == want.to_numpy()).all()
    counts = np.bincount(got)[1:]
    assert counts.max() - counts.min() <= 1


def test_zscore(spark):
    rng = np.random.default_rng(5)
    rows = [(M1, f"A{i}", float(x)) for i, x in enumerate(rng.normal(size=200))]
    rows += [(M1, "NULL", None), (M1, "INF", float("inf")), (M1, "NAN", float("nan"))]
    rows += [(M2, f"B{i}", 1.0) for i in range(30)]  # no dispersion
    rows += [(dt.date(2001, 3, 31), f"C{i}", float(i)) for i in range(24)]  # too few names
    df = spark.createDataFrame(rows, "month date, ticker string, v double")
    out = xsection.winsor_zscore(df, {"v": "z"}, 25).toPandas()
    a = out[out["ticker"].str.startswith("A")].sort_values("ticker")
    x = pd.Series({t: v for _, t, v in rows if t.startswith("A")}).sort_index()
    clipped = x.clip(x.quantile(0.01), x.quantile(0.99))
    assert np.allclose(a["z"], (clipped - clipped.mean()) / clipped.std(ddof=0))
    assert abs(a["z"].mean()) < 1e-12 and abs(a["z"].std(ddof=0) - 1) < 1e-12
    assert out[~out["ticker"].str.startswith("A")]["z"].isna().all()


def test_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (1.5,)], "v double")
    assert [r[0] for r in df.select(finite("v")).collect()] == [None, None, None, None, 1.5]


def test_p_values(spark):
    # Two-sided t and normal p-values from standard tables.
    rows = [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (2.617, 120, 0.01), (0.0, 7, 1.0)]
    df = spark.createDataFrame(rows, "t double, n int, p double")
    for r in df.select("p", student_two_sided_p(F.col("t"), F.col("n")).alias("q")).collect():
        assert abs(r["p"] - r["q"]) < 2e-4
    z = spark.createDataFrame([(1.959964, 0.05), (2.575829, 0.01), (0.0, 1.0), (-1.0, 0.317311)], "z double, p double")
    for r in z.select("p", normal_two_sided_p(F.col("z")).alias("q")).collect():
        assert abs(r["p"] - r["q"]) < 1e-6


def simplex_by_hand(raw, lower, upper):
    """Brute force: the pinned set is found by repeated passes over plain lists."""
    raw = [max(x, 0.0) for x in raw]
    total = sum(raw)
    raw = [x / total for x in raw] if total > 0 else [1 / len(raw)] * len(raw)
    fixed = {}
    while len(fixed) < len(raw):
        free = [i for i in range(len(raw)) if i not in fixed]
        mass, weight = 1 - sum(fixed.values()), sum(raw[i] for i in free)
        cand = {i: raw[i] / weight * mass if weight > 0 else mass / len(free) for i in free}
        bad = {i: min(max(c, lower), upper) for i, c in cand.items() if c < lower or c > upper}
        fixed.update(bad or cand)
    s = sum(fixed.values())
    return [fixed[i] / s for i in range(len(raw))]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(0, 10), min_size=4, max_size=4), min_size=1, max_size=20))
def test_bounded_simplex(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw array<double>")
    out = df.select("i", scoring.bounded_simplex(F.col("raw"), 4, 0.10, 0.45).alias("w")).orderBy("i").collect()
    for r, raw in zip(out, rows):
        assert abs(sum(r["w"]) - 1) < 1e-9
        assert np.allclose(r["w"], simplex_by_hand(raw, 0.10, 0.45))


def test_infeasible_bounds():
    with pytest.raises(ValueError):
        scoring.bounded_simplex(F.col("raw"), 4, 0.3, 0.45)
    with pytest.raises(ValueError):
        scoring.bounded_simplex(F.col("raw"), 4, 0.0, 0.2)


def test_composite_and_weighted_score_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, None), (1.0, None, None, 4.0), (1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    got = df.select(
        scoring.composite(["a", "b", "c", "d"]).alias("m"),
        scoring.weighted_score([F.col(c) for c in "abcd"], [F.lit(1.0), F.lit(1.0), F.lit(-1.0), F.lit(1.0)]).alias("w"),
    ).collect()
    assert [r["m"] for r in got] == [2.0, None, 2.5]
    assert [r["w"] for r in got] == [None, None, 1.0]
