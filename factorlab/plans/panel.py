"""The factor panel: bars, point-in-time fundamentals, trend, eligibility, z-scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.config import EngineConfig
from factorlab.functions.nulls import finite
from factorlab.operators import bars, joins, regress, scoring, xsection
from factorlab.sources.workspace import Workspace

Z_COLUMNS = {
    "roe_factor": "roe_z",
    "pe_factor": "pe_z",
    "momentum_factor": "momentum_z",
    "trend_factor": "trend_z",
    "trend_expanding_factor": "trend_expanding_z",
}
HZZ_COLUMNS = {"trend_hzz_factor": "trend_hzz_z"}
REQUIRED_Z = ["roe_z", "pe_z", "momentum_z", "trend_z"]
LIVE_Z = ["roe_z", "pe_z", "momentum_z", "trend_expanding_z"]


@dataclass
class Inputs:
    """Market tables; ``daily_metrics`` is None where the daily bars carry the metrics themselves."""

    prices: DataFrame
    daily_metrics: DataFrame | None
    statements: DataFrame
    constituents: DataFrame
    index_daily: DataFrame


def positive_pe_clean(panel: DataFrame) -> DataFrame:
    pe = finite("pe_ratio")
    return panel.withColumn("pe_clean", F.when(pe > 0, pe))


def tradeable_eligibility(panel: DataFrame) -> DataFrame:
    ok = (
        F.col("eligible_price")
        & F.col("next_ret_cc").isNotNull()
        & F.col("next_ret_oc").isNotNull()
        & (F.col("next_open") > 0)
    )
    return panel.withColumn("eligible", F.coalesce(ok, F.lit(False)))


def index_history(index_months: DataFrame, index_daily: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Index next return beside its own moving-average deviations, keyed by series."""
    signals = bars.ma_deviation(index_daily, cfg.ma_windows, "adj_close", key=None)
    return joins.factor_history_join(index_months, signals).withColumn("series_id", F.lit("index"))


def raw_panel(
    inputs: Inputs,
    cfg: EngineConfig,
    trend_coefs: DataFrame | None = None,
    expanding_coefs: DataFrame | None = None,
    smoothed: DataFrame | None = None,
) -> DataFrame:
    """Monthly panel before z-scores. Coefficient tables override the fitted trend; given smoothed betas
    also add the cross-sectional trend, whose ratios are the same month's deviations plus one."""
    own_metrics = inputs.daily_metrics is None
    monthly = bars.stock_features(bars.monthly_bars_with_signals(inputs.prices, cfg.ma_windows, own_metrics), cfg)
    idx = bars.index_months(inputs.index_daily, cfg)
    if trend_coefs is None or expanding_coefs is None:
        history = index_history(idx, inputs.index_daily, cfg)
        if trend_coefs is None:
            trend_coefs = regress.coefficients_wide(regress.index_trend_full(history, cfg.dev_cols, cfg), cfg.dev_cols)
        if expanding_coefs is None:
            expanding_coefs = regress.expanding_trend_betas(history, cfg.dev_cols, cfg).drop("series_id")
    monthly = regress.with_trends(
        monthly, {"trend_raw": trend_coefs, "trend_expanding_raw": expanding_coefs}, cfg.dev_cols
    )
    if smoothed is not None:
        monthly = regress.with_hzz(monthly, smoothed, cfg.ma_windows)
        monthly = monthly.withColumn("trend_hzz_factor", F.col("trend_hzz_raw"))
    # As-of and sector steps keep the ticker layout; joining metrics of their own moves to (ticker, month).
    panel = joins.sector_enrich(joins.asof_fundamental(monthly, inputs.statements), inputs.constituents)
    if not own_metrics:
        panel = joins.panel_assembly(panel, bars.monthly_metrics(inputs.daily_metrics))
    panel = joins.index_enrich(panel, idx)
    panel = tradeable_eligibility(positive_pe_clean(panel))
    return panel.withColumns(
        {
            "roe_factor": F.col("roe"),
            "pe_factor": -F.col("pe_clean"),
            "momentum_factor": F.col(f"momentum_{cfg.momentum_lag}m"),
            "trend_factor": F.col("trend_raw"),
            "trend_expanding_factor": F.col("trend_expanding_raw"),
        }
    )


def score_panel(raw: DataFrame, cfg: EngineConfig, columns: dict[str, str] = Z_COLUMNS, ws: Workspace | None = None) -> DataFrame:
    scored = xsection.winsor_zscore(raw, columns, cfg.min_names_zscore, ws=ws)
    return scoring.composite_min3(scored, REQUIRED_Z)


def factor_panel(
    inputs: Inputs, cfg: EngineConfig, ws: Workspace, trend_coefs=None, expanding_coefs=None, smoothed: DataFrame | None = None
) -> DataFrame:
    """Raw panel written once to the shared folder (its z-scores need several passes),
    then scored. Given smoothed betas bring the cross-sectional trend into the same passes."""
    raw = ws.materialise(raw_panel(inputs, cfg, trend_coefs, expanding_coefs, smoothed), "raw_panel")
    return score_panel(raw, cfg, Z_COLUMNS | (HZZ_COLUMNS if smoothed is not None else {}), ws)


def inject_hzz(
    panel: DataFrame, signals: DataFrame, cfg: EngineConfig, ws: Workspace, smoothed: DataFrame | None = None
) -> DataFrame:
    """Cross-sectional trend: ratios, monthly betas, smoothing, prediction, z-score.

    The ratios feed the fit and the prediction, and the joined panel feeds several
    z-score passes, so both are written once.
    """
    ratios = ws.materialise(bars.ma_ratio(signals, cfg.ma_windows), "ma_ratios")
    if smoothed is None:
        smoothed = regress.smooth_betas(hzz_betas(panel, ratios, cfg, ws), cfg.ratio_cols, cfg.beta_smoothing)
    predicted = regress.hzz_predict(ratios, smoothed, cfg.ratio_cols)
    keep = [c for c in panel.columns if c not in ("trend_hzz_raw", "trend_hzz_factor", "trend_hzz_z")]
    out = panel.select(*keep).join(predicted, ["ticker", "month"], "left")
    out = ws.materialise(out.withColumn("trend_hzz_factor", F.col("trend_hzz_raw")), "panel_hzz")
    return xsection.winsor_zscore(out, HZZ_COLUMNS, cfg.min_names_zscore)


def hzz_betas(monthly: DataFrame, ratios: DataFrame, cfg: EngineConfig, ws: Workspace) -> DataFrame:
    base = monthly.filter(F.coalesce("eligible_price", F.lit(False))).select("ticker", "month", "next_ret_cc")
    # Two passes (means, then centred products) read these rows.
    rows = ws.materialise(base.join(ratios, ["ticker", "month"]), "regression_rows")
    return regress.xs_multivariate_betas(rows, "next_ret_cc", cfg.ratio_cols, cfg.min_names_multivariate)
