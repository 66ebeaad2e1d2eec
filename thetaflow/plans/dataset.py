"""Composite pipelines: the 1DTE dataset (C6), signals + backtest, legacy chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thetaflow.operators import backtest, chain, features, signals, vol
from thetaflow.params import BacktestParams, FeatureParams, SignalParams, StraddleParams


def dataset_1dte(options: DataFrame, prices: DataFrame,
                 straddle_params: StraddleParams = StraddleParams(),
                 feature_params: FeatureParams = FeatureParams(),
                 generate_features: bool = True, sort: bool = False) -> DataFrame:
    """Straddles with the volatility table (+ z-scores) and underlying returns.

    The volatility table has one row per calendar date whatever the data
    volume (it is grouped by ``date``), so it is broadcast: bounded by ~366
    rows a year.  Returns are keyed by ``(securityid, date)`` and grow with
    the number of underlyings, so that join is left to the planner (AQE).
    """
    st = chain.straddles(options, prices, straddle_params)
    vt = vol.vol_table(prices)
    if generate_features:
        vt = features.add_vol_zscore(vt, feature_params)
    out = st.join(F.broadcast(vt), "date", "left")
    if generate_features:
        out = out.join(features.log_returns(prices, straddle_params), ["securityid", "date"], "left")
    if sort:
        out = out.orderBy(F.col("securityid"), F.col("date").asc_nulls_last())
    return out


def backtest_1dte(options: DataFrame, prices: DataFrame,
                  straddle_params: StraddleParams = StraddleParams(),
                  feature_params: FeatureParams = FeatureParams(),
                  signal_params: SignalParams = SignalParams(),
                  backtest_params: BacktestParams = BacktestParams()) -> DataFrame:
    """Entry 2: dataset -> signals -> backtest."""
    ds = dataset_1dte(options, prices, straddle_params, feature_params)
    return backtest.generate_backtest(signals.generate_signals(ds, signal_params), backtest_params)


LEGACY_RENAMES = {
    "uprc_day_0": "open_uprc", "uprc_day_1": "close_uprc",
    "sprc_day_0_C": "open_sprc_C", "sprc_day_0_P": "open_sprc_P",
    "sprc_day_1_C": "close_sprc_C", "sprc_day_1_P": "close_sprc_P",
    "straddle_day_0": "open_straddle", "straddle_day_1": "close_straddle",
}


def legacy_backtest(options: DataFrame, prices: DataFrame,
                    straddle_params: StraddleParams = StraddleParams(),
                    signal_params: SignalParams = SignalParams()) -> DataFrame:
    """The legacy end-to-end script.

    Same chain under ``open_*`` / ``close_*`` names (its pivot's any-null
    filter removes exactly the rows the strict merge filter removes), returns
    without a zero guard, null-propagating fold signal, one-shot PnL and
    running sums; rows with null lags are kept.
    """
    st = chain.straddles(options, prices, straddle_params).withColumnsRenamed(LEGACY_RENAMES)
    st = signals.add_straddle_returns(st, "open_straddle", "close_straddle", "uprc_diff", guard_zero=False)
    st = signals.add_signal_components(st, signal_params, fold=True, weight_first=True)
    return backtest.legacy_pnl(st)
