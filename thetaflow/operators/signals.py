"""Straddle returns and lag-weighted signals (C7, legacy fold variant of C9)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thetaflow.functions.columns import all_not_null, c, fold_add, series_window, sum_null_as_zero
from thetaflow.params import SignalParams


def add_straddle_returns(df: DataFrame, open_col: str = "straddle_day_0",
                         close_col: str = "straddle_day_1", diff_col: str = "uprc_diff",
                         guard_zero: bool = True) -> DataFrame:
    """Short-straddle returns against the close price and the intrinsic value.

    ``guard_zero`` (default) gives null when the open price is 0; the legacy
    form divides without the guard, and a zero denominator is null as well.
    """
    for col in (open_col, close_col, diff_col):
        if col not in df.columns:
            raise ValueError(f"missing required column {col!r}")
    d0, d1, diff = c(open_col), c(close_col), c(diff_col)
    sprc = F.try_divide(d0 - d1, d0)
    uprc = F.try_divide(d0 - F.abs(diff), d0)
    if guard_zero:
        sprc, uprc = F.when(d0 != 0, sprc), F.when(d0 != 0, uprc)
    return df.withColumns({"ret_sprc": sprc, "ret_uprc": uprc})


def weighted_lag_name(base: str, lag: int, weight: float) -> str:
    return f"{base}_lag_{lag}_{weight}"


def add_signal_components(df: DataFrame, params: SignalParams = SignalParams(),
                          series_keys: Sequence[str] = ("securityid",),
                          order_by: Sequence[str] = ("date",), fold: bool = False,
                          weight_first: bool = False) -> DataFrame:
    """Lags, weighted lags and their horizontal sum.

    All lags share one window specification, so they are computed in a single
    sort of each series.  ``fold=True`` propagates nulls (legacy); otherwise
    a null term counts as 0.
    """
    w = series_window(series_keys, order_by)
    bases = [b for b in params.bases if b in df.columns]
    lags = {f"{b}_lag_{k}": F.lag(c(b), k).over(w) for b in bases for k in params.lags}
    out = df.withColumns(lags)
    weighted = {}
    for b in bases:
        for k, wt in zip(params.lags, params.weights):
            lag = c(f"{b}_lag_{k}")
            weighted[weighted_lag_name(b, k, wt)] = (F.lit(wt) * lag) if weight_first else (lag * F.lit(wt))
    out = out.withColumns(weighted)
    signals = {}
    for b in params.bases:
        names = [weighted_lag_name(b, k, wt) for k, wt in zip(params.lags, params.weights)]
        names = [n for n in names if n in out.columns]
        if not names:
            signals[f"{b}_signal"] = F.lit(None).cast("double")
        else:
            signals[f"{b}_signal"] = fold_add(names) if fold else sum_null_as_zero(names)
    return out.withColumns(signals)


def generate_signals(df: DataFrame, params: SignalParams = SignalParams(),
                     series_keys: Sequence[str] = ("securityid",),
                     order_by: Sequence[str] = ("date",)) -> DataFrame:
    """Returns -> lags -> weighted lags -> signal, then drop rows with any null.

    Lags are taken before the null drop, as in the reference; NaN values are
    kept (only nulls drop).
    """
    out = add_signal_components(add_straddle_returns(df), params, series_keys, order_by)
    return out.where(all_not_null(out.columns))
