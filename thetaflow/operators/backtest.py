"""Vectorised backtest (C8) and the legacy one-shot PnL."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thetaflow.functions.columns import c, series_window
from thetaflow.params import CAPITAL, WEIGHT_PER_TRADE, BacktestParams

SIGNALS = ("ret_sprc_signal", "ret_uprc_signal")
# signal -> (close reference, open reference) for the daily PnL
PNL_SOURCES = {
    "ret_sprc_signal": ("straddle_day_1", "straddle_day_0"),
    "ret_uprc_signal": ("uprc_diff", "straddle_day_0"),
}
OPEN_PRICE = "straddle_day_0"


def cumulative(x, w):
    """Running sum over the series; null where the day's value is null."""
    return F.when(x.isNotNull(), F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def generate_backtest(df: DataFrame, params: BacktestParams = BacktestParams(),
                      series_keys: Sequence[str] = ("securityid",),
                      order_by: Sequence[str] = ("date",)) -> DataFrame:
    """P21-P23 + W6: capital, position, daily and cumulative PnL per signal."""
    needed = set(SIGNALS) | {OPEN_PRICE} | {x for pair in PNL_SOURCES.values() for x in pair}
    missing = sorted(n for n in needed if n not in df.columns)
    if missing:
        raise ValueError(f"missing columns for backtest: {missing}")
    cap = params.capital_per_trade
    p0 = c(OPEN_PRICE)
    out = df.withColumns({f"{s}_capital": c(s) * F.lit(cap) for s in SIGNALS})
    out = out.withColumns({
        f"{s}_pos": F.when(p0.isNotNull() & (p0 != 0), F.try_divide(c(f"{s}_capital"), p0)).otherwise(F.lit(0.0))
        for s in SIGNALS
    })
    out = out.withColumns({
        f"{s}_pnl": c(f"{s}_pos") * (c(close) - c(open_))
        for s, (close, open_) in PNL_SOURCES.items()
    })
    w = series_window(series_keys, order_by)
    return out.withColumns({f"{s}_cum_pnl": cumulative(c(f"{s}_pnl"), w) for s in SIGNALS})


def legacy_pnl(df: DataFrame, capital: float = CAPITAL, weight: float = WEIGHT_PER_TRADE,
               open_col: str = "open_straddle", series_keys: Sequence[str] = ("securityid",),
               order_by: Sequence[str] = ("date",)) -> DataFrame:
    """P24 + W6: ``signal * (ref - open) * capital * weight / open`` and its running sum.

    Evaluated left to right as written; a zero open price gives null.
    """
    refs = {"ret_sprc_signal": "close_straddle", "ret_uprc_signal": "uprc_diff"}
    o = c(open_col)
    out = df.withColumns({
        f"{s}_pnl": F.try_divide(c(s) * (c(ref) - o) * F.lit(float(capital)) * F.lit(float(weight)), o)
        for s, ref in refs.items()
    })
    w = series_window(series_keys, order_by)
    return out.withColumns({f"{s}_pnl_cumsum": cumulative(c(f"{s}_pnl"), w) for s in refs})
