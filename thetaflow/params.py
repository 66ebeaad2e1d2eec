"""Operator defaults as frozen dataclasses.

Fixed values that must equal the reference pipeline's defaults for the same
results are listed here together, in their natural order.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
UNDERLYING_ID = 108105
VOL_SECURITIES = (  # (security id, column name)
    (117801, "VIX"),
    (152892, "VVIX"),
    (145764, "VIXM"),
)
DEFAULT_MIN_DATE = datetime.date(2023, 1, 1)
DATE_PROBLEMS = (datetime.date(2025, 5, 12), datetime.date(2025, 1, 8))
LAGS = (1, 2, 3)
SIGNAL_WEIGHTS = (0.6, 0.3, 0.1)
RETURN_BASES = ("ret_sprc", "ret_uprc")
CAPITAL = 1_000_000.0
WEIGHT_PER_TRADE = 0.05
VOL_EWMA_HALF_LIFE = 5
ZSCORE_WINDOW = 252
VOL_COLS = ("VIX", "VVIX", "VIX_TS")
ANNUALIZATION = 252
RISK_FREE_DAILY = 0.0
PORTFOLIO_BASE = 1_000_000.0
PERCENTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)
NUM_DECILES = 10
ACF_MAX_LAGS = 40
ACF_CONFIDENCE = 0.95
FIXED_BREAKS = (-2, -1, -0.5, 0, 0.5, 1, 2)
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class StraddleParams:
    underlyings: tuple[int, ...] | None = (UNDERLYING_ID,)  # None: all
    min_date: datetime.date = DEFAULT_MIN_DATE
    date_problems: tuple[datetime.date, ...] = DATE_PROBLEMS


@dataclass(frozen=True)
class FeatureParams:
    half_life: int = VOL_EWMA_HALF_LIFE
    zscore_window: int = ZSCORE_WINDOW
    vol_cols: tuple[str, ...] = VOL_COLS

    def __post_init__(self):
        if not (isinstance(self.half_life, int) and self.half_life > 0):
            raise ValueError("half_life must be a positive integer")
        if not (isinstance(self.zscore_window, int) and self.zscore_window > 0):
            raise ValueError("zscore_window must be a positive integer")


@dataclass(frozen=True)
class SignalParams:
    lags: tuple[int, ...] = LAGS
    weights: tuple[float, ...] = SIGNAL_WEIGHTS
    bases: tuple[str, ...] = RETURN_BASES

    def __post_init__(self):
        if len(self.lags) != len(self.weights):
            raise ValueError("lags and weights must have the same length")
        if not all(isinstance(k, int) and k > 0 for k in self.lags):
            raise ValueError("lags must be positive integers")


@dataclass(frozen=True)
class BacktestParams:
    capital: float = CAPITAL
    weight_per_trade: float = WEIGHT_PER_TRADE

    def __post_init__(self):
        if not 0 < self.weight_per_trade <= 1:
            raise ValueError("weight_per_trade must be in (0, 1]")

    @property
    def capital_per_trade(self) -> float:
        return self.capital * self.weight_per_trade


@dataclass(frozen=True)
class AnalysisParams:
    annualization: int = ANNUALIZATION
    risk_free_daily: float = RISK_FREE_DAILY
    portfolio_base: float = PORTFOLIO_BASE
    percentiles: tuple[float, ...] = PERCENTILES
    num_deciles: int = NUM_DECILES
    acf_max_lags: int = ACF_MAX_LAGS
    acf_confidence: float = ACF_CONFIDENCE
    fixed_breaks: tuple[float, ...] = field(default=FIXED_BREAKS)
