"""thetaflow: short-dated straddle and volatility-regime analytics on Spark.

Every public function takes and returns a lazy ``pyspark.sql.DataFrame``;
nothing is collected to the driver.  Order-dependent operators take an
explicit ``order_by`` and ``series_keys`` instead of relying on row order.
"""

from thetaflow.params import (
    AnalysisParams,
    BacktestParams,
    FeatureParams,
    SignalParams,
    StraddleParams,
)
from thetaflow.session import build_session, checkpoint_dir

__all__ = [
    "AnalysisParams",
    "BacktestParams",
    "FeatureParams",
    "SignalParams",
    "StraddleParams",
    "build_session",
    "checkpoint_dir",
]
