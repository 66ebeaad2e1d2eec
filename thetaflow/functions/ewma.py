"""Exact adjusted exponentially weighted mean as a running-sum window.

With half-life ``h`` the weight of the observation ``k`` rows back is
``2^(-k/h)`` and the adjusted mean is ``sum(w_j x_j) / sum(w_j)`` over the
non-null observations (weights follow absolute row position, so a null still
ages its neighbours).  Because the common factor cancels, every row can use
weights ``2^((j - c)/h)`` for any constant ``c``; two running sums (one
window, computed incrementally and inside whole-stage codegen) then give the
mean in O(n).

``2^(j/h)`` overflows after ~1000*h rows, so each series is cut into chunks
of ``K`` rows with ``c`` = end of the chunk, and the last ``60*h`` rows of a
chunk are copied into the next one as warm-up.  A NaN is a missing value like
a null: it has no mean, and none of the rows after it counts it.  Observations older than the
warm-up carry a relative weight below 2^-60, so the result equals the full
recursion to double precision.  The chunk column refines the series
partitioning, so no extra shuffle is needed.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thetaflow.functions.columns import c, series_window

IDX, CHUNK = "_ewm_idx", "_ewm_chunk"


def add_ewma(df: DataFrame, cols: dict[str, str], half_life: int, series_keys: Sequence[str] = (),
             order_by: Sequence[str] = ("date",)) -> DataFrame:
    """Add ``out = ewma(src)`` for each ``src -> out`` in ``cols``."""
    h = int(half_life)
    span = 60 * h
    k = 900 * h - span  # chunk length: exponents stay within (-900, 0]
    idx = F.row_number().over(series_window(series_keys, order_by)) - 1
    out = df.withColumn(IDX, idx)
    own = F.floor(F.col(IDX) / k)
    copies = F.when((F.col(IDX) % k) >= k - span, F.array(own, own + 1)).otherwise(F.array(own))
    out = out.withColumn(CHUNK, F.explode(copies))
    end = (F.col(CHUNK) + 1) * k
    weight = F.pow(F.lit(2.0), (F.col(IDX) - end).cast("double") / F.lit(float(h)))
    w = Window.partitionBy(*series_keys, CHUNK).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    exprs = {}
    for src, dst in cols.items():
        x = F.when(~F.isnan(c(src)), c(src))
        num = F.sum(F.when(x.isNotNull(), weight * x)).over(w)
        den = F.sum(F.when(x.isNotNull(), weight)).over(w)
        exprs[dst] = F.when(x.isNotNull(), F.try_divide(num, den))
    out = out.withColumns(exprs)
    return out.where(F.col(CHUNK) == F.floor(F.col(IDX) / k)).drop(IDX, CHUNK)
