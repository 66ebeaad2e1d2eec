"""Volatility-index table (C5): daily mid of each index, side by side.

One scan of the price table filtered to the index ids, one aggregation by
``date``: a conditional aggregate per index replaces the reference's chain
of full outer joins (same rows: a date is present when any index has a
non-null mid on it; missing indices give null columns).  Duplicate rows for
one index and date resolve to the smallest mid, deterministically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thetaflow.functions.columns import guarded_div
from thetaflow.params import VOL_SECURITIES


def index_mid(prices: DataFrame, sec_id: int, name: str) -> DataFrame:
    """``(bidlow + askhigh) / 2`` of one security as column ``name``."""
    mid = ((F.col("bidlow") + F.col("askhigh")) / 2).alias(name)
    return prices.where(F.col("securityid") == sec_id).select("date", mid).where(F.col(name).isNotNull())


def add_term_structure(df: DataFrame, num: str = "VIXM", den: str = "VIX", out: str = "VIX_TS") -> DataFrame:
    """``VIXM / VIX``; null when VIX is null or 0, null column if inputs are missing."""
    if num not in df.columns or den not in df.columns:
        return df if out in df.columns else df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, guarded_div(F.col(num), F.col(den)))


def vol_table(prices: DataFrame, securities=VOL_SECURITIES) -> DataFrame:
    ids = [int(sid) for sid, _ in securities]
    mid = (F.col("bidlow") + F.col("askhigh")) / 2
    src = (prices.where(F.col("securityid").isin(ids))
           .select("securityid", "date", mid.alias("mid"))
           .where(F.col("mid").isNotNull()))
    cols = [F.min(F.when(F.col("securityid") == sid, F.col("mid"))).alias(name) for sid, name in securities]
    return add_term_structure(src.groupBy("date").agg(*cols))
