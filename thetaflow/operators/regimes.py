"""Sharpe ratio of a signal's PnL by regime bucket, per position side.

The reference loops over columns, signals, sides and buckets, filtering the
frame once per bucket.  Here all of them are one job: the inputs are laid
out long (one row per column x signal x day), bucket breaks are one grouped
``percentile`` per (column, signal, side), and the bucket statistics are one
grouped aggregation.  The breaks table has one row per (column, signal,
side) -- bounded by the configuration, not by the data -- so it is broadcast.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thetaflow.functions.columns import c, fixed_decimals, join_groups, sharpe
from thetaflow.functions.quantiles import exact_quantiles
from thetaflow.params import AnalysisParams

KEYS = ["signal_base", "column", "side"]


def _long(df: DataFrame, columns: Sequence[str] | None, signal_bases: Sequence[str],
          group_cols: Sequence[str]) -> DataFrame:
    """Rows ``(group.., signal_base, column, side, x, pnl)`` for pos > 0 / pos < 0.

    One pass over ``df``: each input row yields one row per (signal, column)
    through a generator.
    """
    rows = []
    for base in signal_bases:
        pos, pnl = f"{base}_pos", f"{base}_pnl"
        cols = [base] if columns is None else list(columns)
        if any(x not in df.columns for x in [pos, pnl, *cols]):
            continue
        side = F.when(c(pos) > 0, F.lit("long")).when(c(pos) < 0, F.lit("short"))
        for col in cols:
            rows.append(F.struct(F.lit(base).alias("signal_base"), F.lit(col).alias("column"),
                                 side.alias("side"), c(col).cast("double").alias("x"),
                                 c(pnl).cast("double").alias("pnl")))
    if not rows:
        raise ValueError("none of the signals comes with its position, PnL and columns")
    return df.select(*group_cols, F.inline(F.array(*rows))).where(F.col("side").isNotNull())


def quantile_bucket(x: Column, breaks: Column, n: int) -> Column:
    """Right-closed bucket index: ``1 + #(breaks < x)`` of at most ``n`` breaks; null x has no bucket."""
    below = sum((F.when(F.get(breaks, F.lit(i)) < x, 1).otherwise(0) for i in range(n)), F.lit(1))
    return F.when(x.isNotNull(), below)


def _bucket_stats(long: DataFrame, bucket: Column, params: AnalysisParams, group_cols) -> DataFrame:
    keys = [*group_cols, *KEYS]
    g = long.withColumn("bucket", bucket).where(F.col("bucket").isNotNull())
    p = F.col("pnl")
    agg = g.groupBy(*keys, "bucket").agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"),
        F.count(p).alias("n"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"),
    )
    ratio = sharpe(F.col("mean"), F.col("std"), F.col("n"), params.risk_free_daily, params.annualization)
    return agg.withColumn("SharpeRatio", ratio).where(F.col("SharpeRatio").isNotNull())


def sharpe_by_decile(df: DataFrame, signal_bases: Sequence[str], columns: Sequence[str] | None = None,
                     params: AnalysisParams = AnalysisParams(), group_cols: Sequence[str] = ()) -> DataFrame:
    """A10 (``columns=None``: bucket the signal itself) and A11 (bucket other columns).

    Breaks are the linear quantiles ``i/q`` of the side's non-null values;
    buckets are right-closed and duplicate breaks leave empty buckets out.
    Labelled ``"min to max"`` of the bucket's values; buckets without a
    Sharpe ratio (fewer than 2 PnL values, or zero spread) are dropped.
    """
    q = params.num_deciles
    long = _long(df, columns, signal_bases, group_cols)
    keys = [*group_cols, *KEYS]
    breaks = exact_quantiles(long, F.col("x"), [i / q for i in range(1, q)], keys, name="breaks",
                             small_groups=not group_cols)
    # One row per (signal, column, side): bounded by the configuration when
    # no series keys are given, so broadcast; per-series tables go to AQE.
    with_breaks = join_groups(long, breaks, keys, broadcast=not group_cols)
    out = _bucket_stats(with_breaks, quantile_bucket(F.col("x"), F.col("breaks"), q - 1), params, group_cols)
    return out.select(
        *group_cols, *KEYS, "bucket",
        F.format_string("D%d", F.col("bucket")).alias("decile"),
        F.concat(fixed_decimals(F.col("x_min")), F.lit(" to "), fixed_decimals(F.col("x_max"))).alias("DecileAxisLabel"),
        "SharpeRatio",
    )


def interval_label(bucket: Column, breaks: Column) -> Column:
    """What a right-closed bucket holds, with two decimals; the first and the last are open at one end."""
    below, upto = (fixed_decimals(F.get(breaks, bucket - k)) for k in (2, 1))
    return (F.when(F.get(breaks, bucket - 2).isNull(), F.concat(F.lit("<= "), upto))
            .when(F.get(breaks, bucket - 1).isNull(), F.concat(F.lit("> "), below))
            .otherwise(F.concat(F.lit("("), below, F.lit(", "), upto, F.lit("]"))))


def sharpe_by_fixed_bin(df: DataFrame, signal_bases: Sequence[str], columns: Sequence[str],
                        params: AnalysisParams = AnalysisParams(), group_cols: Sequence[str] = ()) -> DataFrame:
    """Sharpe by fixed right-closed bins ``(a, b]`` of each column, per side."""
    if not params.fixed_breaks:
        raise ValueError("a table by fixed bins needs breaks")
    long = _long(df, columns, signal_bases, group_cols)
    arr = F.array_sort(F.array_distinct(F.array(*[F.lit(float(v)) for v in params.fixed_breaks])))
    out = _bucket_stats(long, quantile_bucket(F.col("x"), arr, len(params.fixed_breaks)), params, group_cols)
    return out.select(*group_cols, *KEYS, "bucket", interval_label(F.col("bucket"), arr).alias("BinLabel"), "SharpeRatio")
