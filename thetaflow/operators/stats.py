"""Descriptive statistics (A6), correlation matrices (A7), PnL statistics.

Each result is one aggregation pass (plus at most one window for rolling
sums or ranks) followed by a generator that lays the single aggregate row
out as the report's rows -- the reference's per-column / per-pair loops
become columns of one ``agg``.  ``group_cols`` (e.g. ``securityid`` or a
position side) turns every report into one report per group in the same job.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thetaflow.functions.columns import all_not_null, c, finite_or_null, join_groups, sharpe
from thetaflow.functions.quantiles import average_ranks, exact_quantiles
from thetaflow.params import AnalysisParams

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def percentile_name(p: float) -> str:
    return f"p{int(p * 100)}"


def describe(df: DataFrame, columns: Sequence[str] | None = None,
             params: AnalysisParams = AnalysisParams(), group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per column: count, null_count, mean, std, min, percentiles, max.

    Percentiles are exact with linear interpolation, computed by the
    distributed selection of ``functions.quantiles`` (no group is gathered
    in one task, whatever its size or its ties).
    """
    cols = [x for x in (columns or numeric_columns(df, group_cols)) if x in df.columns]
    cols = [x for x in cols if isinstance(df.schema[x].dataType, NUMERIC)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string")
    long = df.select(*group_cols, *[c(x).cast("double").alias(x) for x in cols]).unpivot(
        list(group_cols), cols, "column", "value")
    v = F.col("value")
    ps = list(params.percentiles)
    keys = [*group_cols, "column"]
    moments = long.groupBy(*keys).agg(
        F.count(v).alias("count"),
        F.count(F.when(v.isNull(), 1)).alias("null_count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    # one row per (group, column): bounded by the number of columns x series
    qs = exact_quantiles(long, v, ps, keys, name="_q", small_groups=not group_cols)
    out = join_groups(moments, qs, keys, "left")
    return out.select(
        *group_cols, "column", "count", "null_count", "mean", "std", "min",
        *[F.col("_q")[i].alias(percentile_name(p)) for i, p in enumerate(ps)], "max",
    )


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation by moments; null (not an error) for a constant column."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson",
                       group_cols: Sequence[str] = ()) -> DataFrame:
    """Correlation matrix after listwise removal of rows with a null."""
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be 'pearson' or 'spearman'")
    cols = [x for x in (columns or numeric_columns(df, group_cols)) if x in df.columns]
    cols = [x for x in cols if isinstance(df.schema[x].dataType, NUMERIC)]
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "column string")
    sub = df.select(*group_cols, *[c(x).cast("double").alias(x) for x in cols]).where(all_not_null(cols))
    if method == "spearman":
        # One rank table for all columns, joined once on (group, column, value), whatever the number of
        # columns; a row's ranks meet again by the row's number.
        numbered = sub.withColumn("_row", F.monotonically_increasing_id())
        long = sub.unpivot(list(group_cols), cols, "_col", "_val")
        table = average_ranks(long, "_val", [*group_cols, "_col"], name="_rank", small_groups=not group_cols)
        values = numbered.unpivot([*group_cols, "_row"], cols, "_col", "_val")
        ranked = join_groups(values, table, [*group_cols, "_col", "_val"])
        sub = ranked.groupBy(*group_cols, "_row").agg(
            *[F.max(F.when(F.col("_col") == x, F.col("_rank"))).alias(x) for x in cols])
    pairs = {}
    for i, a in enumerate(cols):
        for b in cols[i:]:
            pairs[(a, b)] = pearson(c(a), c(b)).alias(f"{i}_{cols.index(b)}")
    agg = sub.groupBy(*group_cols).agg(*pairs.values()) if group_cols else sub.agg(*pairs.values())

    def cell(a, b):
        i, j = sorted((cols.index(a), cols.index(b)))
        return F.col(f"{i}_{j}")

    rows = F.array(*[F.struct(F.lit(a).alias("column"), *[cell(a, b).alias(b) for b in cols]) for a in cols])
    return agg.select(*group_cols, F.inline(rows))


PNL_STAT_NAMES = (  # fixed values: report row labels
    "Mean Daily PnL", "Std Dev Daily PnL", "Annualized Sharpe Ratio", "Win Rate (%)",
    "Max Daily Win", "Max Daily Loss", "Worst 5-Day Cum PnL (%)", "Worst 20-Day Cum PnL (%)",
    "Skewness", "Kurtosis", "Average Win Amount", "Average Loss Amount",
    "Total Return (%) over Period", "Annualized Total Return (%)",
)
NOTEBOOK_STAT_NAMES = (  # fixed values: labels of the notebook variant (trailing blanks included)
    "Mean Daily PnL ", "Std Dev Daily PnL", "Annualized Sharpe Ratio", "Win Rate",
    "Max Daily Win ", "Max Daily Loss ", "Worst 5-Day Cumulative PnL %", "Worst 20-Day Cumulative PnL %",
    "Skewness", "Kurtosis", "Average Win Amount", "Average Loss Amount", "CAGR %", "Annualized CAGR %",
)


def _pnl_moments(df: DataFrame, pnl_col: str, order_by: Sequence[str], group_cols: Sequence[str]) -> DataFrame:
    """Single aggregate row (per group) of everything the PnL reports need.

    The PnL is that of the group's portfolio: summed by day first (partial
    aggregation; a day without any PnL stays null), so the series that the
    rolling windows sort has one row per trading day however many underlyings
    there are, and no result depends on the order of equal dates.  A rolling
    sum covers 5 or 20 days with a PnL.
    """
    keys = list(group_cols)
    daily = df.groupBy(*keys, *order_by).agg(F.sum(c(pnl_col)).alias("_x"))
    days = daily.where(F.col("_x").isNotNull())
    x, series = F.col("_x"), Window.partitionBy(*keys)
    w = series.orderBy(*order_by)

    def rolling(n):
        f = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(x).over(f) == n, F.sum(x).over(f))

    # Central moments in two passes: skewness and kurtosis never divide by an
    # underflowed zero (Spark's one-pass skewness raises under ANSI there).
    base = days.select(*keys, x, rolling(5).alias("_r5"), rolling(20).alias("_r20"), (x - F.avg(x).over(series)).alias("_d"))
    v, d = F.col("_x"), F.col("_d")
    m2 = F.avg(d * d)
    aggs = [
        F.count(v).alias("n"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), F.count(F.when(v > 0, 1)).alias("wins"),
        F.max(v).alias("max"), F.min(v).alias("min"), F.min("_r5").alias("w5"), F.min("_r20").alias("w20"),
        F.try_divide(F.avg(d * d * d), F.pow(m2, 1.5)).alias("skew"),
        (F.try_divide(F.avg(d * d * d * d), m2 * m2) - 3).alias("kurt"),
        F.avg(F.when(v > 0, v)).alias("avg_win"), F.avg(F.when(v < 0, v)).alias("avg_loss"),
        F.sum(v).alias("total"),
    ]
    if not keys:
        return base.agg(*aggs).withColumn("n_rows", daily.agg(F.count("*")).scalar())
    rows = daily.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return join_groups(rows, base.groupBy(*keys).agg(*aggs), keys, "left").fillna(0, ["n"])


def pnl_statistics(df: DataFrame, pnl_col: str, params: AnalysisParams = AnalysisParams(),
                   order_by: Sequence[str] = ("date",), group_cols: Sequence[str] = ()) -> DataFrame:
    """The 14-row PnL report ``(Statistic, Value)``.

    Zero rows for an empty input; 14 nulls when the column is all null.
    NaN and infinities are reported as null.
    """
    if pnl_col not in df.columns:
        return df.sparkSession.createDataFrame([], "Statistic string, Value double")
    m = _pnl_moments(df, pnl_col, order_by, group_cols)
    n, mean, std = F.col("n"), F.col("mean"), F.col("std")
    base, ann = float(params.portfolio_base), params.annualization
    has = n > 0
    total_pct = F.when(has & F.lit(base != 0), F.col("total") / F.lit(base) * 100)
    values = [
        mean, std,
        sharpe(mean, std, n, params.risk_free_daily, ann, min_n=1),
        F.when(has, F.col("wins") / n * 100),
        F.col("max"), F.col("min"),
        F.when((n >= 5) & F.lit(base != 0), F.col("w5") / F.lit(base) * 100),
        F.when((n >= 20) & F.lit(base != 0), F.col("w20") / F.lit(base) * 100),
        F.when(n > 2, F.col("skew")), F.when(n > 3, F.col("kurt")),
        F.when(has, F.coalesce(F.col("avg_win"), F.lit(0.0))),
        F.when(has, F.coalesce(F.col("avg_loss"), F.lit(0.0))),
        total_pct,
        F.when(has & F.lit(ann > 0), (F.pow(1 + total_pct / 100, F.lit(float(ann)) / n) - 1) * 100),
    ]
    return _stat_rows(m, PNL_STAT_NAMES, values, group_cols, lambda v: finite_or_null(v))


def pnl_statistics_notebook(df: DataFrame, pnl_col: str, params: AnalysisParams = AnalysisParams(),
                            order_by: Sequence[str] = ("date",), group_cols: Sequence[str] = ()) -> DataFrame:
    """The notebook's variant (CAGR from a 1e6 start, fixed 252 annualisation).

    Worst n-day rows are null when fewer than n values exist; NaN becomes null.
    """
    m = _pnl_moments(df, pnl_col, order_by, group_cols)
    n, mean, std = F.col("n"), F.col("mean"), F.col("std")
    base, ann = float(params.portfolio_base), params.annualization
    has = n > 0
    cagr = F.when(has, ((F.col("total") + F.lit(1e6)) / F.lit(1e6) - 1) * 100)
    values = [
        mean, std,
        sharpe(mean, std, n, params.risk_free_daily, ann, min_n=1),
        F.when(has, F.col("wins") / n * 100),
        F.col("max"), F.col("min"),
        F.when(n >= 5, F.try_divide(F.col("w5"), F.lit(base)) * 100),
        F.when(n >= 20, F.try_divide(F.col("w20"), F.lit(base)) * 100),
        F.when(n > 2, F.col("skew")), F.when(n > 3, F.col("kurt")),
        F.when(has, F.coalesce(F.col("avg_win"), F.lit(0.0))),
        F.when(has, F.coalesce(F.col("avg_loss"), F.lit(0.0))),
        cagr,
        F.when(has, (F.pow(1 + cagr / 100, F.lit(252.0) / n) - 1) * 100),
    ]
    return _stat_rows(m, NOTEBOOK_STAT_NAMES, values, group_cols, lambda v: F.when(~F.isnan(v), v))


def _stat_rows(m: DataFrame, names, values, group_cols, clean) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(nm).alias("Statistic"), clean(val.cast("double")).alias("Value"))
                     for nm, val in zip(names, values)])
    return m.where(F.col("n_rows") > 0).select(*group_cols, F.inline(rows))


def pnl_statistics_by_source(df: DataFrame, pnl_cols: Sequence[str], params: AnalysisParams = AnalysisParams(),
                             order_by: Sequence[str] = ("date",), group_cols: Sequence[str] = ()) -> DataFrame:
    """The PnL report for several PnL columns, tagged with ``PnL Source``."""
    present = [p for p in pnl_cols if p in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "Statistic string, Value double, `PnL Source` string")
    long = df.select(*group_cols, *order_by, *[c(p) for p in present]).unpivot(
        [*group_cols, *order_by], present, "PnL Source", "_pnl")
    return pnl_statistics(long, "_pnl", params, order_by, [*group_cols, "PnL Source"])
