"""Full analysis (C10) and the report notebook's tables (C11).

The backtest is stored once in the shared checkpoint folder and every
report reads the columns that it needs, so the straddle / feature / signal pipeline runs once no
matter how many reports follow, and a lost executor does not replay it.

Every chart of the reference is the table behind it.  ``long_table`` lays all tables of a report out as one
typed table, so a whole report is one query's result and one file's content.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thetaflow.functions.columns import c
from thetaflow.operators import regimes, series, stats
from thetaflow.params import AnalysisParams
from thetaflow.session import stored


@dataclass(frozen=True)
class Charts:
    """Which columns the chart tables of a full analysis are made of; an empty choice makes no table."""

    timeseries: Sequence[str] = ()
    histograms: Sequence[str] = ()
    histogram_limit: float | None = None
    pnl_bars: Sequence[str] = ()
    pnl_periods: Sequence[str] = ("daily", "weekly", "monthly")
    semesters: Sequence[str] = ()
    signal_deciles: Sequence[str] = ()
    column_deciles: Sequence[str] = ()
    fixed_bins: Sequence[str] = ()
    acf: Sequence[str] = ()
    signals: Sequence[str] = ("ret_uprc_signal",)


def chart_tables(df: DataFrame, charts: Charts, params: AnalysisParams = AnalysisParams(),
                 group_cols: Sequence[str] = (), series_keys: Sequence[str] = ("securityid",)) -> dict[str, DataFrame]:
    """The tables behind the charts, by name; a column that ``df`` lacks gives no table."""
    g, out = list(group_cols), {}

    def present(names):
        return [n for n in names if n in df.columns]

    for col in present(charts.timeseries):
        out[f"timeseries:{col}"] = df.select(*series_keys, "date", c(col))
    for col in present(charts.histograms):
        out[f"histogram:{col}"] = series.histogram(df, col, limit=charts.histogram_limit, group_cols=g)
        out[f"kde:{col}"] = series.kde_curve(df, col, limit=charts.histogram_limit, group_cols=g)
    for col in present(charts.pnl_bars):
        for period in charts.pnl_periods:
            out[f"pnl_{period}:{col}"] = daily_pnl(df, col, g) if period == "daily" else series.period_pnl(df, col, period, group_cols=g)
    for col in present(charts.semesters):
        out[f"pnl_semester:{col}"] = series.semester_periods(df, col, group_cols=g)
    if present(charts.signal_deciles):
        out["sharpe_by_signal_decile"] = regimes.sharpe_by_decile(df, present(charts.signal_deciles), None, params, g)
    if present(charts.column_deciles):
        out["sharpe_by_column_decile"] = regimes.sharpe_by_decile(df, list(charts.signals), present(charts.column_deciles), params, g)
    if present(charts.fixed_bins):
        out["sharpe_by_fixed_bin"] = regimes.sharpe_by_fixed_bin(df, list(charts.signals), present(charts.fixed_bins), params, g)
    if present(charts.acf):
        out["autocorrelation"] = series.autocorrelation(df, present(charts.acf), params, series_keys=series_keys)
    return out


def daily_pnl(df: DataFrame, col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """PnL by day."""
    return df.where(F.col("date").isNotNull() & c(col).isNotNull()).groupBy(*group_cols, "date").agg(F.sum(c(col)).alias(col))


def full_analysis(df: DataFrame, stats_cols: Sequence[str] | None = None,
                  corr_cols: Sequence[str] | None = None, corr_method: str = "pearson",
                  pnl_stat_cols: Sequence[str] | None = None, params: AnalysisParams = AnalysisParams(),
                  group_cols: Sequence[str] = (), checkpoint: bool = True, charts: Charts = Charts()) -> dict[str, DataFrame]:
    """``descriptive_stats``, ``correlation_matrix``, ``pnl_statistics`` and the tables of ``charts``.

    A report that is not requested is an empty frame, as in the reference.
    """
    spark = df.sparkSession
    base = stored(df, "analysis") if checkpoint else df
    empty = spark.createDataFrame([], "column string")
    out = {
        "descriptive_stats": stats.describe(base, stats_cols, params, group_cols) if stats_cols is not None else empty,
        "correlation_matrix": (stats.correlation_matrix(base, corr_cols, corr_method, group_cols)
                               if corr_cols is not None else empty),
        "pnl_statistics": (stats.pnl_statistics_by_source(base, pnl_stat_cols, params, group_cols=group_cols)
                           if pnl_stat_cols else spark.createDataFrame([], "Statistic string, Value double")),
    }
    return out | chart_tables(base, charts, params, group_cols)


def strategy_report(backtest_df: DataFrame, signal_base: str = "ret_uprc_signal",
                    vol_cols: Sequence[str] = ("VIX", "VVIX", "VIX_TS"),
                    zscore_cols: Sequence[str] = ("VIX_ewma_hl_5_zscore", "VVIX_ewma_hl_5_zscore",
                                                  "VIX_TS_ewma_hl_5_zscore"),
                    params: AnalysisParams = AnalysisParams(), checkpoint: bool = True,
                    group_cols: Sequence[str] = ()) -> dict[str, DataFrame]:
    """C11: the tables behind every chart and statistic of the report notebook.

    ``group_cols=("securityid",)`` makes the statistics, distributions and regime tables per
    underlying when the backtest holds several.
    """
    bt = stored(backtest_df, "report") if checkpoint else backtest_df
    pnl, pos = f"{signal_base}_pnl", f"{signal_base}_pos"
    g = tuple(group_cols)
    return {
        "cumulative_total": bt.select("securityid", "date", f"{signal_base}_cum_pnl"),
        "cumulative_by_year": series.yearly_cumulative(bt, f"{signal_base}_cum_pnl"),
        "long_short_cumulative": series.long_short_cumulative(bt, signal_base),
        "pnl_stats_total": stats.pnl_statistics(bt, pnl, params, group_cols=g),
        "pnl_stats_short": stats.pnl_statistics(bt.where(F.col(pos) < 0), pnl, params, group_cols=g),
        "pnl_stats_long": stats.pnl_statistics(bt.where(F.col(pos) > 0), pnl, params, group_cols=g),
        "autocorrelation": series.autocorrelation(bt, [signal_base, pnl], params, series_keys=("securityid",)),
        "pnl_histogram": series.histogram(bt, pnl, group_cols=g),
        "pnl_kde": series.kde_curve(bt, pnl, group_cols=g),
        "signal_histogram": series.histogram(bt, signal_base, group_cols=g),
        "signal_kde": series.kde_curve(bt, signal_base, group_cols=g),
        "pnl_semesters": series.semester_periods(bt, pnl, group_cols=g),
        "pnl_daily": daily_pnl(bt, pnl, g),
        "pnl_weekly": series.period_pnl(bt, pnl, "weekly", group_cols=g),
        "sharpe_by_signal_decile": regimes.sharpe_by_decile(bt, [signal_base], None, params, g),
        "sharpe_by_vol_decile": regimes.sharpe_by_decile(bt, [signal_base], list(vol_cols), params, g),
        "sharpe_by_zscore_bin": regimes.sharpe_by_fixed_bin(bt, [signal_base], list(zscore_cols), params, g),
    }


#: Columns that say which row of its table a row is; the others are measures.
KEY_COLUMNS = (
    "securityid", "date", "year", "Statistic", "PnL Source", "column", "lag", "bin", "grid_index", "weekly_start_date",
    "monthly_start_date", "plot_year", "plot_semester", "min_date", "max_date", "signal_base", "side", "bucket", "decile",
    "DecileAxisLabel", "BinLabel",
)


def long_table(tables: dict[str, DataFrame], group_cols: Sequence[str] = ()) -> DataFrame:
    """All tables as rows ``(report, grp, key, measure, value)``.

    ``grp`` and ``key`` join the values of group and key columns by ``|`` (a null is empty), ``value`` is a
    double.  One row for each row and measure of a table; tables keep their own partial plans.
    """
    return reduce(DataFrame.unionAll, [_long_rows(name, df, group_cols) for name, df in tables.items()])


def _long_rows(name: str, df: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    def joined(names):
        return F.concat_ws("|", *[F.coalesce(c(n).cast("string"), F.lit("")) for n in names]) if names else F.lit("")

    groups = [n for n in df.columns if n in group_cols]
    keys = [n for n in df.columns if n in KEY_COLUMNS and n not in groups]
    measures = [n for n in df.columns if n not in groups and n not in keys]
    rows = df.select(joined(groups).alias("grp"), joined(keys).alias("key"), *[c(m).cast("double").alias(m) for m in measures])
    return rows.unpivot(["grp", "key"], measures, "measure", "value").select(F.lit(name).alias("report"), "grp", "key", "measure", "value")
