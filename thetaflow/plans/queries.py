"""Registered queries over the fixture market data derived from ``orders``.

Each builder takes ``(spark, sf_dir)``; the matching SQL is the DuckDB oracle.
Fixture runs use ``min_date = 1995-01-01`` because the derived data spans
1995-2001 (see FIXTURES.md).
"""

from __future__ import annotations

import datetime
import math
import threading
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thetaflow.operators import chain, features, regimes, series, signals, stats, vol
from thetaflow.params import AnalysisParams, FeatureParams, StraddleParams
from thetaflow.plans import dataset, report
from thetaflow.plans.oracle_fixtures import with_fixtures
from thetaflow.plans.registry import register
from thetaflow.session import stored
from thetaflow.sources.fixtures import fixture_catalog, materialize_fixtures

#: z-scores near zero come out of a cancellation.
ZSCORES = {f"{x}_ewma_hl_5_zscore": 9 for x in ("VIX", "VVIX", "VIX_TS")}

#: Dates that the fixture has, so that both rules cut rows.
EXCLUDED = (datetime.date(1996, 4, 22), datetime.date(1997, 3, 3))
FIXTURE_PARAMS = StraddleParams(underlyings=None, min_date=datetime.date(1995, 6, 1), date_problems=EXCLUDED)
ONE_UNDERLYING = StraddleParams(underlyings=(108105,), min_date=datetime.date(1995, 6, 1), date_problems=EXCLUDED)


def _market(spark, sf_dir, gappy=False):
    cat = fixture_catalog(spark, sf_dir, gappy=gappy)
    return cat.option_price(), cat.security_price()


def _prices(spark, sf_dir, gappy=False):
    return fixture_catalog(spark, sf_dir, gappy=gappy, options=False).security_price()


# ---------------------------------------------------------------- chain

CHAIN_CTES = """
base AS (
  SELECT o.securityid, o.callput AS okey_cp, o.strike, o.date, o.expiration,
         (o.bestbid + o.bestoffer)/2 AS sprc, p.closeprice AS uprc
  FROM option_price o JOIN security_price p ON o.securityid = p.securityid AND o.date = p.date
  WHERE o.date >= DATE '1995-06-01'),
tte AS (SELECT securityid, okey_cp, strike, date, expiration, sprc, uprc,
        strike * CAST(0.001 AS DOUBLE) AS okey_xx,
        CAST(expiration - date AS INTEGER) AS time_to_expiration FROM base),
open_ranked AS (SELECT *, ABS(okey_xx - uprc) AS dist_to_strike,
        ROW_NUMBER() OVER (PARTITION BY securityid, date, okey_cp
          ORDER BY ABS(okey_xx - uprc) NULLS FIRST, time_to_expiration NULLS FIRST,
                   strike NULLS FIRST, sprc NULLS FIRST) AS rn
        FROM tte WHERE time_to_expiration > 0),
open_legs AS (SELECT securityid, date, okey_cp, okey_xx, expiration, sprc, uprc,
        time_to_expiration, dist_to_strike FROM open_ranked WHERE rn = 1),
close_legs AS (SELECT securityid, okey_cp, okey_xx, date, expiration, sprc, uprc, time_to_expiration
        FROM tte WHERE time_to_expiration < 1),
paired AS (
  SELECT o.securityid, o.date, o.okey_cp, o.okey_xx, o.expiration, o.sprc AS sprc_day_0,
         o.uprc AS uprc_day_0, o.dist_to_strike, c.sprc AS sprc_day_1, c.uprc AS uprc_day_1
  FROM open_legs o LEFT JOIN close_legs c
    ON o.securityid = c.securityid AND o.okey_cp = c.okey_cp AND o.okey_xx = c.okey_xx
   AND o.expiration = c.date),
merged AS (SELECT DISTINCT * FROM paired
  WHERE date NOT IN (DATE '1996-04-22', DATE '1997-03-03')
    AND securityid IS NOT NULL AND date IS NOT NULL AND okey_cp IS NOT NULL AND okey_xx IS NOT NULL
    AND expiration IS NOT NULL AND sprc_day_0 IS NOT NULL AND uprc_day_0 IS NOT NULL
    AND dist_to_strike IS NOT NULL AND sprc_day_1 IS NOT NULL AND uprc_day_1 IS NOT NULL),
pivoted AS (
  SELECT securityid, date, okey_xx, uprc_day_0, expiration, dist_to_strike, uprc_day_1,
    MAX(CASE WHEN okey_cp = 'C' THEN sprc_day_0 END) AS sprc_day_0_C,
    MAX(CASE WHEN okey_cp = 'P' THEN sprc_day_0 END) AS sprc_day_0_P,
    MAX(CASE WHEN okey_cp = 'C' THEN sprc_day_1 END) AS sprc_day_1_C,
    MAX(CASE WHEN okey_cp = 'P' THEN sprc_day_1 END) AS sprc_day_1_P
  FROM merged GROUP BY securityid, date, okey_xx, uprc_day_0, expiration, dist_to_strike, uprc_day_1),
straddles AS (
  SELECT *, sprc_day_0_C + sprc_day_0_P AS straddle_day_0, sprc_day_1_C + sprc_day_1_P AS straddle_day_1,
         ABS(uprc_day_1 - okey_xx) AS uprc_diff
  FROM pivoted WHERE sprc_day_0_C IS NOT NULL AND sprc_day_0_P IS NOT NULL
    AND sprc_day_1_C IS NOT NULL AND sprc_day_1_P IS NOT NULL)"""

@register("base_chain", with_fixtures(CHAIN_CTES, "SELECT securityid, okey_cp, strike AS okey_xx, date, "
                                                 "expiration, sprc, uprc FROM base"),
          exact=("securityid", "okey_cp", "okey_xx", "date", "expiration"))
def q_base_chain(spark, sf_dir):
    return chain.base_chain(*_market(spark, sf_dir), FIXTURE_PARAMS).drop("strike")


@register("base_chain_one_id", with_fixtures(CHAIN_CTES, "SELECT securityid, okey_cp, strike AS okey_xx, date, "
                                                        "expiration, sprc, uprc FROM base WHERE securityid = 108105"),
          exact=("securityid", "okey_cp", "okey_xx", "date", "expiration"))
def q_base_chain_one_id(spark, sf_dir):
    return chain.base_chain(*_market(spark, sf_dir), ONE_UNDERLYING).drop("strike")


@register("base_chain_by_table", with_fixtures(CHAIN_CTES, "SELECT securityid, okey_cp, strike AS okey_xx, date, "
                                                          "expiration, sprc, uprc FROM base WHERE securityid IN "
                                                          "(SELECT 200000 + s_suppkey FROM supplier WHERE s_nationkey < 12)"),
          exact=("securityid", "okey_cp", "okey_xx", "date", "expiration"))
def q_base_chain_by_table(spark, sf_dir):
    """The ids come from a table: the underlyings of suppliers of the first nations."""
    options, prices = _market(spark, sf_dir)
    ids = (spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey < 12")
           .select((F.col("s_suppkey") + 200000).alias("securityid")))
    return chain.base_chain(chain.of_ids(options, ids), prices, FIXTURE_PARAMS).drop("strike")


@register("open_legs", with_fixtures(CHAIN_CTES, "SELECT * FROM open_legs"),
          exact=("securityid", "date", "okey_cp", "expiration", "time_to_expiration"))
def q_open_legs(spark, sf_dir):
    return chain.open_legs(*_market(spark, sf_dir), FIXTURE_PARAMS)


@register("close_legs", with_fixtures(CHAIN_CTES, "SELECT * FROM close_legs"),
          exact=("securityid", "date", "okey_cp", "expiration", "time_to_expiration"))
def q_close_legs(spark, sf_dir):
    return chain.close_legs(*_market(spark, sf_dir), FIXTURE_PARAMS)


@register("merged_legs", with_fixtures(CHAIN_CTES, "SELECT * FROM merged"),
          exact=("securityid", "date", "okey_cp", "expiration"))
def q_merged_legs(spark, sf_dir):
    return chain.merge_legs(*_market(spark, sf_dir), FIXTURE_PARAMS)


@register("straddles", with_fixtures(CHAIN_CTES, "SELECT * FROM straddles"))
def q_straddles(spark, sf_dir):
    return chain.straddles(*_market(spark, sf_dir), FIXTURE_PARAMS)


# ------------------------------------------------- volatility, returns, features

def vol_ctes(px: str = "security_price") -> str:
    """Reference formulation: one frame per index, full outer joins on date."""
    one = ("v_{n} AS (SELECT date, (bidlow + askhigh)/2 AS {n} FROM {px} "
           "WHERE securityid = {sid} AND (bidlow + askhigh)/2 IS NOT NULL)")
    parts = [one.format(n=n, sid=sid, px=px) for sid, n in ((117801, "VIX"), (152892, "VVIX"), (145764, "VIXM"))]
    return ",\n".join(parts) + """,
vol AS (SELECT date, MIN(VIX) AS VIX, MIN(VVIX) AS VVIX, MIN(VIXM) AS VIXM
        FROM v_VIX FULL JOIN v_VVIX USING (date) FULL JOIN v_VIXM USING (date) GROUP BY date),
vol_ts AS (SELECT *, CASE WHEN VIX IS NOT NULL AND VIX <> 0 THEN VIXM / VIX END AS VIX_TS FROM vol)"""


def ewma_ctes(src: str = "vol_ts", cols=("VIX", "VVIX", "VIX_TS"), h: int = 5, span: int = 300) -> str:
    """EWMA as a band self-join over the row index (``j`` in ``[i-span, i]``)."""
    w = f"POW(CAST(2 AS DOUBLE), (b.i - a.i) / CAST({h} AS DOUBLE))"
    exprs = ",\n   ".join(
        f"CASE WHEN ANY_VALUE(a.{c}) IS NOT NULL THEN SUM({w} * b.{c}) / "
        f"SUM(CASE WHEN b.{c} IS NOT NULL THEN {w} END) END AS {c}_ewma_hl_{h}" for c in cols)
    return f"""vi AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date) AS i FROM {src}),
ew AS (SELECT a.i,
   {exprs}
  FROM vi a JOIN vi b ON b.i BETWEEN a.i - {span} AND a.i GROUP BY a.i),
vol_ewma AS (SELECT vi.* EXCLUDE (i), ew.* EXCLUDE (i) FROM vi JOIN ew USING (i))"""


def zscore_ctes(cols=("VIX", "VVIX", "VIX_TS"), h: int = 5, n: int = 252) -> str:
    dev = ", ".join(f"{c} - {c}_ewma_hl_{h} AS d_{c}" for c in cols)
    zs = ",\n   ".join(
        f"CASE WHEN COUNT(d_{c}) OVER w = {n} AND STDDEV_SAMP(d_{c}) OVER w <> 0 "
        f"THEN (d_{c} - AVG(d_{c}) OVER w) / STDDEV_SAMP(d_{c}) OVER w END AS {c}_ewma_hl_{h}_zscore"
        for c in cols)
    drop = ", ".join([f"d_{c}" for c in cols] + [f"{c}_ewma_hl_{h}" for c in cols])
    return f"""dev AS (SELECT *, {dev} FROM vol_ewma),
zraw AS (SELECT *,
   {zs}
  FROM dev WINDOW w AS (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
vol_z AS (SELECT * EXCLUDE ({drop}) FROM zraw)"""


def returns_ctes(px: str = "security_price") -> str:
    return f"""r_px AS (SELECT securityid, date, closeprice FROM {px}),
r_1 AS (SELECT securityid, date, closeprice,
        LN(closeprice) - LAG(LN(closeprice)) OVER (PARTITION BY securityid ORDER BY date, closeprice) AS ret
        FROM r_px),
r_2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY securityid, date ORDER BY closeprice) AS rn
        FROM r_1 WHERE ret IS NOT NULL),
rets AS (SELECT securityid, date, ret FROM r_2 WHERE rn = 1)"""


def _vol_all(px="security_price", n=252):
    return ",\n".join([vol_ctes(px), ewma_ctes(), zscore_ctes(n=n)])


@register("vol_table", with_fixtures(vol_ctes(), "SELECT date, VIX, VVIX, VIXM, VIX_TS FROM vol_ts"),
          exact=("date",))
def q_vol_table(spark, sf_dir):
    return vol.vol_table(_prices(spark, sf_dir))


@register("vol_term_structure", with_fixtures(vol_ctes(), "SELECT date, VIX_TS FROM vol_ts"), exact=("date",))
def q_vol_term_structure(spark, sf_dir):
    return vol.vol_table(_prices(spark, sf_dir)).select("date", "VIX_TS")


@register("vol_ewma", with_fixtures(",\n".join([vol_ctes(), ewma_ctes()]), "SELECT * FROM vol_ewma"),
          exact=("date",))
def q_vol_ewma(spark, sf_dir):
    return features.add_vol_ewma(vol.vol_table(_prices(spark, sf_dir)))


@register("vol_zscore", with_fixtures(_vol_all(), "SELECT * FROM vol_z"), exact=("date",), decimals=ZSCORES)
def q_vol_zscore(spark, sf_dir):
    return features.add_vol_zscore(vol.vol_table(_prices(spark, sf_dir)))


@register("vol_zscore_gappy", with_fixtures(_vol_all("security_price_gappy", 10), "SELECT * FROM vol_z",
                                            gappy=True), exact=("date",), decimals=ZSCORES)
def q_vol_zscore_gappy(spark, sf_dir):
    prices = _market(spark, sf_dir, gappy=True)[1]
    return features.add_vol_zscore(vol.vol_table(prices), FeatureParams(zscore_window=10))


@register("log_returns", with_fixtures(returns_ctes(), "SELECT * FROM rets"))
def q_log_returns(spark, sf_dir):
    return features.log_returns(_prices(spark, sf_dir), FIXTURE_PARAMS)


# --------------------------------------------------- dataset, signals, backtest

DATASET_CTES = ",\n".join([CHAIN_CTES.strip(), _vol_all(), returns_ctes(), """dataset AS (
  SELECT * FROM straddles LEFT JOIN vol_z USING (date) LEFT JOIN rets USING (securityid, date))"""])


def signal_ctes(src: str = "dataset", fold: bool = False, guard: bool = True, weight_first: bool = False,
                d0="straddle_day_0", d1="straddle_day_1") -> str:
    lags, weights = (1, 2, 3), (0.6, 0.3, 0.1)
    cond = f"CASE WHEN {d0} <> 0 THEN " if guard else "CASE WHEN TRUE THEN "
    rets = (f"{cond}({d0} - {d1}) / NULLIF({d0}, 0) END AS ret_sprc, "
            f"{cond}({d0} - ABS(uprc_diff)) / NULLIF({d0}, 0) END AS ret_uprc")
    lag_sql = ", ".join(f"LAG({b}, {k}) OVER w AS {b}_lag_{k}" for b in ("ret_sprc", "ret_uprc") for k in lags)

    def wexpr(b, k, wt):
        return (f"CAST({wt} AS DOUBLE) * {b}_lag_{k}" if weight_first else f"{b}_lag_{k} * CAST({wt} AS DOUBLE)")

    wsql = ", ".join(f'{wexpr(b, k, wt)} AS "{b}_lag_{k}_{wt}"'
                     for b in ("ret_sprc", "ret_uprc") for k, wt in zip(lags, weights))

    def sig(b):
        terms = [f'"{b}_lag_{k}_{wt}"' for k, wt in zip(lags, weights)]
        if fold:
            return "CAST(0 AS DOUBLE) + " + " + ".join(terms)
        return " + ".join(f"COALESCE({t}, CAST(0 AS DOUBLE))" for t in terms)

    return f"""s_ret AS (SELECT *, {rets} FROM {src}),
s_lag AS (SELECT *, {lag_sql} FROM s_ret WINDOW w AS (PARTITION BY securityid ORDER BY date)),
s_w AS (SELECT *, {wsql} FROM s_lag),
s_sig AS (SELECT *, {sig('ret_sprc')} AS ret_sprc_signal, {sig('ret_uprc')} AS ret_uprc_signal FROM s_w)"""


SIGNALS_CTES = DATASET_CTES + ",\n" + signal_ctes() + """,
signals AS (SELECT * FROM s_sig WHERE COLUMNS(*) IS NOT NULL)"""

BACKTEST_CTES = SIGNALS_CTES + """,
b_cap AS (SELECT *, ret_sprc_signal * CAST(50000.0 AS DOUBLE) AS ret_sprc_signal_capital,
                    ret_uprc_signal * CAST(50000.0 AS DOUBLE) AS ret_uprc_signal_capital FROM signals),
b_pos AS (SELECT *,
   CASE WHEN straddle_day_0 IS NOT NULL AND straddle_day_0 <> 0 THEN ret_sprc_signal_capital / straddle_day_0
        ELSE CAST(0 AS DOUBLE) END AS ret_sprc_signal_pos,
   CASE WHEN straddle_day_0 IS NOT NULL AND straddle_day_0 <> 0 THEN ret_uprc_signal_capital / straddle_day_0
        ELSE CAST(0 AS DOUBLE) END AS ret_uprc_signal_pos FROM b_cap),
b_pnl AS (SELECT *, ret_sprc_signal_pos * (straddle_day_1 - straddle_day_0) AS ret_sprc_signal_pnl,
                    ret_uprc_signal_pos * (uprc_diff - straddle_day_0) AS ret_uprc_signal_pnl FROM b_pos),
backtest AS (SELECT *,
   CASE WHEN ret_sprc_signal_pnl IS NOT NULL THEN SUM(ret_sprc_signal_pnl) OVER w END AS ret_sprc_signal_cum_pnl,
   CASE WHEN ret_uprc_signal_pnl IS NOT NULL THEN SUM(ret_uprc_signal_pnl) OVER w END AS ret_uprc_signal_cum_pnl
  FROM b_pnl WINDOW w AS (PARTITION BY securityid ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

LEGACY_CTES = CHAIN_CTES + """,
legacy AS (SELECT securityid, date, okey_xx, uprc_day_0 AS open_uprc, expiration, dist_to_strike,
   uprc_day_1 AS close_uprc, sprc_day_0_C AS open_sprc_C, sprc_day_0_P AS open_sprc_P,
   sprc_day_1_C AS close_sprc_C, sprc_day_1_P AS close_sprc_P, straddle_day_0 AS open_straddle,
   straddle_day_1 AS close_straddle, uprc_diff FROM straddles),
""" + signal_ctes("legacy", fold=True, guard=False, weight_first=True, d0="open_straddle", d1="close_straddle") + """,
l_pnl AS (SELECT *,
   ret_sprc_signal * (close_straddle - open_straddle) * CAST(1000000.0 AS DOUBLE) * CAST(0.05 AS DOUBLE) / NULLIF(open_straddle, 0) AS ret_sprc_signal_pnl,
   ret_uprc_signal * (uprc_diff - open_straddle) * CAST(1000000.0 AS DOUBLE) * CAST(0.05 AS DOUBLE) / NULLIF(open_straddle, 0) AS ret_uprc_signal_pnl
  FROM s_sig),
legacy_bt AS (SELECT *,
   CASE WHEN ret_sprc_signal_pnl IS NOT NULL THEN SUM(ret_sprc_signal_pnl) OVER w END AS ret_sprc_signal_pnl_cumsum,
   CASE WHEN ret_uprc_signal_pnl IS NOT NULL THEN SUM(ret_uprc_signal_pnl) OVER w END AS ret_uprc_signal_pnl_cumsum
  FROM l_pnl WINDOW w AS (PARTITION BY securityid ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _dataset(spark, sf_dir):
    return dataset.dataset_1dte(*_market(spark, sf_dir), FIXTURE_PARAMS)


def _backtest(spark, sf_dir):
    return dataset.backtest_1dte(*_market(spark, sf_dir), FIXTURE_PARAMS)


_REPORT_INPUTS: dict[str, DataFrame] = {}
_REPORT_LOCK = threading.Lock()


def _report_input(spark, sf_dir):
    """The backtest that the analysis reports read, stored once (each report scans the columns
    that it needs).  It is kept for the derived market data that it comes from, which are written anew when
    the tables change."""
    root = str(sorted(materialize_fixtures(spark, sf_dir).items()))
    with _REPORT_LOCK:
        if root not in _REPORT_INPUTS:
            _REPORT_INPUTS[root] = stored(_backtest(spark, sf_dir), "backtest")
        return _REPORT_INPUTS[root]


@register("dataset_1dte_sorted", with_fixtures(DATASET_CTES, "SELECT * FROM dataset ORDER BY securityid NULLS FIRST, "
                                                           "date NULLS LAST"), decimals=ZSCORES)
def q_dataset_sorted(spark, sf_dir):
    return dataset.dataset_1dte(*_market(spark, sf_dir), FIXTURE_PARAMS, sort=True)


@register("dataset_1dte", with_fixtures(DATASET_CTES, "SELECT * FROM dataset"), decimals=ZSCORES)
def q_dataset(spark, sf_dir):
    return _dataset(spark, sf_dir)


@register("signals", with_fixtures(SIGNALS_CTES, "SELECT * FROM signals"), decimals=ZSCORES)
def q_signals(spark, sf_dir):
    return signals.generate_signals(_dataset(spark, sf_dir))


@register("signals_fold", with_fixtures(DATASET_CTES + ",\n" + signal_ctes(fold=True), "SELECT * FROM s_sig"), decimals=ZSCORES)
def q_signals_fold(spark, sf_dir):
    ds = signals.add_straddle_returns(_dataset(spark, sf_dir))
    return signals.add_signal_components(ds, fold=True)


@register("backtest", with_fixtures(BACKTEST_CTES, "SELECT * FROM backtest"), decimals=ZSCORES)
def q_backtest(spark, sf_dir):
    return _backtest(spark, sf_dir)


@register("backtest_legacy", with_fixtures(LEGACY_CTES, "SELECT * FROM legacy_bt"))
def q_backtest_legacy(spark, sf_dir):
    return dataset.legacy_backtest(*_market(spark, sf_dir), FIXTURE_PARAMS)


# ------------------------------------------------------------------ statistics

REPORT_COLS = ("straddle_day_0", "straddle_day_1", "uprc_diff", "ret_sprc", "ret_uprc", "ret_uprc_signal",
               "ret_uprc_signal_pnl", "VIX", "VVIX", "VIX_TS", "ret")
CORR_COLS = ("ret_uprc_signal", "ret_uprc_signal_pnl", "VIX", "VVIX", "VIX_TS", "ret")
PCTS = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)


def describe_sql(src: str, cols, group=()) -> str:
    g = "".join(f"{x}, " for x in group)
    union = "\n  UNION ALL ".join(f"SELECT {g}'{x}' AS \"column\", CAST({x} AS DOUBLE) AS value FROM {src}"
                                  for x in cols)
    qs = ", ".join(f"quantile_cont(value, {p}) AS p{int(p * 100)}" for p in PCTS)
    return f"""SELECT {g}"column", COUNT(value) AS count, COUNT(*) - COUNT(value) AS null_count,
  AVG(value) AS mean, STDDEV_SAMP(value) AS std, MIN(value) AS min, {qs}, MAX(value) AS max
FROM ({union}) AS u GROUP BY {g}"column\""""


def corr_sql(src: str, cols, spearman=False) -> str:
    nn = " AND ".join(f"{x} IS NOT NULL" for x in cols)
    sub = f"SELECT {', '.join(cols)} FROM {src} WHERE {nn}"
    if spearman:
        ranks = ", ".join(f"RANK() OVER (ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS {x}"
                          for x in cols)
        sub = f"SELECT {ranks} FROM ({sub}) AS s0"
    pr = ", ".join(f"COVAR_POP({a}, {b}) / NULLIF(STDDEV_POP({a}) * STDDEV_POP({b}), 0) AS c_{i}_{j}"
                   for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i)
    m = f"(SELECT {pr} FROM ({sub}) AS s) AS m"
    rows = []
    for i, a in enumerate(cols):
        cells = ", ".join(f"c_{min(i, j)}_{max(i, j)} AS {b}" for j, b in enumerate(cols))
        rows.append(f"SELECT '{a}' AS \"column\", {cells} FROM {m}")
    return "\nUNION ALL ".join(rows)


SQRT252 = repr(252 ** 0.5)


def pnl_stats_sql(src: str, pnl: str, where: str = "TRUE", notebook: bool = False, tag: str | None = None,
                  group: str | None = None) -> str:
    g, part, by = (f"{group}, ", f"PARTITION BY {group} ", f"GROUP BY {group}") if group else ("", "", "")
    n_rows = ("(SELECT COUNT(*) FROM p_src AS q WHERE q.{0} IS NOT DISTINCT FROM p_roll.{0})".format(group) if group
              else "(SELECT COUNT(*) FROM p_src)")
    agg = f"""WITH p_src AS (SELECT {g}date, SUM({pnl}) AS x FROM {src} WHERE {where} GROUP BY {g}date),
p_roll AS (SELECT {g}x, CASE WHEN COUNT(x) OVER w5 = 5 THEN SUM(x) OVER w5 END AS r5,
                  CASE WHEN COUNT(x) OVER w20 = 20 THEN SUM(x) OVER w20 END AS r20, AVG(x) OVER ({part}) AS mu
  FROM p_src WHERE x IS NOT NULL
  WINDOW w5 AS ({part}ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         w20 AS ({part}ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
a AS (SELECT {g}{n_rows} AS n_rows, COUNT(x) AS n, AVG(x) AS mean, STDDEV_SAMP(x) AS std,
  COUNT(*) FILTER (WHERE x > 0) AS wins, MAX(x) AS mx, MIN(x) AS mn, MIN(r5) AS w5, MIN(r20) AS w20,
  AVG(POW(x - mu, 3)) / NULLIF(POW(AVG(POW(x - mu, 2)), 1.5), 0) AS skew,
  AVG(POW(x - mu, 4)) / NULLIF(POW(AVG(POW(x - mu, 2)), 2), 0) - 3 AS kurt,
  AVG(x) FILTER (WHERE x > 0) AS avg_win, AVG(x) FILTER (WHERE x < 0) AS avg_loss, SUM(x) AS total
  FROM p_roll {by})"""
    sharpe = (f"CASE WHEN std IS NOT NULL AND std <> 0 THEN (mean - CAST(0.0 AS DOUBLE)) / std * {SQRT252} "
              f"WHEN mean = 0 AND (std IS NULL OR std = 0) THEN CAST(0.0 AS DOUBLE) END")
    total = "CASE WHEN n > 0 THEN total / CAST(1000000.0 AS DOUBLE) * 100 END"
    cagr = "CASE WHEN n > 0 THEN ((total + CAST(1000000.0 AS DOUBLE)) / CAST(1000000.0 AS DOUBLE) - 1) * 100 END"
    common = [
        ("mean",), ("std",), (sharpe,), ("CASE WHEN n > 0 THEN wins / n * 100 END",), ("mx",), ("mn",),
        ("CASE WHEN n >= 5 THEN w5 / CAST(1000000.0 AS DOUBLE) * 100 END",),
        ("CASE WHEN n >= 20 THEN w20 / CAST(1000000.0 AS DOUBLE) * 100 END",),
        ("CASE WHEN n > 2 THEN skew END",), ("CASE WHEN n > 3 THEN kurt END",),
        ("CASE WHEN n > 0 THEN COALESCE(avg_win, 0.0) END",), ("CASE WHEN n > 0 THEN COALESCE(avg_loss, 0.0) END",),
    ]
    if notebook:
        names = ("Mean Daily PnL ", "Std Dev Daily PnL", "Annualized Sharpe Ratio", "Win Rate", "Max Daily Win ",
                 "Max Daily Loss ", "Worst 5-Day Cumulative PnL %", "Worst 20-Day Cumulative PnL %", "Skewness",
                 "Kurtosis", "Average Win Amount", "Average Loss Amount", "CAGR %", "Annualized CAGR %")
        exprs = [e[0] for e in common] + [cagr, f"CASE WHEN n > 0 THEN (POW(1 + ({cagr}) / 100, 252.0 / n) - 1) * 100 END"]
        clean = "CASE WHEN NOT isnan(v) THEN v END"
    else:
        names = ("Mean Daily PnL", "Std Dev Daily PnL", "Annualized Sharpe Ratio", "Win Rate (%)", "Max Daily Win",
                 "Max Daily Loss", "Worst 5-Day Cum PnL (%)", "Worst 20-Day Cum PnL (%)", "Skewness", "Kurtosis",
                 "Average Win Amount", "Average Loss Amount", "Total Return (%) over Period",
                 "Annualized Total Return (%)")
        exprs = [e[0] for e in common] + [total, f"CASE WHEN n > 0 THEN (POW(1 + ({total}) / 100, 252.0 / n) - 1) * 100 END"]
        clean = "CASE WHEN isfinite(v) THEN v END"
    t = f", '{tag}' AS \"PnL Source\"" if tag else ""
    rows = "\nUNION ALL ".join(
        f"SELECT {g}'{nm}' AS Statistic, {clean.replace('v', f'CAST(({e}) AS DOUBLE)')} AS Value{t} FROM a WHERE n_rows > 0"
        for nm, e in zip(names, exprs))
    return agg + "\n" + rows


def _bt_sql(final: str) -> str:
    return with_fixtures(BACKTEST_CTES, final)


PNL = "ret_uprc_signal_pnl"
POS = "ret_uprc_signal_pos"


@register("describe_backtest", _bt_sql(describe_sql("backtest", REPORT_COLS)),
          exact=("column", "count", "null_count"))
def q_describe_report_input(spark, sf_dir):
    return stats.describe(_report_input(spark, sf_dir), REPORT_COLS)


@register("describe_prices", with_fixtures("", describe_sql("security_price", ("closeprice", "bidlow", "askhigh"),
                                                             ("securityid",))),
          exact=("securityid", "column", "count", "null_count"))
def q_describe_prices(spark, sf_dir):
    return stats.describe(_prices(spark, sf_dir), ("closeprice", "bidlow", "askhigh"),
                          group_cols=("securityid",))


#: A correlation near zero comes out of a cancellation too.
CORRELATIONS = {"*": 10}


@register("corr_pearson", _bt_sql(corr_sql("backtest", CORR_COLS)), exact=("column",), decimals=CORRELATIONS)
def q_corr_pearson(spark, sf_dir):
    return stats.correlation_matrix(_report_input(spark, sf_dir), CORR_COLS)


@register("corr_spearman", _bt_sql(corr_sql("backtest", CORR_COLS, spearman=True)), exact=("column",),
          decimals=CORRELATIONS)
def q_corr_spearman(spark, sf_dir):
    return stats.correlation_matrix(_report_input(spark, sf_dir), CORR_COLS, method="spearman")


def _stats_sql(**kw):
    inner = pnl_stats_sql("backtest", PNL, **kw)
    return with_fixtures(BACKTEST_CTES, f"SELECT * FROM ({inner}) AS r")


@register("pnl_stats", _stats_sql(), exact=("Statistic",))
def q_pnl_stats(spark, sf_dir):
    return stats.pnl_statistics(_report_input(spark, sf_dir), PNL)


@register("pnl_stats_long", _stats_sql(where=f"{POS} > 0"), exact=("Statistic",))
def q_pnl_stats_long(spark, sf_dir):
    return stats.pnl_statistics(_report_input(spark, sf_dir).where(F.col(POS) > 0), PNL)


@register("pnl_stats_short", _stats_sql(where=f"{POS} < 0"), exact=("Statistic",))
def q_pnl_stats_short(spark, sf_dir):
    return stats.pnl_statistics(_report_input(spark, sf_dir).where(F.col(POS) < 0), PNL)


@register("pnl_stats_notebook", _stats_sql(notebook=True), exact=("Statistic",))
def q_pnl_stats_notebook(spark, sf_dir):
    return stats.pnl_statistics_notebook(_report_input(spark, sf_dir), PNL)


@register("pnl_statistics_by_source", with_fixtures(
    BACKTEST_CTES, "SELECT * FROM (" + pnl_stats_sql("backtest", "ret_sprc_signal_pnl", tag="ret_sprc_signal_pnl")
    + ") AS r1 UNION ALL SELECT * FROM (" + pnl_stats_sql("backtest", PNL, tag=PNL) + ") AS r2"),
    exact=("Statistic", "PnL Source"))
def q_pnl_statistics_by_source(spark, sf_dir):
    return stats.pnl_statistics_by_source(_report_input(spark, sf_dir), ["ret_sprc_signal_pnl", PNL])


# ------------------------------------------------------------- regime tables

ZCOLS = ("VIX_ewma_hl_5_zscore", "VVIX_ewma_hl_5_zscore", "VIX_TS_ewma_hl_5_zscore")
SHARPE_SQL = (f"CASE WHEN n >= 2 THEN CASE WHEN std IS NOT NULL AND std <> 0 THEN (mean - CAST(0.0 AS DOUBLE)) / std * "
              f"{SQRT252} WHEN mean = 0 AND (std IS NULL OR std = 0) THEN CAST(0.0 AS DOUBLE) END END")


def regime_long_sql(cols, base="ret_uprc_signal", g: str = "") -> str:
    parts = [f"""SELECT {g}'{base}' AS signal_base, '{col}' AS "column",
  CASE WHEN {base}_pos > 0 THEN 'long' ELSE 'short' END AS side,
  CAST({col} AS DOUBLE) AS x, CAST({base}_pnl AS DOUBLE) AS pnl FROM backtest WHERE {base}_pos <> 0""" for col in cols]
    return "\nUNION ALL ".join(parts)


FIXED_BREAKS = [-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]
FIXED_LABELS = ("['<= -2.00', '(-2.00, -1.00]', '(-1.00, -0.50]', '(-0.50, 0.00]', '(0.00, 0.50]', '(0.50, 1.00]', "
                "'(1.00, 2.00]', '> 2.00']")


def regime_sql(cols, fixed=None, group: str = "") -> str:
    g = f"{group}, " if group else ""
    long = regime_long_sql(cols, g=g)
    if fixed is None:
        probs = ", ".join(repr(i / 10) for i in range(1, 10))
        bucketed = f"""SELECT l.*, CASE WHEN x IS NOT NULL THEN CAST(len(list_filter(breaks, lambda b: b < x)) + 1 AS INTEGER) END AS bucket
  FROM ({long}) AS l JOIN (SELECT {g}signal_base, "column", side, quantile_cont(x, [{probs}]) AS breaks
                          FROM ({long}) AS l0 GROUP BY {g}signal_base, "column", side) AS br
  USING ({g}signal_base, "column", side)"""
    else:
        arr = ", ".join(f"CAST({b!r} AS DOUBLE)" for b in fixed)
        bucketed = f"""SELECT l.*, CASE WHEN x IS NOT NULL THEN CAST(len(list_filter([{arr}], lambda b: b < x)) + 1 AS INTEGER) END AS bucket
  FROM ({long}) AS l"""
    stats_ = f"""SELECT {g}signal_base, "column", side, bucket, MIN(x) AS x_min, MAX(x) AS x_max, COUNT(pnl) AS n,
  AVG(pnl) AS mean, STDDEV_SAMP(pnl) AS std FROM ({bucketed}) AS b WHERE bucket IS NOT NULL
  GROUP BY {g}signal_base, "column", side, bucket"""
    if fixed is None:
        label = "'D' || bucket AS decile, printf('%.2f to %.2f', x_min, x_max) AS DecileAxisLabel"
    else:
        label = f"list_extract({FIXED_LABELS}, bucket) AS BinLabel"
    return f"""SELECT {g}signal_base, "column", side, bucket, {label}, sharpe AS SharpeRatio
FROM (SELECT *, {SHARPE_SQL} AS sharpe FROM ({stats_}) AS s) AS t WHERE sharpe IS NOT NULL"""


REGIME_EXACT = ("signal_base", "column", "side", "bucket", "decile", "DecileAxisLabel", "BinLabel")


@register("sharpe_by_signal_decile", _bt_sql(regime_sql(["ret_uprc_signal"])), exact=REGIME_EXACT)
def q_sharpe_by_signal_decile(spark, sf_dir):
    return regimes.sharpe_by_decile(_report_input(spark, sf_dir), ["ret_uprc_signal"])


@register("sharpe_by_signal_decile_ordered", "SELECT * FROM (" + _bt_sql(regime_sql(["ret_uprc_signal"])) + ")",
          exact=REGIME_EXACT)
def q_sharpe_by_signal_decile_ordered(spark, sf_dir):
    """By bucket number, so D10 comes after D9."""
    return (regimes.sharpe_by_decile(_report_input(spark, sf_dir), ["ret_uprc_signal"])
            .orderBy(*regimes.KEYS, "bucket"))


@register("sharpe_by_vol_decile", _bt_sql(regime_sql(["VIX", "VVIX", "VIX_TS"])), exact=REGIME_EXACT)
def q_sharpe_by_vol_decile(spark, sf_dir):
    return regimes.sharpe_by_decile(_report_input(spark, sf_dir), ["ret_uprc_signal"], ["VIX", "VVIX", "VIX_TS"])


@register("sharpe_by_fixed_bin", _bt_sql(regime_sql(list(ZCOLS), fixed=FIXED_BREAKS)),
          exact=REGIME_EXACT)
def q_sharpe_by_fixed_bin(spark, sf_dir):
    return regimes.sharpe_by_fixed_bin(_report_input(spark, sf_dir), ["ret_uprc_signal"], list(ZCOLS))


# ------------------------------------------------------------ series reports

@register("pnl_weekly", _bt_sql(f"SELECT CAST(date_trunc('week', date) AS DATE) AS weekly_start_date, SUM({PNL}) AS {PNL} "
                                f"FROM backtest WHERE date IS NOT NULL AND {PNL} IS NOT NULL GROUP BY 1"),
          exact=("weekly_start_date",))
def q_pnl_weekly(spark, sf_dir):
    return series.period_pnl(_report_input(spark, sf_dir), PNL, "weekly")


@register("pnl_monthly", _bt_sql(f"SELECT CAST(date_trunc('month', date) AS DATE) AS monthly_start_date, SUM({PNL}) AS {PNL} "
                                 f"FROM backtest WHERE date IS NOT NULL AND {PNL} IS NOT NULL GROUP BY 1"),
          exact=("monthly_start_date",))
def q_pnl_monthly(spark, sf_dir):
    return series.period_pnl(_report_input(spark, sf_dir), PNL, "monthly")


@register("pnl_semester", _bt_sql(f"""SELECT CAST(year(date) AS INTEGER) AS plot_year,
  CAST((month(date) - 1) // 6 + 1 AS INTEGER) AS plot_semester, MIN(date) AS min_date, MAX(date) AS max_date,
  COUNT(*) AS n_days, SUM({PNL}) AS {PNL}
FROM backtest WHERE date IS NOT NULL AND {PNL} IS NOT NULL GROUP BY 1, 2"""),
          exact=("plot_year", "plot_semester", "min_date", "max_date", "n_days"))
def q_pnl_semester(spark, sf_dir):
    return series.semester_periods(_report_input(spark, sf_dir), PNL)


@register("long_short_cum_pnl", _bt_sql(f"""SELECT securityid, date, ret_uprc_signal_cum_pnl,
  CASE WHEN {POS} > 0 THEN SUM({PNL}) OVER w END AS long_pnl_contribution,
  CASE WHEN {POS} < 0 THEN SUM({PNL}) OVER w END AS short_pnl_contribution
FROM backtest WINDOW w AS (PARTITION BY securityid, CASE WHEN {POS} > 0 THEN 'long' WHEN {POS} < 0 THEN 'short' END
  ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def q_long_short_cum_pnl(spark, sf_dir):
    return series.long_short_cumulative(_report_input(spark, sf_dir))


@register("yearly_cum_pnl", _bt_sql("""SELECT securityid, year, date,
  cum - FIRST_VALUE(cum) OVER (PARTITION BY securityid, year ORDER BY date) AS ret_uprc_signal_cum_pnl
FROM (SELECT securityid, date, ret_uprc_signal_cum_pnl AS cum, CAST(year(date) AS INTEGER) AS year,
        LEAST(make_date(CAST(year(date) AS INTEGER) + 1, 1, 1), MAX(date) OVER (PARTITION BY securityid)) AS e
      FROM backtest) AS y WHERE date < e"""), exact=("securityid", "year", "date"))
def q_yearly_cum_pnl(spark, sf_dir):
    return series.yearly_cumulative(_report_input(spark, sf_dir))


ACF_COLS = ("ret_uprc_signal", "ret_uprc_signal_pnl")
Z975 = repr(NormalDist().inv_cdf(0.975))


def acf_sql(cols=ACF_COLS, L=40) -> str:
    long = "\nUNION ALL ".join(f"SELECT securityid, '{x}' AS \"column\", date, CAST({x} AS DOUBLE) AS x FROM backtest "
                               f"WHERE {x} IS NOT NULL" for x in cols)
    lags = ", ".join(f"LAG(x, {i}) OVER w AS l{i}" for i in range(1, L + 1))
    corr = ", ".join(
        f"CASE WHEN COUNT(l{i}) >= 2 THEN COVAR_POP(x, l{i}) / NULLIF(STDDEV_POP(CASE WHEN l{i} IS NOT NULL THEN x END)"
        f" * STDDEV_POP(CASE WHEN x IS NOT NULL THEN l{i} END), 0) END AS a{i}" for i in range(1, L + 1))
    agg = (f"(SELECT securityid, \"column\", COUNT(x) AS n, {corr} FROM (SELECT securityid, \"column\", x, {lags} "
           f"FROM ({long}) AS l WINDOW w AS (PARTITION BY securityid, \"column\" ORDER BY date)) AS lg "
           f"GROUP BY securityid, \"column\") AS a")
    rows = [f"SELECT securityid, \"column\", 0 AS lag, CAST(1.0 AS DOUBLE) AS acf, {Z975} / sqrt(n) AS conf_band FROM {agg} "
            f"WHERE n >= {L + 1}"]
    rows += [f"SELECT securityid, \"column\", {i} AS lag, a{i} AS acf, {Z975} / sqrt(n) AS conf_band FROM {agg} "
             f"WHERE n >= {L + 1} AND a{i} IS NOT NULL AND NOT isnan(a{i})" for i in range(1, L + 1)]
    return "\nUNION ALL ".join(rows)


@register("acf", _bt_sql(acf_sql()), exact=("securityid", "column", "lag"), decimals={"acf": 10})
def q_acf(spark, sf_dir):
    return series.autocorrelation(_report_input(spark, sf_dir), ACF_COLS, series_keys=("securityid",))


def hist_sql(PNL: str = PNL, limit: float | None = None, group: str = "", every_bin: bool = False) -> str:
    g = f"{group}, " if group else ""
    grouped, parted, using = (f"GROUP BY {group}", f"PARTITION BY {group}", f"JOIN hs USING ({group})") if group else ("", "", "CROSS JOIN hs")
    cut = f" AND abs({PNL}) < {limit!r}" if limit is not None else ""
    edge = "CASE WHEN {i} >= nb THEN last ELSE first + {i} * step END"
    shaped = f"""SELECT *, (last - first) / nb AS step FROM (
    SELECT *, CAST(CASE WHEN width > 0 THEN ceil((last - first) / width) ELSE 1 END AS BIGINT) AS nb FROM (
     SELECT *, CASE WHEN fd > 0 THEN LEAST(fd, sturges) ELSE sturges END AS width FROM (
      SELECT {g}n, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS first, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS last,
        (hi - lo) / (log2(n) + 1.0) AS sturges, 2.0 * iqr * pow(n, {repr(-1.0 / 3.0)}) AS fd FROM (
       SELECT {g}CAST(COUNT(x) AS DOUBLE) AS n, MIN(x) AS lo, MAX(x) AS hi,
         quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM hv {grouped}) AS v1 WHERE n > 0) AS v2) AS v3) AS v4"""
    placed = f"""SELECT * FROM (WITH
hv AS (SELECT {g}CAST({PNL} AS DOUBLE) AS x FROM backtest WHERE {PNL} IS NOT NULL{cut}),
hs AS ({shaped}),
placed AS (SELECT *, CASE WHEN x >= ({edge.format(i="(i1 + 1)")}) AND i1 <> nb - 1 THEN i1 + 1 ELSE i1 END AS bin FROM (
  SELECT *, CASE WHEN x < ({edge.format(i="i0")}) THEN i0 - 1 ELSE i0 END AS i1 FROM (
    SELECT *, LEAST(GREATEST(CAST(floor((x - first) / (last - first) * nb) AS BIGINT), 0), nb - 1) AS i0
    FROM hv {using}) AS p0) AS p1)"""
    if every_bin:
        return placed + f""",
counted AS (SELECT bin, COUNT(*) AS k FROM placed GROUP BY bin),
every AS (SELECT hs.*, unnest(range(nb)) AS bin FROM hs WHERE n > 0)
SELECT bin, {edge.format(i="bin")} AS bin_start, {edge.format(i="(bin + 1)")} AS bin_end, COALESCE(k, 0) AS count,
  COALESCE(k, 0) / ({edge.format(i="(bin + 1)")} - {edge.format(i="bin")}) / n AS density
FROM every LEFT JOIN counted USING (bin)) AS h"""
    return placed + f""",
counted AS (SELECT {g}n, first, last, nb, step, bin, COUNT(*) AS count FROM placed GROUP BY {g}n, first, last, nb, step, bin),
followed AS (SELECT *, COALESCE(LEAD(bin) OVER ({parted} ORDER BY bin), nb) AS after FROM counted),
runs AS (SELECT {g}n, first, last, nb, step, bin, CAST(1 AS BIGINT) AS bins, count FROM followed
  UNION ALL SELECT {g}n, first, last, nb, step, bin + 1, after - bin - 1, 0 FROM followed WHERE after > bin + 1)
SELECT {g}bin, bins, {edge.format(i="bin")} AS bin_start, {edge.format(i="(bin + bins)")} AS bin_end, count,
  count / ({edge.format(i="(bin + bins)")} - {edge.format(i="bin")}) / n AS density FROM runs) AS h"""


@register("histogram", _bt_sql(hist_sql()), exact=("bin", "bins", "count"))
def q_histogram(spark, sf_dir):
    return series.histogram(_report_input(spark, sf_dir), PNL)


def kde_sql(col=PNL, grid=200, group: str = "") -> str:
    g0 = f"{group}, " if group else ""
    over = f"OVER (PARTITION BY {group})" if group else "OVER ()"
    grouped = f"GROUP BY {group}" if group else ""
    span = repr(1.0 / (grid - 1))
    g = lambda k: f"(lo + (hi - lo) * (CAST({k} AS DOUBLE) * {span}))"
    pts = ", ".join(f"AVG(exp(-0.5 * (({g(k)} - x) / bw) * (({g(k)} - x) / bw)))" for k in range(grid))
    xs = ", ".join(g(k) for k in range(grid))
    norm = repr(1.0 / math.sqrt(2 * math.pi))
    return f"""SELECT {g0}unnest(list_transform(range({grid}), lambda i: CAST(i AS INTEGER))) AS grid_index,
  unnest([{xs}]) AS x, unnest(list_transform(d, lambda v: CASE WHEN v >= 1e-12 * list_max(d) THEN v * {norm} / bw ELSE 0 END)) AS density
FROM (SELECT {g0}ANY_VALUE(lo) AS lo, ANY_VALUE(hi) AS hi, ANY_VALUE(bw) AS bw, [{pts}] AS d
      FROM (SELECT {g0}x, MIN(x) {over} AS lo, MAX(x) {over} AS hi,
                   STDDEV_SAMP(x) {over} * pow(CAST(COUNT(x) {over} AS DOUBLE), -0.2) AS bw
            FROM (SELECT {g0}CAST({col} AS DOUBLE) AS x FROM backtest WHERE {col} IS NOT NULL) AS v0) AS v
      WHERE bw > 0 {grouped}) AS k"""


@register("kde_curve", _bt_sql(kde_sql()), exact=("grid_index",))
def q_kde_curve(spark, sf_dir):
    return series.kde_curve(_report_input(spark, sf_dir), PNL)


@register("histogram_signal", _bt_sql(hist_sql("ret_uprc_signal")), exact=("bin", "bins", "count"))
def q_histogram_signal(spark, sf_dir):
    return series.histogram(_report_input(spark, sf_dir), "ret_uprc_signal")


@register("kde_signal", _bt_sql(kde_sql("ret_uprc_signal")), exact=("grid_index",))
def q_kde_signal(spark, sf_dir):
    return series.kde_curve(_report_input(spark, sf_dir), "ret_uprc_signal")


@register("pnl_stats_by_underlying", _bt_sql("SELECT * FROM (" + pnl_stats_sql("backtest", PNL, group="securityid") + ") AS r"),
          exact=("securityid", "Statistic"))
def q_pnl_stats_by_underlying(spark, sf_dir):
    return stats.pnl_statistics(_report_input(spark, sf_dir), PNL, group_cols=("securityid",))


@register("dataset_1dte_no_features", with_fixtures(CHAIN_CTES + ",\n" + vol_ctes(), """SELECT * FROM straddles
  LEFT JOIN vol_ts USING (date)"""))
def q_dataset_no_features(spark, sf_dir):
    return dataset.dataset_1dte(*_market(spark, sf_dir), FIXTURE_PARAMS, generate_features=False)


@register("histogram_limited", _bt_sql(hist_sql(PNL, 100000.0, every_bin=True)), exact=("bin", "count"))
def q_histogram_limited(spark, sf_dir):
    """One row for each bin, empty ones too."""
    return series.histogram(_report_input(spark, sf_dir), PNL, limit=100000.0, every_bin=True)


@register("vol_index_mid", with_fixtures("", "SELECT date, (bidlow + askhigh)/2 AS VIX FROM security_price "
                                             "WHERE securityid = 117801 AND (bidlow + askhigh)/2 IS NOT NULL"),
          exact=("date",))
def q_vol_index_mid(spark, sf_dir):
    return vol.index_mid(_prices(spark, sf_dir), 117801, "VIX")


@register("histogram_by_underlying", _bt_sql(hist_sql(group="securityid")), exact=("securityid", "bin", "bins", "count"))
def q_histogram_by_underlying(spark, sf_dir):
    return series.histogram(_report_input(spark, sf_dir), PNL, group_cols=("securityid",))


@register("kde_by_underlying", _bt_sql(kde_sql(group="securityid")), exact=("securityid", "grid_index"))
def q_kde_by_underlying(spark, sf_dir):
    return series.kde_curve(_report_input(spark, sf_dir), PNL, group_cols=("securityid",))


# ------------------------------------------------ whole reports (C10, C11) as long tables

REPORT_EXACT = ("report", "grp", "key", "measure")
#: Decimals that values near zero, which come out of a cancellation, are compared with.
REPORT_DECIMALS = {"correlation_matrix": 10, "autocorrelation": 10}


def _near_zero(df: DataFrame) -> DataFrame:
    cases = " ".join(f"WHEN report = '{r}' THEN CAST(replace(format_number(value, {d}), ',', '') AS DOUBLE)" for r, d in REPORT_DECIMALS.items())
    return df.withColumn("value", F.expr(f"CASE {cases} ELSE value END"))


def _part_sql(report_name: str, sql: str, keys, measures, group: str = "") -> str:
    """One table of a report as rows (report, grp, key, measure, value)."""
    def joined(names):
        return " || '|' || ".join(f"COALESCE(CAST(\"{n}\" AS VARCHAR), '')" for n in names) or "''"

    d = REPORT_DECIMALS.get(report_name)
    rows = []
    for m in measures:
        v = f'CAST("{m}" AS DOUBLE)'
        v = f"CAST(printf('%.{d}f', {v}) AS DOUBLE) + CAST(0.0 AS DOUBLE)" if d else v
        rows.append(f"SELECT '{report_name}' AS report, {joined([group] if group else [])} AS grp, {joined(keys)} AS key, "
                    f"'{m}' AS measure, {v} AS value FROM part")
    return f"SELECT * FROM (WITH part AS MATERIALIZED (SELECT * FROM ({sql}) AS p0) " + " UNION ALL ".join(rows) + ") AS p1"


REGIME_KEYS = ("signal_base", "column", "side", "bucket", "decile", "DecileAxisLabel")
BIN_KEYS = ("signal_base", "column", "side", "bucket", "BinLabel")
CUM = "ret_uprc_signal_cum_pnl"
BIN_MEASURES = ("bins", "bin_start", "bin_end", "count", "density")


def _period_sql(start: str, name: str, group: str = "", col: str = PNL) -> str:
    g = f"{group}, " if group else ""
    return (f"SELECT {g}CAST({start} AS DATE) AS {name}, SUM({col}) AS {col} FROM backtest "
            f"WHERE date IS NOT NULL AND {col} IS NOT NULL GROUP BY ALL")


def _semester_sql(group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"""SELECT {g}CAST(year(date) AS INTEGER) AS plot_year, CAST((month(date) - 1) // 6 + 1 AS INTEGER) AS plot_semester,
  MIN(date) AS min_date, MAX(date) AS max_date, COUNT(*) AS n_days, SUM({PNL}) AS {PNL}
FROM backtest WHERE date IS NOT NULL AND {PNL} IS NOT NULL GROUP BY ALL"""


_YEARLY_SQL = f"""SELECT securityid, year, date, cum - FIRST_VALUE(cum) OVER (PARTITION BY securityid, year ORDER BY date) AS {CUM}
FROM (SELECT securityid, date, {CUM} AS cum, CAST(year(date) AS INTEGER) AS year,
        LEAST(make_date(CAST(year(date) AS INTEGER) + 1, 1, 1), MAX(date) OVER (PARTITION BY securityid)) AS e
      FROM backtest) AS y WHERE date < e"""
_LONG_SHORT_SQL = f"""SELECT securityid, date, {CUM},
  CASE WHEN {POS} > 0 THEN SUM({PNL}) OVER w END AS long_pnl_contribution,
  CASE WHEN {POS} < 0 THEN SUM({PNL}) OVER w END AS short_pnl_contribution
FROM backtest WINDOW w AS (PARTITION BY securityid, CASE WHEN {POS} > 0 THEN 'long' WHEN {POS} < 0 THEN 'short' END
  ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_S = "securityid"
STRATEGY_PARTS = [
    ("cumulative_total", f"SELECT securityid, date, {CUM} FROM backtest", ("date",), (CUM,)),
    ("cumulative_by_year", _YEARLY_SQL, ("year", "date"), (CUM,)),
    ("long_short_cumulative", _LONG_SHORT_SQL, ("date",), (CUM, "long_pnl_contribution", "short_pnl_contribution")),
    ("pnl_stats_total", pnl_stats_sql("backtest", PNL, group=_S), ("Statistic",), ("Value",)),
    ("pnl_stats_short", pnl_stats_sql("backtest", PNL, where=f"{POS} < 0", group=_S), ("Statistic",), ("Value",)),
    ("pnl_stats_long", pnl_stats_sql("backtest", PNL, where=f"{POS} > 0", group=_S), ("Statistic",), ("Value",)),
    ("autocorrelation", acf_sql(), ("column", "lag"), ("acf", "conf_band")),
    ("pnl_histogram", hist_sql(group=_S), ("bin",), BIN_MEASURES),
    ("pnl_kde", kde_sql(group=_S), ("grid_index",), ("x", "density")),
    ("signal_histogram", hist_sql("ret_uprc_signal", group=_S), ("bin",), BIN_MEASURES),
    ("signal_kde", kde_sql("ret_uprc_signal", group=_S), ("grid_index",), ("x", "density")),
    ("pnl_semesters", _semester_sql(_S), ("plot_year", "plot_semester", "min_date", "max_date"), ("n_days", PNL)),
    ("pnl_daily", _period_sql("date", "date", _S), ("date",), (PNL,)),
    ("pnl_weekly", _period_sql("date_trunc('week', date)", "weekly_start_date", _S), ("weekly_start_date",), (PNL,)),
    ("sharpe_by_signal_decile", regime_sql(["ret_uprc_signal"], group=_S), REGIME_KEYS, ("SharpeRatio",)),
    ("sharpe_by_vol_decile", regime_sql(["VIX", "VVIX", "VIX_TS"], group=_S), REGIME_KEYS, ("SharpeRatio",)),
    ("sharpe_by_zscore_bin", regime_sql(list(ZCOLS), fixed=FIXED_BREAKS, group=_S), BIN_KEYS, ("SharpeRatio",)),
]


@register("strategy_report", _bt_sql("\nUNION ALL ".join(_part_sql(n, q, k, m, _S) for n, q, k, m in STRATEGY_PARTS)), exact=REPORT_EXACT)
def q_strategy_report(spark, sf_dir):
    tables = report.strategy_report(_report_input(spark, sf_dir), checkpoint=False, group_cols=("securityid",))
    return _near_zero(report.long_table(tables, ("securityid",)))


OTHER_PNL = "ret_sprc_signal_pnl"
ANALYSIS_CHARTS = report.Charts(
    timeseries=(CUM,), histograms=(PNL, "ret_uprc_signal"), pnl_bars=(PNL,), semesters=(PNL,), signal_deciles=("ret_uprc_signal",),
    column_deciles=("VIX", "VVIX", "VIX_TS"), fixed_bins=ZCOLS, acf=ACF_COLS)
ANALYSIS_PARTS = [
    ("descriptive_stats", describe_sql("backtest", REPORT_COLS), ("column",),
     ("count", "null_count", "mean", "std", "min", *[stats.percentile_name(p) for p in AnalysisParams().percentiles], "max")),
    ("correlation_matrix", corr_sql("backtest", CORR_COLS), ("column",), CORR_COLS),
    ("pnl_statistics", "SELECT * FROM (" + pnl_stats_sql("backtest", OTHER_PNL, tag=OTHER_PNL) + ") AS r1 UNION ALL SELECT * FROM ("
     + pnl_stats_sql("backtest", PNL, tag=PNL) + ") AS r2", ("PnL Source", "Statistic"), ("Value",)),
    (f"timeseries:{CUM}", f"SELECT securityid, date, {CUM} FROM backtest", ("securityid", "date"), (CUM,)),
    *[(f"histogram:{x}", hist_sql(x), ("bin",), BIN_MEASURES) for x in (PNL, "ret_uprc_signal")],
    *[(f"kde:{x}", kde_sql(x), ("grid_index",), ("x", "density")) for x in (PNL, "ret_uprc_signal")],
    (f"pnl_daily:{PNL}", _period_sql("date", "date"), ("date",), (PNL,)),
    (f"pnl_weekly:{PNL}", _period_sql("date_trunc('week', date)", "weekly_start_date"), ("weekly_start_date",), (PNL,)),
    (f"pnl_monthly:{PNL}", _period_sql("date_trunc('month', date)", "monthly_start_date"), ("monthly_start_date",), (PNL,)),
    (f"pnl_semester:{PNL}", _semester_sql(), ("plot_year", "plot_semester", "min_date", "max_date"), ("n_days", PNL)),
    ("sharpe_by_signal_decile", regime_sql(["ret_uprc_signal"]), REGIME_KEYS, ("SharpeRatio",)),
    ("sharpe_by_column_decile", regime_sql(["VIX", "VVIX", "VIX_TS"]), REGIME_KEYS, ("SharpeRatio",)),
    ("sharpe_by_fixed_bin", regime_sql(list(ZCOLS), fixed=FIXED_BREAKS), BIN_KEYS, ("SharpeRatio",)),
    ("autocorrelation", acf_sql(), ("securityid", "column", "lag"), ("acf", "conf_band")),
]


@register("full_analysis", _bt_sql("\nUNION ALL ".join(_part_sql(n, q, k, m) for n, q, k, m in ANALYSIS_PARTS)), exact=REPORT_EXACT)
def q_full_analysis(spark, sf_dir):
    tables = report.full_analysis(_report_input(spark, sf_dir), REPORT_COLS, CORR_COLS, "pearson", [OTHER_PNL, PNL],
                                  checkpoint=False, charts=ANALYSIS_CHARTS)
    return _near_zero(report.long_table(tables))
