"""Hand-written edge frames for the null, tie, zero and short-series rules."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thetaflow.operators import backtest, chain, features, regimes, series, signals, stats
from thetaflow.params import AnalysisParams, FeatureParams, StraddleParams
from thetaflow.sources import schemas

D = dt.date
P = StraddleParams(underlyings=(1,), min_date=D(2020, 1, 1), date_problems=(D(2020, 1, 9),))


def _prices(spark, rows):
    return spark.createDataFrame(rows, schemas.SECURITY_PRICE)


def _options(spark, rows):
    return spark.createDataFrame(rows, schemas.OPTION_PRICE)


def test_atm_tie_picks_lower_strike_for_both_legs(spark):
    px = _prices(spark, [(1, D(2020, 1, 2), 100.0, None, None), (1, D(2020, 1, 3), 101.0, None, None)])
    opts = []
    for cp in "CP":
        for k in (95_000, 105_000):  # equally far from 100
            opts.append((1, cp, k, D(2020, 1, 2), D(2020, 1, 3), 1.0, 2.0))
            opts.append((1, cp, k, D(2020, 1, 3), D(2020, 1, 3), 0.5, 0.7))
    st = chain.straddles(_options(spark, opts), px, P).collect()
    assert len(st) == 1 and st[0]["okey_xx"] == 95.0
    assert st[0]["straddle_day_0"] == 3.0 and abs(st[0]["straddle_day_1"] - 1.2) < 1e-12
    assert abs(st[0]["uprc_diff"] - 6.0) < 1e-12


def test_missing_put_leg_and_excluded_date_drop_the_day(spark):
    px = _prices(spark, [(1, D(2020, 1, 2), 100.0, None, None), (1, D(2020, 1, 3), 100.0, None, None),
                         (1, D(2020, 1, 9), 100.0, None, None), (1, D(2020, 1, 10), 100.0, None, None)])
    opts = [(1, "C", 100_000, D(2020, 1, 2), D(2020, 1, 3), 1.0, 2.0),  # call only
            (1, "C", 100_000, D(2020, 1, 3), D(2020, 1, 3), 0.1, 0.2)]
    for cp in "CP":  # full straddle on an excluded date
        opts += [(1, cp, 100_000, D(2020, 1, 9), D(2020, 1, 10), 1.0, 2.0),
                 (1, cp, 100_000, D(2020, 1, 10), D(2020, 1, 10), 0.1, 0.2)]
    assert chain.straddles(_options(spark, opts), px, P).count() == 0


def test_conflicting_duplicate_listing_raises(spark):
    px = _prices(spark, [(1, D(2020, 1, 2), 100.0, None, None), (1, D(2020, 1, 3), 100.0, None, None)])
    opts = []
    for cp in "CP":
        opts += [(1, cp, 100_000, D(2020, 1, 2), D(2020, 1, 3), 1.0, 2.0),
                 (1, cp, 100_000, D(2020, 1, 3), D(2020, 1, 3), 0.1, 0.2),
                 (1, cp, 100_000, D(2020, 1, 3), D(2020, 1, 2), 0.3, 0.4)]  # expired quote, other price
    with pytest.raises(Exception):
        chain.straddles(_options(spark, opts), px, P).collect()
    kept = chain.straddles(_options(spark, opts), px, P, on_conflict="min").collect()
    assert len(kept) == 1 and kept[0]["sprc_day_1_C"] == pytest.approx(0.15)


def test_catalog_errors_and_reuse(spark, tmp_path):
    from thetaflow.sources.catalog import Catalog
    cat = Catalog(spark)
    with pytest.raises(ValueError):
        cat.load("no_such_source")
    with pytest.raises(ValueError):
        cat.security_price()  # known source, no path registered
    cat = Catalog(spark, paths={"om_int_option_price": str(tmp_path / "missing")})
    with pytest.raises(FileNotFoundError):
        cat.option_price()
    path = str(tmp_path / "prices")
    _prices(spark, [(1, D(2020, 1, 2), 100.0, None, None)]).write.parquet(path)
    cat = Catalog(spark, paths={"om_int_security_price": path})
    assert cat.security_price() is cat.security_price()
    assert cat.security_price().count() == 1


def test_zero_open_price_gives_null_return_and_flat_position(spark):
    df = spark.createDataFrame(
        [(1, D(2020, 1, d), s0, 1.0, 2.0) for d, s0 in [(2, 2.0), (3, 0.0), (6, 4.0), (7, 2.0), (8, 5.0)]],
        "securityid int, date date, straddle_day_0 double, straddle_day_1 double, uprc_diff double")
    r = signals.add_straddle_returns(df).orderBy("date").collect()
    assert r[1]["ret_sprc"] is None and r[1]["ret_uprc"] is None
    comps = signals.add_signal_components(signals.add_straddle_returns(df))
    bt = backtest.generate_backtest(comps).orderBy("date").collect()
    assert bt[1]["ret_sprc_signal_pos"] == 0.0
    # null lag counts as 0 in the sum (row 2: lag1 = row 1 = null, lag2 = row 0)
    assert bt[2]["ret_sprc_signal"] == pytest.approx(0.3 * 0.5)


def test_cumulative_is_prefix_sum_and_null_stays_null(spark):
    df = spark.createDataFrame([(1, D(2020, 1, d), x) for d, x in [(1, 1.0), (2, None), (3, 2.5), (4, -1.0)]],
                               "securityid int, date date, x double")
    w = F.col("x")
    from thetaflow.functions.columns import series_window
    out = df.select("date", backtest.cumulative(w, series_window(["securityid"])).alias("cum")).orderBy("date")
    assert [r["cum"] for r in out.collect()] == [1.0, None, 3.5, 2.5]


def test_ewma_matches_recursion(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(20, 3, 700)
    x[[5, 6, 300]] = np.nan
    pdf = pd.DataFrame({"date": pd.date_range("2000-01-01", periods=700).date, "VIX": x})
    df = spark.createDataFrame(pdf.assign(VIX=pdf.VIX.astype(object).where(pdf.VIX.notna(), None)),
                               "date date, VIX double")
    got = features.add_vol_ewma(df, FeatureParams(vol_cols=("VIX",))).orderBy("date").toPandas()
    want = pd.Series(x).ewm(halflife=5, adjust=True, ignore_na=False).mean()
    mask = ~np.isnan(x)
    np.testing.assert_allclose(got["VIX_ewma_hl_5"].to_numpy(dtype=float)[mask], want.to_numpy()[mask], rtol=1e-12)
    assert got["VIX_ewma_hl_5"].isna().to_numpy()[~mask].all()


def test_ewma_long_series_crosses_chunks(spark):
    n = 9000  # several 4200-row chunks at half-life 5
    x = np.sin(np.arange(n) / 50.0) * 10 + 20
    pdf = pd.DataFrame({"date": pd.date_range("1970-01-01", periods=n).date, "VIX": x})
    df = spark.createDataFrame(pdf, "date date, VIX double")
    got = features.add_vol_ewma(df, FeatureParams(vol_cols=("VIX",))).orderBy("date").toPandas()
    want = pd.Series(x).ewm(halflife=5, adjust=True).mean().to_numpy()
    np.testing.assert_allclose(got["VIX_ewma_hl_5"].to_numpy(dtype=float), want, rtol=1e-12)


def _pnl(spark, values):
    return spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)],
                                 "date date, pnl double")


def _stats(spark, values):
    return {r["Statistic"]: r["Value"] for r in stats.pnl_statistics(_pnl(spark, values), "pnl").collect()}


def test_pnl_stats_edge_series(spark):
    empty = spark.createDataFrame([], "date date, pnl double")
    assert stats.pnl_statistics(empty, "pnl").count() == 0
    s = _stats(spark, [None, None])
    assert len(s) == 14 and all(v is None for v in s.values())
    s = _stats(spark, [0.0, 0.0, 0.0])
    assert s["Annualized Sharpe Ratio"] == 0.0 and s["Average Win Amount"] == 0.0
    s = _stats(spark, [5.0])
    assert s["Std Dev Daily PnL"] is None and s["Annualized Sharpe Ratio"] is None
    assert s["Worst 5-Day Cum PnL (%)"] is None
    s = _stats(spark, [-300_000.0] * 5)  # total loss above 100 %, 252/5 not integral: complex -> null
    assert s["Annualized Total Return (%)"] is None
    vals = [1.0, -2.0, 3.0, 4.0, -1.0, 2.0]
    s = _stats(spark, vals)
    a = np.array(vals)
    assert s["Mean Daily PnL"] == pytest.approx(a.mean())
    assert s["Std Dev Daily PnL"] == pytest.approx(a.std(ddof=1))
    assert s["Win Rate (%)"] == pytest.approx(100 * 4 / 6)
    assert s["Worst 5-Day Cum PnL (%)"] == pytest.approx(min(a[i:i + 5].sum() for i in range(2)) / 1e6 * 100)
    m = a - a.mean()
    assert s["Skewness"] == pytest.approx((m ** 3).mean() / (m ** 2).mean() ** 1.5)
    assert s["Kurtosis"] == pytest.approx((m ** 4).mean() / (m ** 2).mean() ** 2 - 3)


def test_correlation_constant_column_and_short_frame(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0)], "a double, b double, k double")
    m = {r["column"]: r for r in stats.correlation_matrix(df, ["a", "b", "k"]).collect()}
    assert m["a"]["a"] == pytest.approx(1.0) and m["a"]["k"] is None
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert all(r["b"] is None for r in stats.correlation_matrix(one, ["a", "b"]).collect())
    s = {r["column"]: r for r in stats.correlation_matrix(df, ["a", "b"], "spearman").collect()}
    assert s["a"]["b"] == pytest.approx(1.0)


def test_describe_ties_and_all_null(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (2.0, None), (10.0, None)], "x double, y double")
    r = {x["column"]: x for x in stats.describe(df, ["x", "y"]).collect()}
    assert r["x"]["p50"] == 2.0 and r["x"]["p75"] == pytest.approx(np.percentile([1, 2, 2, 10], 75))
    assert r["y"]["count"] == 0 and r["y"]["null_count"] == 4 and r["y"]["mean"] is None


def _regime_frame(spark, xs, pnls, pos=1.0):
    return spark.createDataFrame(
        [(D(2020, 1, 1) + dt.timedelta(days=i), x, p, pos) for i, (x, p) in enumerate(zip(xs, pnls))],
        "date date, s double, s_pnl double, s_pos double")


def test_fixed_bins_are_right_closed(spark):
    xs = [-2.0, -2.0, -1.0, -1.0, 0.0, 0.0, 2.0, 2.0, 3.0, 3.0]
    pn = [1.0, 2.0, 1.0, 3.0, 0.0, 0.0, 5.0, 6.0, 1.0, 2.0]
    out = regimes.sharpe_by_fixed_bin(_regime_frame(spark, xs, pn), ["s"], ["s"]).orderBy("bucket").collect()
    labels = [r["BinLabel"] for r in out]
    assert labels == ["<= -2.00", "(-2.00, -1.00]", "(-0.50, 0.00]", "(1.00, 2.00]", "> 2.00"]
    assert out[2]["SharpeRatio"] == 0.0  # mean 0 and std 0


def test_deciles_with_heavy_ties_and_few_rows(spark):
    xs = [1.0] * 8 + [2.0, 3.0]
    pn = [float(i % 3) for i in range(10)]
    out = regimes.sharpe_by_decile(_regime_frame(spark, xs, pn), ["s"]).collect()
    assert {r["bucket"] for r in out} <= set(range(1, 11))
    assert sum(1 for r in out if r["DecileAxisLabel"] == "1.00 to 1.00") == 1
    few = regimes.sharpe_by_decile(_regime_frame(spark, [1.0, 2.0], [1.0, 2.0]), ["s"]).collect()
    assert few == []  # every bucket has fewer than two PnL values


def test_acf_constant_and_short_series(spark):
    df = spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(days=i), 1.0, float(i % 7)) for i in range(60)],
                               "date date, k double, v double")
    out = series.autocorrelation(df, ["k", "v"], AnalysisParams(acf_max_lags=5)).collect()
    assert {(r["column"], r["lag"]) for r in out if r["column"] == "k"} == {("k", 0)}
    v = sorted((r["lag"], r["acf"]) for r in out if r["column"] == "v")
    x = np.array([i % 7 for i in range(60)], float)
    assert v[3][1] == pytest.approx(np.corrcoef(x[3:], x[:-3])[0, 1])
    short = series.autocorrelation(df.limit(5), ["v"], AnalysisParams(acf_max_lags=40)).collect()
    assert short == []


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_t(3, 500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    rows = series.histogram(df, "x").collect()
    from tests.test_properties import every_bin, numpy126_auto_counts
    counts, edges = numpy126_auto_counts(x)
    dens = counts / np.diff(edges) / counts.sum()
    assert every_bin(rows) == [(i, int(c)) for i, c in enumerate(counts)]
    got = {r["bin"]: r["density"] for r in rows if r["count"]}
    np.testing.assert_allclose([got[i] for i in sorted(got)], dens[counts > 0], rtol=1e-9)


def test_kde_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, 300)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = sorted((r["grid_index"], r["x"], r["density"]) for r in series.kde_curve(df, "x", 50).collect())
    bw = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 50)
    want = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).mean(1) / (bw * math.sqrt(2 * math.pi))
    np.testing.assert_allclose([g[2] for g in got], want, rtol=1e-9)


def test_many_underlyings_equal_union_of_single_runs(spark):
    from thetaflow.sources.fixtures import fixture_catalog
    cat = fixture_catalog(spark, "/root/testdata/sf0.001")
    prices = cat.security_price()
    # a second underlying: the same series shifted in id and scaled
    p2 = prices.where("securityid = 108105").withColumn("securityid", F.lit(7)).withColumn(
        "closeprice", F.col("closeprice") * 1.5)
    o2 = cat.option_price().where("securityid = 108105").withColumn("securityid", F.lit(7)).withColumn("strike", (F.col("strike") * 3 / 2).cast("long"))
    both_p, both_o = prices.unionByName(p2), cat.option_price().unionByName(o2)
    params = StraddleParams(underlyings=(108105, 7), min_date=D(1995, 1, 1))
    many = chain.straddles(both_o, both_p, params)
    one = chain.straddles(both_o, both_p, StraddleParams(underlyings=(7,), min_date=D(1995, 1, 1)))
    assert many.where("securityid = 7").exceptAll(one).count() == 0
    assert one.exceptAll(many.where("securityid = 7")).count() == 0


def test_one_pass_pairs_like_a_join_of_both_legs(spark):
    from thetaflow.plans.queries import FIXTURE_PARAMS, _market
    o, p = _market(spark, "/root/testdata/sf0.001")
    opened = chain.open_legs(o, p, FIXTURE_PARAMS, keep_strike=True).withColumnsRenamed({"sprc": "sprc_day_0", "uprc": "uprc_day_0"})
    closed = chain.close_legs(o, p, FIXTURE_PARAMS, keep_strike=True).select(
        "securityid", "okey_cp", "strike", F.col("date").alias("expiration"), F.col("sprc").alias("sprc_day_1"),
        F.col("uprc").alias("uprc_day_1"))
    want = opened.join(closed, ["securityid", "okey_cp", "strike", "expiration"]).select(*chain.MERGED_COLS).where(
        ~F.col("date").isin(list(FIXTURE_PARAMS.date_problems))).dropna().distinct()
    got = chain.merge_legs(o, p, FIXTURE_PARAMS)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_straddles_scan_the_chain_once_and_move_no_quote(spark):
    """Plans on bucketed tables, also where the closes are too large to broadcast."""
    from thetaflow.plans.queries import FIXTURE_PARAMS, _market
    o, p = _market(spark, "/root/testdata/sf0.001")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            assert not any("Exchange hash" in line for line in _plan(chain.open_legs(o, p, FIXTURE_PARAMS)))
            plan = _plan(chain.straddles(o, p, FIXTURE_PARAMS))
            assert sum("option_price" in line and "Scan" in line for line in plan) == 1
            scan = next(i for i, line in enumerate(plan) if "option_price" in line and "Scan" in line)
            chosen = next(i for i, line in enumerate(plan) if "row_number()" in line and "Window" in line)
            assert chosen < scan and not any("Exchange hash" in line for line in plan[chosen:])
            assert ("SortMergeJoin" in "".join(plan)) == (threshold == "-1")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ewma_and_zscore_per_series_key(spark):
    rng = np.random.default_rng(5)
    rows = []
    for sid in (1, 2):
        x = rng.normal(10 * sid, 2, 400)
        rows += [(sid, D(2001, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "sid int, date date, VIX double")
    fp = FeatureParams(vol_cols=("VIX",), zscore_window=30)
    both = features.add_vol_zscore(df, fp, series_keys=("sid",))
    for sid in (1, 2):
        one = features.add_vol_zscore(df.where(F.col("sid") == sid), fp)
        a = sorted((r["date"], r["VIX_ewma_hl_5_zscore"]) for r in both.where(F.col("sid") == sid).collect())
        b = sorted((r["date"], r["VIX_ewma_hl_5_zscore"]) for r in one.collect())
        assert [x[0] for x in a] == [x[0] for x in b]
        for (_, za), (_, zb) in zip(a, b):
            assert (za is None and zb is None) or za == pytest.approx(zb, rel=1e-12)


def test_kde_and_histogram_on_constant_and_single_values(spark):
    const = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert series.kde_curve(const, "x").count() == 0  # singular data: no curve, no error
    h = series.histogram(const, "x").collect()
    assert len(h) == 1 and h[0]["count"] == 5 and h[0]["bin_start"] == 1.5 and h[0]["bin_end"] == 2.5
    one = spark.createDataFrame([(7.0,)], "x double")
    assert series.kde_curve(one, "x").count() == 0
    assert series.histogram(one, "x").collect()[0]["count"] == 1


def test_far_outlier_costs_one_row_of_the_histogram(spark):
    rows = series.histogram(spark.createDataFrame([(v,) for v in [0.0, 1e-9, 2e-9, 3e-9] * 25 + [1e6]], "x double"), "x").orderBy("bin").collect()
    assert [r["count"] for r in rows] == [25, 25, 25, 25, 0, 1]
    assert rows[4]["bins"] > 1e15 and rows[5]["bin"] == rows[4]["bin"] + rows[4]["bins"] and rows[5]["bin_end"] == 1e6
    rows = series.histogram(spark.createDataFrame([(v,) for v in [0.0, 1e-300, 2e-300, 3e-300] * 25 + [1e300]], "x double"), "x").collect()
    assert sum(r["count"] for r in rows) == 101 and sum(r["bins"] for r in rows) == 8  # Sturges: no double tells FD's bins apart
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.0,), (2.0,)], "x double")
    assert sum(r["count"] for r in series.histogram(odd, "x").collect()) == 2


def test_grouped_distributions_equal_single_ones(spark):
    rng = np.random.default_rng(11)
    rows = [(g, float(v)) for g, n in ((None, 30), ("a", 400), ("b", 1), ("c", 90)) for v in rng.standard_t(2, n)] + [("d", 1.0)] * 5 + [("e", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    for make in (series.histogram, series.kde_curve):
        many = make(df, "x", group_cols=("g",))
        groups = [r[0] for r in many.select("g").distinct().collect()]
        assert set(groups) == ({None, "a", "b", "c", "d"} if make is series.histogram else {None, "a", "c"})
        for g in groups:
            one = make(df.where(F.col("g").eqNullSafe(F.lit(g))), "x").collect()
            some = many.where(F.col("g").eqNullSafe(F.lit(g))).drop("g").collect()
            key = "bin" if make is series.histogram else "grid_index"
            for a, b in zip(sorted(one, key=lambda r: r[key]), sorted(some, key=lambda r: r[key]), strict=True):
                assert list(a) == pytest.approx(list(b), rel=1e-12)


def test_kde_with_gaps_and_outliers(spark):
    rng = np.random.default_rng(12)
    x = np.r_[rng.normal(0, 1, 3000), rng.normal(40, 0.1, 50), 90.0]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    out = series.kde_curve(df, "x", 120)
    bw = x.std(ddof=1) * len(x) ** -0.2
    got = np.array([r["density"] for r in out.orderBy("grid_index").collect()])
    want = np.exp(-0.5 * ((np.linspace(x.min(), x.max(), 120)[:, None] - x) / bw) ** 2).mean(1) / (bw * math.sqrt(2 * math.pi))
    np.testing.assert_allclose(got, np.where(want >= 1e-12 * want.max(), want, 0), rtol=1e-9)


def test_acf_over_chunk_borders(spark):
    rng = np.random.default_rng(13)
    for n in (41, 60, 1024, 1030, 1064, 1065, 2100):
        x = rng.normal(0, 1, n)
        x[0] = 1e4  # sums that were subtracted would lose their digits
        df = spark.createDataFrame([(i, float(v), 7.0 if i else 2.0) for i, v in enumerate(x)], "date int, x double, k double")
        got = {(r["column"], r["lag"]): r["acf"] for r in series.autocorrelation(df, ["x", "k"], AnalysisParams(acf_max_lags=40)).collect()}
        for lag in range(1, min(40, n - 2) + 1):
            assert got["x", lag] == pytest.approx(np.corrcoef(x[lag:], x[:-lag])[0, 1], abs=1e-9)
        assert [k for k in got if k[0] == "k"] == [("k", 0)]  # constant but for the first value, which no lag's later values hold


def test_histogram_gives_every_bin_a_row(spark, monkeypatch):
    monkeypatch.setattr(series, "RUN_BINS", 3)
    df = spark.createDataFrame([(g, float(x)) for g in "ab" for x in (0, 0.5, 1, 1, 20, 99.5, 1000)], "g string, x double")
    want, edges = np.histogram([0, 0.5, 1, 1, 20, 99.5], bins=50)
    rows = series.histogram(df.where("g = 'a'"), "x", bins=50, limit=100, every_bin=True).orderBy("bin").collect()
    assert [r["bin"] for r in rows] == list(range(50)) and [r["count"] for r in rows] == list(want)
    assert [r["bin_start"] for r in rows] + [rows[-1]["bin_end"]] == pytest.approx(list(edges))
    both = series.histogram(df, "x", bins=50, limit=100, every_bin=True, group_cols=("g",))
    assert both.columns == ["g", "bin", "bin_start", "bin_end", "count", "density"] and both.count() == 100


def test_limited_histogram_lists_every_bin(spark):
    from thetaflow.plans.registry import QUERIES
    rows = QUERIES["histogram_limited"].build(spark, "/root/testdata/sf0.001").orderBy("bin").collect()
    assert [r["bin"] for r in rows] == list(range(len(rows))) and any(r["count"] == 0 for r in rows)
