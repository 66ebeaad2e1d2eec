"""Property tests: distributed exact quantiles and the histogram rule vs numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thetaflow.functions.quantiles import exact_quantiles
from thetaflow.operators import series

VALUES = st.lists(st.one_of(st.integers(-5, 5).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=60)
PROBS = st.lists(st.floats(0.0, 1.0), min_size=1, max_size=5)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(values=VALUES, probs=PROBS)
def test_exact_quantiles_match_numpy(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, F.col("x"), probs, accuracy=8).collect()[0]["quantiles"]
    want = np.percentile(np.array(values), [p * 100 for p in probs])
    np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-9)


def numpy126_auto_counts(x):
    """``np.histogram(x, bins="auto")`` as NumPy 1.26 computes it: the smaller of
    the Freedman-Diaconis and Sturges widths, Sturges alone when FD is 0
    (NumPy 2 also caps the FD bin count, so the installed version differs)."""
    x = np.asarray(x, dtype=float)
    lo, hi = x.min(), x.max()
    first, last = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    sturges = (hi - lo) / (np.log2(x.size) + 1.0)
    q75, q25 = np.percentile(x, [75, 25])
    fd = 2.0 * (q75 - q25) * x.size ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd else sturges
    nb = int(np.ceil((last - first) / width)) if width else 1
    return np.histogram(x, bins=nb, range=(first, last))


def every_bin(rows):
    """(bin, count) of all bins from the run-length rows of a histogram, which must cover them without a gap."""
    out = []
    for r in sorted(rows, key=lambda r: r["bin"]):
        assert r["bin"] == len(out) and (r["bins"] == 1) == (r["count"] > 0) or r["count"] == 0
        out += [(r["bin"] + i, r["count"]) for i in range(r["bins"])]
    return out


@SETTINGS
@given(values=VALUES)
def test_histogram_matches_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = series.histogram(df, "x").collect()
    x = np.array(values)
    fd = 2.0 * np.subtract(*np.percentile(x, [75, 25])) * x.size ** (-1.0 / 3.0)
    assert sum(r["count"] for r in rows) == len(values)
    if fd > 0 and (x.max() - x.min()) / fd > 1e5:  # more bins than are worth an array
        return
    counts, _ = numpy126_auto_counts(values)
    assert every_bin(rows) == [(i, int(c)) for i, c in enumerate(counts)]


LABEL_VALUES = st.lists(st.one_of(
    st.floats(-1e7, 1e7, allow_nan=False, allow_infinity=False),
    st.integers(-100000, 100000).map(lambda k: k / 1000.0),  # shortest forms ending in a 5
    st.sampled_from([0.125, 2.675, 2.775, 99999.995, -0.001, 0.0, -0.0, 1234.565])),
    min_size=1, max_size=40)


@SETTINGS
@given(values=LABEL_VALUES)
def test_fixed_decimals_matches_python(spark, values):
    from thetaflow.functions.columns import fixed_decimals
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = {r["i"]: r["s"] for r in df.select("i", fixed_decimals(F.col("x")).alias("s")).collect()}
    assert [got[i] for i in range(len(values))] == [f"{v:.2f}" for v in values]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(h=st.sampled_from([1, 2, 3, 5]), n=st.integers(1, 2500), seed=st.integers(0, 10_000),
       null_share=st.sampled_from([0.0, 0.05, 0.3]))
def test_ewma_matches_pandas(spark, h, n, seed, null_share):
    import datetime as dt

    import pandas as pd

    from thetaflow.operators import features
    from thetaflow.params import FeatureParams
    rng = np.random.default_rng(seed)
    x = rng.normal(20, 4, n)
    x[rng.random(n) < null_share] = np.nan
    rows = [(dt.date(1990, 1, 1) + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "date date, VIX double")
    got = features.add_vol_ewma(df, FeatureParams(half_life=h, vol_cols=("VIX",))).orderBy("date").toPandas()
    g = got[f"VIX_ewma_hl_{h}"].to_numpy(dtype=float)
    want = pd.Series(x).ewm(halflife=h, adjust=True, ignore_na=False).mean().to_numpy()
    mask = ~np.isnan(x)
    np.testing.assert_allclose(g[mask], want[mask], rtol=1e-11)
    assert np.isnan(g[~mask]).all()


def _model_pnl_stats(values, ann=252, base=1e6):
    """The documented statistic rules, in plain Python (nulls removed, date order)."""
    x = np.array([v for v in values if v is not None], dtype=float)
    n = len(x)
    if n == 0:
        return [None] * 14
    mean = x.mean()
    std = x.std(ddof=1) if n > 1 else None
    if std is not None and std != 0:
        sharpe = (mean - 0.0) / std * ann ** 0.5
    elif mean == 0 and (std is None or std == 0):
        sharpe = 0.0
    else:
        sharpe = None

    def worst(k):
        if n < k:
            return None
        return min(x[i:i + k].sum() for i in range(n - k + 1)) / base * 100

    m = x - mean
    m2 = (m ** 2).mean()
    skew = (m ** 3).mean() / m2 ** 1.5 if n > 2 and m2 > 0 else None
    kurt = (m ** 4).mean() / m2 ** 2 - 3 if n > 3 and m2 > 0 else None
    wins, losses = x[x > 0], x[x < 0]
    total = x.sum() / base * 100
    g = 1 + total / 100
    ann_ret = (g ** (ann / n) - 1) * 100 if (g > 0 or float(ann / n).is_integer()) else None
    return [mean, std, sharpe, (x > 0).sum() / n * 100, x.max(), x.min(), worst(5), worst(20), skew, kurt,
            wins.mean() if len(wins) else 0.0, losses.mean() if len(losses) else 0.0, total, ann_ret]


@SETTINGS
@given(values=st.lists(st.one_of(st.none(), st.just(0.0), st.floats(-5e5, 5e5, allow_nan=False)),
                       min_size=1, max_size=45))
def test_pnl_stats_match_model(spark, values):
    import datetime as dt

    from thetaflow.operators import stats
    df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)],
                               "date date, pnl double")
    got = {r["Statistic"]: r["Value"] for r in stats.pnl_statistics(df, "pnl").collect()}
    want = dict(zip(stats.PNL_STAT_NAMES, _model_pnl_stats(values)))
    for name in stats.PNL_STAT_NAMES:
        g, w = got[name], want[name]
        if w is None or (isinstance(w, float) and not np.isfinite(w)):
            assert g is None, name
        else:
            assert g == pytest.approx(w, rel=1e-9, abs=1e-9), name


HOSTILE = st.one_of(st.none(), st.just(0.0), st.just(1.0), st.floats(-1e300, 1e300, allow_nan=False,
                                                                     allow_infinity=False),
                    st.floats(-1e-310, 1e-310, allow_nan=False))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(HOSTILE, HOSTILE, HOSTILE), min_size=0, max_size=30))
def test_reports_never_raise(spark, rows):
    import datetime as dt

    from thetaflow.operators import regimes, stats
    from thetaflow.params import AnalysisParams
    data = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), a, b, p) for i, (a, b, p) in enumerate(rows)]
    df = spark.createDataFrame(data, "date date, a double, b double, s_pnl double")
    df = df.withColumn("s", F.col("a")).withColumn("s_pos", F.col("b"))
    params = AnalysisParams(acf_max_lags=3)
    stats.correlation_matrix(df, ["a", "b", "s_pnl"]).collect()
    stats.correlation_matrix(df, ["a", "b", "s_pnl"], "spearman").collect()
    stats.describe(df, ["a", "b", "s_pnl"]).collect()
    stats.pnl_statistics(df, "s_pnl").collect()
    regimes.sharpe_by_decile(df, ["s"], None, params).collect()
    regimes.sharpe_by_fixed_bin(df, ["s"], ["a"], params).collect()
    series.autocorrelation(df, ["a", "s_pnl"], params).collect()
    series.histogram(df, "a").collect()
    series.kde_curve(df, "a").collect()


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(HOSTILE, HOSTILE, HOSTILE, HOSTILE), min_size=0, max_size=25))
def test_pipeline_stages_never_raise(spark, rows):
    import datetime as dt

    from thetaflow.operators import backtest, features, signals, vol
    from thetaflow.params import FeatureParams, StraddleParams
    from thetaflow.sources import schemas
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(len(rows))]
    prices = spark.createDataFrame(
        [(sid, d, a, b, c) for d, (a, b, c, _) in zip(days, rows) for sid in (1, 117801, 152892, 145764)],
        schemas.SECURITY_PRICE)
    features.log_returns(prices, StraddleParams(underlyings=(1,))).collect()
    vt = vol.vol_table(prices)
    features.add_vol_zscore(vt, FeatureParams(zscore_window=5)).collect()
    st_df = spark.createDataFrame([(1, d, a, b, c) for d, (a, b, c, _) in zip(days, rows)],
                                  "securityid int, date date, straddle_day_0 double, straddle_day_1 double, "
                                  "uprc_diff double")
    sig = signals.add_signal_components(signals.add_straddle_returns(st_df))
    backtest.generate_backtest(sig).collect()
