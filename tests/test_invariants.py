
import datetime as dt

import pytest
from pyspark.sql import functions as F

from thetaflow.operators import regimes, series
from thetaflow.params import StraddleParams
from thetaflow.plans import dataset
from thetaflow.plans.queries import _backtest, _market

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bt(spark):
    return _backtest(spark, SF).where("securityid = 108105").cache()


def test_cumulative_is_prefix_sum(bt):
    rows = bt.orderBy("date").select("ret_uprc_signal_pnl", "ret_uprc_signal_cum_pnl").collect()
    run = 0.0
    for r in rows:
        run += r[0]
        assert r[1] == pytest.approx(run, rel=1e-9, abs=1e-6)


def test_long_plus_short_plus_flat_is_total(bt):
    ls = series.long_short_cumulative(bt).orderBy("date").collect()
    pnl = {r["date"]: (r["ret_uprc_signal_pnl"], r["ret_uprc_signal_pos"]) for r in bt.collect()}
    last_long = last_short = 0.0
    for r in ls:
        last_long = r["long_pnl_contribution"] if r["long_pnl_contribution"] is not None else last_long
        last_short = r["short_pnl_contribution"] if r["short_pnl_contribution"] is not None else last_short
        flat = 0.0  # flat days (pos == 0) add no PnL
        assert last_long + last_short + flat == pytest.approx(r["ret_uprc_signal_cum_pnl"], rel=1e-9, abs=1e-6)
    assert len(pnl) == len(ls)


def test_zscore_null_for_first_window(spark):
    from thetaflow.operators import features, vol
    vt = features.add_vol_zscore(vol.vol_table(_market(spark, SF)[1])).orderBy("date").collect()
    assert all(r["VIX_ewma_hl_5_zscore"] is None for r in vt[:251])
    assert any(r["VIX_ewma_hl_5_zscore"] is not None for r in vt[251:])


def test_decile_bucket_counts_sum_to_n(bt):
    long = regimes._long(bt, None, ["ret_uprc_signal"], [])
    from thetaflow.functions.quantiles import exact_quantiles
    keys = regimes.KEYS
    br = exact_quantiles(long, F.col("x"), [i / 10 for i in range(1, 10)], keys, name="breaks")
    b = long.join(br, keys).withColumn("bucket", regimes.quantile_bucket(F.col("x"), F.col("breaks"), 9))
    per_side = {r["side"]: r["n"] for r in b.groupBy("side").agg(F.count("bucket").alias("n")).collect()}  # noqa: E501
    assert sum(per_side.values()) == bt.where("ret_uprc_signal_pos <> 0").count()


def test_many_underlyings_backtest_equals_single_runs(spark):
    opts, prices = _market(spark, SF)
    p2 = prices.where("securityid = 108105").withColumn("securityid", F.lit(7)).withColumn(
        "closeprice", F.col("closeprice") * 1.5)
    o2 = opts.where("securityid = 108105").withColumn("securityid", F.lit(7)).withColumn("strike", (F.col("strike") * 3 / 2).cast("long"))
    both_o, both_p = opts.unionByName(o2), prices.unionByName(p2)
    from dataclasses import replace
    from thetaflow.plans.queries import FIXTURE_PARAMS
    many = dataset.backtest_1dte(both_o, both_p, replace(FIXTURE_PARAMS, underlyings=(108105, 7)))
    one = dataset.backtest_1dte(both_o, both_p, replace(FIXTURE_PARAMS, underlyings=(7,)))
    cols = ["date", "ret_uprc_signal_pnl", "ret_uprc_signal_cum_pnl", "ret_sprc_signal_cum_pnl"]
    a = many.where("securityid = 7").select(*cols)
    b = one.select(*cols)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0
    base = many.where("securityid = 108105").select(*cols).exceptAll(_backtest(spark, SF).where("securityid = 108105").select(*cols))
    assert base.count() == 0


def test_grouped_reports_equal_ungrouped_for_one_group(bt):
    cols = ["signal_base", "column", "side", "bucket", "DecileAxisLabel", "SharpeRatio"]
    a = sorted(tuple(r) for r in regimes.sharpe_by_decile(bt, ["ret_uprc_signal"], ["VIX"]).select(*cols).collect())
    b = sorted(tuple(r) for r in regimes.sharpe_by_decile(bt, ["ret_uprc_signal"], ["VIX"],
                                                             group_cols=("securityid",)).select(*cols).collect())
    assert len(a) == len(b) > 0
    for ra, rb in zip(a, b):  # same buckets and labels; sums may differ in the last bit
        assert ra[:-1] == rb[:-1] and ra[-1] == pytest.approx(rb[-1], rel=1e-12)
    from thetaflow.operators import stats
    c1 = stats.correlation_matrix(bt, ["VIX", "VVIX", "ret"], "spearman").orderBy("column").collect()
    c2 = stats.correlation_matrix(bt, ["VIX", "VVIX", "ret"], "spearman", group_cols=("securityid",)) \
        .orderBy("column").collect()
    for r1, r2 in zip(c1, c2):
        for k in ("VIX", "VVIX", "ret"):
            assert r1[k] == pytest.approx(r2[k], rel=1e-12)
