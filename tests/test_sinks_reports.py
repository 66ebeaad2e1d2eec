import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from thetaflow.functions.columns import c
from thetaflow.operators import chain, regimes, series, stats
from thetaflow.plans import dataset, report
from thetaflow.plans.queries import FIXTURE_PARAMS, _backtest, _market
from thetaflow.plans.registry import QUERIES
from thetaflow.sources import sinks

SF = "/root/testdata/sf0.001"


def test_csv_round_trip_keeps_every_column(spark, tmp_path):
    legacy = dataset.legacy_backtest(*_market(spark, SF), FIXTURE_PARAMS).withColumn("decile", F.lit("D3"))
    sinks.write_csv(legacy, str(tmp_path / "csv"))
    for back in (sinks.read_csv_with_dates(spark, str(tmp_path / "csv"), date_cols=("date", "expiration")),
                 sinks.read_csv_with_dates(spark, str(tmp_path / "csv"), schema=legacy.schema)):
        assert back.columns == legacy.columns
        for name in ("date", "expiration"):
            assert isinstance(back.first()[name], dt.date)
        for name in legacy.columns:
            assert back.where(c(name).isNull()).count() == legacy.where(c(name).isNull()).count(), name
        pnl = next(x for x in legacy.columns if x.endswith("_pnl"))
        assert back.agg(F.sum(pnl)).first()[0] == pytest.approx(legacy.agg(F.sum(pnl)).first()[0])


def test_csv_cells_without_the_type_are_not_lost(spark, tmp_path):
    (tmp_path / "x.csv").write_text("date,a\n2024-01-02,1.5\n2024-01-03,oops\n")
    assert [r["a"] for r in sinks.read_csv_with_dates(spark, str(tmp_path / "x.csv")).collect()] == ["1.5", "oops"]
    with pytest.raises(Exception):
        sinks.read_csv_with_dates(spark, str(tmp_path / "x.csv"), "date date, a double").collect()
    (tmp_path / "y.csv").write_text("date,a\n2024-01-02,1\nsoon,2\n")
    with pytest.raises(Exception):
        sinks.read_csv_with_dates(spark, str(tmp_path / "y.csv")).collect()


def test_parquet_sink(spark, tmp_path):
    bt = _backtest(spark, SF)
    sinks.write_dataset(bt, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).where("securityid = 108105").count() == bt.where(
        "securityid = 108105").count() > 0


def test_parquet_sink_clusters_and_replaces_single_years(spark, tmp_path):
    path = str(tmp_path / "pq")
    rows = [(sid, dt.date(year, 1, 1) + dt.timedelta(d), float(sid + d)) for sid in range(300) for year in (2023, 2024) for d in range(4)]
    df = spark.createDataFrame(rows, "securityid int, date date, x double")
    sinks.write_dataset(df, path)
    files = spark.read.parquet(path).inputFiles()
    assert len(files) < 20  # not one for each of 300 underlyings
    first = {f for f in files if "year=2023" in f}
    sinks.write_dataset(df.where("year(date) = 2024").withColumn("x", F.lit(-1.0)), path)
    back = spark.read.parquet(path)
    assert {f for f in back.inputFiles() if "year=2023" in f} == first and back.count() == len(rows)
    assert {r[0] for r in back.where("year = 2024").select("x").distinct().collect()} == {-1.0}
    sinks.write_dataset(df, path, file_rows=100)
    assert len(spark.read.parquet(path).inputFiles()) >= len(rows) / 100


def test_csv_rejects_are_a_table(spark, tmp_path):
    (tmp_path / "x.csv").write_text("date,a\n2024-01-02,1.5\n2024-01-03,oops\nsoon,2\n2024-01-05,\n2024-01-06,1,2\n")
    schema = spark.createDataFrame([], "date date, a double").schema
    rows, bad = sinks.read_csv_checked(spark, str(tmp_path / "x.csv"), schema)
    assert rows.columns == ["date", "a"] and sorted(map(tuple, rows.collect())) == [
        (dt.date(2024, 1, 2), 1.5), (dt.date(2024, 1, 5), None)]
    assert sorted(r["line"] for r in bad.collect()) == ["2024-01-03,oops", "2024-01-06,1,2", "soon,2"]
    assert all(r["file"].endswith("x.csv") for r in bad.collect())


def test_named_tables(spark, tmp_path):
    from thetaflow.sources.catalog import Catalog

    df = spark.createDataFrame([(1, dt.date(2024, 1, 2), 3.0, None, None, "more")], "securityid int, date date, closeprice double, "
                               "bidlow double, askhigh double, other string")
    sinks.write_bucketed(df, "named_prices", str(tmp_path / "t"), 3)
    cat = Catalog(spark, tables={"om_int_security_price": "named_prices", "om_int_option_price": "no_such_table"})
    assert cat.security_price().columns == ["securityid", "date", "closeprice", "bidlow", "askhigh"]
    with pytest.raises(FileNotFoundError):
        cat.option_price()
    with pytest.raises(ValueError):
        cat.load("unheard_of")


def test_whole_report_in_one_table(spark):
    from thetaflow.plans.queries import ANALYSIS_CHARTS, _report_input

    bt = _report_input(spark, SF)
    tables = report.full_analysis(bt, ["VIX"], ["VIX", "VVIX"], charts=ANALYSIS_CHARTS, checkpoint=False)
    long = report.long_table(tables)
    names = {r[0] for r in long.select("report").distinct().collect()}
    assert names == set(tables) - {"pnl_statistics"}  # not asked for: no rows
    assert long.groupBy("report", "grp", "key", "measure").count().where("count > 1").isEmpty()
    assert report.chart_tables(bt, report.Charts(histograms=("no such column",))) == {}


def test_reports_build(spark):
    bt = _backtest(spark, SF)
    out = report.strategy_report(bt)
    assert out["pnl_stats_total"].count() == 14
    fa = report.full_analysis(bt, stats_cols=["VIX"], corr_cols=["VIX", "VVIX"],
                              pnl_stat_cols=["ret_sprc_signal_pnl", "ret_uprc_signal_pnl"])
    assert fa["pnl_statistics"].count() == 28
    assert fa["correlation_matrix"].count() == 2
    assert FIXTURE_PARAMS.min_date.year == 1995


def test_reports_per_underlying(spark):
    bt = _backtest(spark, SF)
    out = report.strategy_report(bt, group_cols=("securityid",), checkpoint=False)
    assert out["pnl_stats_total"].count() == 14 * bt.select("securityid").distinct().count() > 14
    assert "securityid" in out["sharpe_by_vol_decile"].columns


def test_null_group_keeps_its_rows(spark):
    rows = [(g, float(i % 7), float(i), dt.date(2024, 1, 1) + dt.timedelta(i)) for g in (None, "a") for i in range(40)]
    df = spark.createDataFrame(rows, "g string, s_pos double, s double, date date").withColumn("s_pnl", F.col("s") - 9)
    got = {r["g"]: r["p50"] for r in stats.describe(df, ["s"], group_cols=("g",)).collect()}
    assert got == {None: 19.5, "a": 19.5}
    deciles = regimes.sharpe_by_decile(df, ["s"], group_cols=("g",)).groupBy("g").count().collect()
    assert {r["g"] for r in deciles} == {None, "a"} and len({r["count"] for r in deciles}) == 1
    pnl = stats.pnl_statistics(df, "s_pnl", group_cols=("g",)).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in pnl} == {None: 14, "a": 14}


def test_pooled_pnl_does_not_depend_on_row_order(spark):
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(i), float((i * 37 + k * 11) % 23 - 11)) for k in range(100) for i in range(60)]
    df = spark.createDataFrame(rows, "securityid int, date date, pnl double")
    got = [sorted(map(tuple, stats.pnl_statistics(x, "pnl").collect()))
           for x in (df.repartition(7, "date"), df.repartition(3, "securityid"), df.orderBy(F.desc("pnl")))]
    for other in got[1:]:
        assert [a for a, _ in got[0]] == [a for a, _ in other]
        for (_, a), (_, b) in zip(got[0], other):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-9)
    plan = stats.pnl_statistics(df, "pnl")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(isnull" not in plan


def test_histogram_has_every_bin_and_no_product(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (10.0,)], "x double")
    out = series.histogram(df, "x", bins=10)
    rows = out.orderBy("bin").collect()
    assert [(r["bin"], r["bins"], r["count"]) for r in rows] == [(0, 1, 2), (1, 8, 0), (9, 1, 1)]
    assert sum(r["density"] * (r["bin_end"] - r["bin_start"]) for r in rows) == pytest.approx(1)
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()


def test_interval_labels(spark):
    arr = F.array(F.lit(-2.0), F.lit(0.5))
    got = spark.range(1, 4).select(regimes.interval_label(F.col("id").cast("int"), arr).alias("x")).collect()
    assert [r["x"] for r in got] == ["<= -2.00", "(-2.00, 0.50]", "> 0.50"]


def test_all_underlyings_without_a_list(spark):
    options, prices = _market(spark, SF)
    every = dataset.backtest_1dte(options, prices, FIXTURE_PARAMS).select("securityid", "date", "ret_uprc_signal_pnl")
    ids = tuple(r[0] for r in every.select("securityid").distinct().collect())
    named = replace(FIXTURE_PARAMS, underlyings=ids)
    assert FIXTURE_PARAMS.underlyings is None and len(ids) > 5
    assert dataset.backtest_1dte(options, prices, named).select(*every.columns).exceptAll(every).isEmpty()


def test_every_rule_of_the_fixture_fires(spark):
    """Each rule cuts or changes rows, so that a green comparison says something."""
    from thetaflow.operators import chain, vol
    from thetaflow.plans.queries import _dataset

    options, prices = _market(spark, SF)
    p = FIXTURE_PARAMS
    assert options.where(F.col("date") < F.lit(p.min_date)).count() > 0
    assert options.count() > options.distinct().count()
    opened = chain.open_legs(options, prices, p)
    merged = chain.merge_legs(options, prices, p)
    assert opened.where(F.col("date").isin(list(p.date_problems))).count() > 0
    assert opened.where(~F.col("date").isin(list(p.date_problems))).count() > merged.count()  # legs without a close
    straddles = chain.straddles(options, prices, p)
    assert merged.select("securityid", "date").distinct().count() > straddles.count()  # calls without a put
    assert straddles.where("straddle_day_0 = 0").count() > 0
    table = vol.vol_table(prices)
    assert table.where("VIX = 0").count() > 0 and table.where("VIX IS NULL").count() > 0
    assert table.where("VIX = 0 AND VIX_TS IS NULL").count() > 0
    assert prices.groupBy("securityid", "date").count().where("count > 1").count() > 0
    bt = _backtest(spark, SF)
    assert _dataset(spark, SF).count() > bt.count()
    for side in ("> 0", "< 0"):
        assert bt.where(f"ret_uprc_signal_pos {side}").count() > 0
    total = {r["Statistic"]: r["Value"] for r in stats.pnl_statistics(bt.where("securityid = 200003"), "ret_uprc_signal_pnl").collect()}
    assert total["Skewness"] is not None


def test_nan_is_a_missing_value_for_the_ewma(spark):
    from thetaflow.functions.ewma import add_ewma

    n = 2000  # over a chunk border at half-life 1
    rows = [(dt.date(2000, 1, 1) + dt.timedelta(i), float("nan") if i in (100, 800) else float(i % 13)) for i in range(n)]
    frame = spark.createDataFrame(rows, "date date, x double")
    with_nan = {r["date"]: r["e"] for r in add_ewma(frame, {"x": "e"}, 1).collect()}
    nulls = frame.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    assert with_nan == {r["date"]: r["e"] for r in add_ewma(nulls, {"x": "e"}, 1).collect()}
    assert sum(v is None for v in with_nan.values()) == 2


def test_checkpoint_folder_must_be_shared_on_a_cluster(spark, monkeypatch):
    from thetaflow import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return None

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_ids_from_a_table(spark):
    rows = spark.createDataFrame([(1, 10.0), (1, 11.0), (2, 20.0), (3, 30.0), (None, 40.0)], "securityid int, x double")
    ids = spark.createDataFrame([(1,), (1,), (3,), (9,), (None,)], "securityid long")
    kept = chain.of_ids(rows, ids)
    assert kept.columns == rows.columns
    assert sorted(map(tuple, kept.collect())) == [(1, 10.0), (1, 11.0), (3, 30.0)]
    assert chain.of_ids(rows, ids.limit(0)).isEmpty()
    assert 0 < QUERIES["base_chain_by_table"].build(spark, SF).count() < QUERIES["base_chain"].build(spark, SF).count()


def test_sorted_queries_come_in_order(spark):
    days = [(r["securityid"], r["date"]) for r in QUERIES["dataset_1dte_sorted"].spark(spark, SF).collect()]
    assert days and days == sorted(days) and len({i for i, _ in days}) > 1
    buckets = [(*(r[k] for k in regimes.KEYS), r["bucket"])
               for r in QUERIES["sharpe_by_signal_decile_ordered"].spark(spark, SF).collect()]
    assert len(buckets) > 10 and buckets == sorted(buckets)


def test_quotes_are_made_of_days_where_they_lie(spark):
    """The stored option table has a row a day; its quotes are those of the fixture's rules, and reading them moves none."""
    from pyspark.sql import Window
    from thetaflow.sources import fixtures
    tables = fixtures.materialize_fixtures(spark, SF)
    days, prices = (spark.table(tables[f"om_int_{x}_price"]) for x in ("option", "security"))
    quotes = _market(spark, SF)[0]
    assert days.count() <= prices.count() and quotes.count() > 25 * days.count()
    w = Window.partitionBy("securityid").orderBy("date")
    px = prices.where("securityid = 108105 OR securityid BETWEEN 200000 AND 299999")
    ctr = F.floor(F.col("closeprice") / 25).cast("long") * 25
    ends = px.select("securityid", F.lead("date").over(w).alias("date"), F.lead("closeprice").over(w).alias("px"), ctr.alias("ctr"))
    ends = ends.where("date IS NOT NULL AND (securityid = 108105 OR dayofmonth(date) NOT IN (7, 11, 13))")
    closing = quotes.where("date = expiration AND callput = 'C'").where("securityid = 108105 OR dayofmonth(date) NOT IN (7, 11, 13)")
    want = ends.select("securityid", "date", F.explode(F.array(*[((F.col("ctr") + 25 * k) * 1000) for k in range(-2, 3)])).alias("strike"))
    assert want.count() > 0 and want.exceptAll(closing.select("securityid", "date", "strike")).count() == 0
    assert closing.select("securityid", "date", "strike").exceptAll(want).count() == 0
    plan = quotes._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_closing_quotes_travel_by_day(spark):
    """What meets by contract is a row a day and type, not a row a quote."""
    plan = chain.merge_legs(*_market(spark, SF), FIXTURE_PARAMS)._jdf.queryExecution().executedPlan().toString().splitlines()
    exchange = next(i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line and "ends" in line)
    assert any("ObjectHashAggregate" in line and "collect_list" in line for line in plan[exchange:])


def test_rounding_formats_no_short_value_and_is_that_of_printf(spark):
    """Values of few digits pass as they are, and the formatting of the others isn't compiled into the whole stage's method."""
    from thetaflow.plans.registry import rounded
    values = [None, 0.0, -0.0, 512.25, -3.0001, 999999.9999, 999999.99995, 1e6, 1 / 3, 0.30000000000000004, 123456.78915, 1e22, 5e-324,
              1.7976931348623157e308, float("inf")]
    out = rounded(spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double"), {})
    got = [r["x"] for r in out.orderBy("i").collect()]
    assert got == [None if x is None else float(f"{x:.9e}") for x in values] and str(got[2]) == "0.0"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rint(" in plan and "lambdafunction(" in plan


def test_prices_are_made_without_options_and_items_move_once(spark, tmp_path):
    """Queries on prices alone write no option table; an item moves by its day once before it is grouped."""
    from thetaflow.plans.queries import _prices
    from thetaflow.sources import fixtures
    for t, cols in (("orders", "timestamp'1999-01-04' o_orderdate, 5e4D o_totalprice, id o_custkey"),
                    ("lineitem", "id % 3 l_suppkey, timestamp'1999-01-04' + make_interval(0, 0, 0, int(id % 5)) l_shipdate, 2D l_quantity")):
        spark.sql(f"SELECT {cols} FROM range(60)").write.parquet(str(tmp_path / f"{t}.parquet"))
    prices = _prices(spark, str(tmp_path))
    assert prices.where("securityid BETWEEN 200000 AND 200002").count() == 15
    assert set(fixtures.materialize_fixtures(spark, str(tmp_path), options=False)) == {"om_int_security_price"}
    assert set(fixtures.materialize_fixtures(spark, str(tmp_path))) == {"om_int_security_price", "om_int_option_price"}
    items = spark.read.parquet(str(tmp_path / "lineitem.parquet"))
    plan = fixtures.security_price_from_lineitem(items, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_closing_quotes_leave_the_choice_of_legs_in_its_first_rows(spark):
    """The window that ranks a day's quotes also takes its closing ones: none but a day's first rows are sorted again."""
    plan = chain.straddles(*_market(spark, SF), FIXTURE_PARAMS)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("row_number()" in line and "collect_list" in line and "Window" in line for line in plan)
    assert any("Filter (place" in line and " = 1)" in line and "OR" not in line for line in plan)
