"""Hand-computed cases and invariants of the demand model."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder import schema as S
from larder.functions.costs import CostModel, bin_masses, grid_with, interpolate
from larder.operators import demand, models, ordering, service
from larder.operators import forecasting as fc
from larder.operators import hierarchy as tree
from larder.sources import files, rules
from larder.streaming import daily as stream


def panel(spark, units, item="Brand#1", store="A", first=date(2000, 1, 1), price=2.0):
    rows = [(first + timedelta(days=i), item, store, "DEPT_1", "ALL", "ALL", u, price, 0, None) for i, u in enumerate(units)]
    return spark.createDataFrame(rows, S.fact_sales())


@pytest.fixture(scope="module")
def fact(spark):
    sf = "/root/testdata/sf0.001"
    tables = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "part", "supplier", "nation", "region")]
    return demand.fact_sales(demand.daily_sales(*tables)).cache()


def test_panel_is_rectangular_and_unique(fact):
    row = demand.summary(fact).first()
    assert row.rectangular and row.n_series == 125
    assert fact.groupBy("date", "item_id", "store_id").count().where("count > 1").isEmpty()


def test_features_know_nothing_after_the_origin(spark):
    rnd = random.Random(4)
    units = [rnd.randint(0, 5) for _ in range(200)]
    origin = 120
    changed = units[: origin + 1] + [u + 100 for u in units[origin + 1 :]]
    names = [c for c in demand.features(panel(spark, units), 28).columns if c.startswith(("units_", "zero_", "days_since_last"))]
    got = [{r.date: [r[c] for c in names] for r in demand.features(panel(spark, u), 28).collect()} for u in (units, changed)]
    last = date(2000, 1, 1) + timedelta(days=origin + 28)
    assert got[0] and all(got[0][d] == got[1][d] for d in got[0] if d <= last)
    assert any(got[0][d] != got[1][d] for d in got[0] if d > last)


def test_sample_is_topped_up(spark):
    items = spark.createDataFrame([(f"i{n}", "d", n / 10, 1 if n < 5 else n - 3) for n in range(6)], "item_id string, dept_id string, zero_share double, stratum int")
    got = demand.sample(items.withColumn("stratum_name", F.lit("x")), 5, 3).collect()
    assert len(got) == 5 and sum(r.topped_up for r in got) == 2  # one of six items has band 2, none band 3


def test_folds(spark):
    long = panel(spark, [1] * 200, first=date(2001, 11, 4) - timedelta(days=199))
    assert tuple(fc.folds(long).orderBy("fold").collect()[-1]) == (4, date(2001, 10, 7), date(2001, 10, 8), date(2001, 11, 4))
    assert fc.checked_folds(long)[-1] == (4, date(2001, 10, 7)) and len(fc.checked_folds(long)) == 5
    with pytest.raises(ValueError, match="fold 0 has no training data"):
        fc.checked_folds(panel(spark, [1] * 141))  # the first origin is the first day
    assert fc.checked_folds(panel(spark, [1] * 142))
    with pytest.raises(ValueError, match="empty"):
        fc.checked_folds(panel(spark, []))
    day = "date'2001-01-02'"
    bad = fc.fold_faults(spark.sql(f"select 0 as fold, {day} as origin_date, {day} as test_start, {day} as test_end"), long).first()
    assert bad.fault == "tests days that it trains on"


def test_seasonal_naive_repeats_the_last_week(spark):
    f = panel(spark, [0] * 10 + [1, 2, 3, 4, 5, 6, 7] + [9] * 28)
    got = {r.horizon: r.yhat for r in fc.seasonal_naive(f, fc.folds(f, 1)).collect()}
    assert [got[h] for h in range(1, 11)] == [1, 2, 3, 4, 5, 6, 7, 1, 2, 3]


@pytest.mark.parametrize(("units", "scale"), [([0, 0, 2, 4, 1], 2.5), ([0, 0, 0, 0, 0], None), ([0, 0, 0, 0, 3], None), ([3, 3, 3, 3, 3], None)])
def test_naive_scale_starts_at_the_first_sale(spark, units, scale):
    f = panel(spark, units + [1] * 28)
    assert fc.naive_scales(f, fc.folds(f, 1)).first().scale == scale


def test_tsb_equals_its_recursion(spark):
    rnd = random.Random(7)
    units = [rnd.choice([0, 0, 0, 2, 5]) for _ in range(80)]
    f = panel(spark, units + [0] * 28)
    z = p = None
    for u in units:
        p = float(u > 0) if p is None else p + 0.2 * ((u > 0) - p)
        if u:
            z = float(u) if z is None else z + 0.2 * (u - z)
    assert fc.tsb(f, fc.folds(f, 1)).first().yhat == pytest.approx(z * p)


def test_pinball_and_costs(spark):
    f = panel(spark, [10] * 40)
    day = date(2000, 1, 31)
    rows = spark.createDataFrame([("m", 0, "Brand#1", "A", day, 0.9, 8.0), ("n", 0, "Brand#1", "A", day, 0.9, 12.0)], "model_name string, fold int, item_id string, store_id string, target_date date, quantile double, yhat double")
    assert {r.model_name: round(r.value, 9) for r in fc.pinball(rows, f).collect()} == {"m": 1.8, "n": 0.2}
    costs = CostModel()
    assert round(costs.critical_ratio(), 4) == 0.4087
    assert [round(CostModel(spoilage=s).critical_ratio(), 4) for s in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)] == [0.9554, 0.6608, 0.5051, 0.4087, 0.3432, 0.2959]
    assert grid_with(S.LEVELS, 0.40872)[2] == 0.4087
    assert [round(m, 6) for m in bin_masses(S.LEVELS)] == [0.175, 0.2, 0.25, 0.2, 0.1, 0.045, 0.03]
    for bad in ({"margin": 1.0}, {"spoilage": 1.2}, {"holding": -1}):
        with pytest.raises(ValueError):
            CostModel(**bad)
    with pytest.raises(ValueError, match="outside"):
        interpolate((0.25, 0.5), (F.lit(2.0), F.lit(4.0)), 0.6)
    assert spark.range(1).select(interpolate((0.25, 0.5), (F.lit(2.0), F.lit(4.0)), 0.375).alias("x")).first().x == 3.0


def test_monotone_removes_crossings(spark):
    day = date(2000, 1, 1)
    rows = spark.createDataFrame([("m", 0, "i", "s", day, day, 1, q, v) for q, v in ((0.1, 3.0), (0.5, 1.0), (0.9, 2.0))], "model_name string, fold int, item_id string, store_id string, target_date date, origin_date date, horizon int, quantile double, yhat double")
    assert fc.crossing_rate(rows).first().n_crossing == 1 and fc.crossing_rate(fc.monotone(rows)).first().n_crossing == 0
    assert [r.yhat for r in fc.monotone(rows).orderBy("quantile").collect()] == [1.0, 2.0, 3.0]


def test_routing_needs_a_rule(spark):
    items = spark.createDataFrame([("i", "odd")], "item_id string, stratum_name string")
    rows = spark.createDataFrame([("tsb", "i", 1.0)], "model_name string, item_id string, yhat double")
    with pytest.raises(Exception, match="no rule for band odd"):
        fc.hybrid(rows, items).collect()


@pytest.mark.parametrize("method", ["wls_struct", "ols"])
def test_reconciliation_is_least_squares(spark, method):
    rnd = random.Random(9)
    leaves = [f"ALL/{s}/{d}/{i}" for s in "AB" for d in "xy" for i in range(rnd.randint(1, 3))]
    nodes = sorted({"/".join(x.split("/")[:k]) for x in leaves for k in (1, 2, 3, 4)})
    base = {n: rnd.uniform(0, 20) for n in nodes}
    under = np.array([[x == n or x.startswith(n + "/") for x in leaves] for n in nodes], float)
    w = np.diag(1 / (under.sum(1) if method == "wls_struct" else np.ones(len(nodes))))
    want = under @ np.linalg.solve(under.T @ w @ under, under.T @ w @ np.array([base[n] for n in nodes]))
    rows = spark.createDataFrame([(n, tree.LEVELS[n.count("/")], "m", 0, date(2000, 1, 1), v) for n, v in base.items()], "node string, level string, model_name string, fold int, target_date date, yhat double")
    got = {r.node: r.reconciled for r in tree.reconcile(rows, method).collect()}
    assert [got[n] for n in nodes] == pytest.approx(list(want), abs=1e-9)
    assert max(r.max_abs_gap for r in tree.coherence(tree.reconcile(rows, method), "reconciled").collect()) < 1e-9


def test_tree_adds_up(fact):
    sums = tree.roll_up(fact, ["units"])
    tree.check_tree(sums, "units")
    with pytest.raises(ValueError, match="does not add up"):
        tree.check_tree(sums.withColumn("units", F.when(F.col("level") == "state", F.col("units") + 1).otherwise(F.col("units"))), "units")
    total = tree.weights(fact).groupBy("level").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(0.25) for r in total)


def test_money_table_counts_every_row(spark, fact):
    cut = fc.folds(fact)
    rows = fc.quantile_forecast(fc.seasonal_naive(fact, cut), fc.residual_quantiles(fact, cut))
    got = {r.policy: r for r in ordering.money_table(ordering.quantile_panel(fc.monotone(rows), fact), fact, CostModel()).collect()}
    assert {r.n_rows for r in got.values()} == {125 * 140}
    assert got["naive"].saving_vs_naive == 0 and got["fixed_95"].stockout_rate <= got["newsvendor"].stockout_rate


def upload(spark, rows):
    return spark.createDataFrame(rows, "Item string, Order_Date string, Qty string, price string")


def test_gate(spark):
    days = lambda sku, n, skip=(): [(sku, str(date(2024, 1, 1) + timedelta(days=i)), "1", "2.5") for i in range(n) if i not in skip]
    rows = [*days("short", 21), *days("good", 120), *days("gap", 120, range(50, 65)), ("good", "2024-01-05", "4", None), ("good", "nonsense", "1", None), ("", "2024-01-01", "1", None), (" good ", "05/01/2024", "-3", None), ("void", "2024-01-01", None, None), ("void", "2024-01-01", "x", None)]
    got = {r.sku: r for r in service.gate(upload(spark, rows)).collect()}
    assert got["short"].reasons == [service.TOO_SHORT % 21] and not got["short"].admitted
    assert got["good"].admitted and got["good"].n_obs == 120 and got["gap"].max_gap_days == 15 and not got["gap"].admitted
    assert got["void"].n_nonnull == 0 and service.TOO_FEW % 0 + " (in 1 rows)" in got["void"].reasons
    report = service.gate_report(upload(spark, rows)).first()
    assert report.rows_without_date == 1 and report.negative_units == 1 and report.rows_merged == 3 and report.fatal is None
    assert service.gate_report(upload(spark, [("a", "?", "1", None)])).first().fatal == "most dates can't be read"
    merged = {(r.sku, r.date): r.units_sold for r in service.merge_days(service.usable(service.parse_upload(upload(spark, rows)))).collect()}
    assert merged["good", date(2024, 1, 5)] == 5 and merged["void", date(2024, 1, 1)] is None
    with pytest.raises(ValueError, match="units_sold"):
        service.resolve_columns(["sku", "date"])


def test_origin_features_and_totals(spark):
    rows = [("s", date(2024, 1, 1) + timedelta(days=i), v) for i, v in enumerate([1.0, None, 3.0, 0.0, 5.0, 6.0, 7.0, 8.0])]
    df = spark.createDataFrame(rows, "sku string, date date, units_sold double")
    got = service.origin_features(df).orderBy("date").collect()
    assert got[2].lag_1 == 3 and got[2].lag_2 is None and got[3].mean_7 == pytest.approx(4 / 3) and got[0].mean_7 is None
    assert got[3].zero_7 == 0.25 and got[4].trend == 4 and got[7].same_weekday_4 == 4.5
    ahead = [r.y for r in service.total_ahead(df, 2).orderBy("date").collect()]
    assert ahead == [None, 3.0, 5.0, 11.0, 13.0, 15.0, None, None]
    assert service.baseline_totals(df.where("units_sold > 6"), 3, [0.1, 0.5]).first().quantiles == [22.5, 22.5]


def test_festivals_and_keywords(spark):
    years = spark.createDataFrame([(y,) for y in (2022, 2023)], "year int")
    feasts = service.festivals(years)
    days = spark.createDataFrame([(date(2022, 12, 1) + timedelta(days=i),) for i in range(40)], "date date")
    assert {r.date for r in service.active(days, feasts).collect()} == {date(2022, 12, 15) + timedelta(days=i) for i in range(12)}
    near = {r.date: r for r in service.proximity(days, feasts).collect()}
    assert near[date(2022, 12, 5)].days_to_next == 20 and near[date(2022, 12, 26)].days_since_last == 1
    assert near[date(2022, 12, 1)].days_since_last == 38  # Diwali fell on 24 October
    fixed = service.proximity(days, feasts.where("key in ('christmas', 'independence_day', 'republic_day')"))
    assert fixed.where("date = '2022-12-01'").first().days_since_last == 45  # clipped
    units = [(("s", date(2022, 11, 1) + timedelta(days=i), 6.0 if date(2022, 12, 15) <= date(2022, 11, 1) + timedelta(days=i) < date(2022, 12, 25) else 2.0)) for i in range(100)]
    series = spark.createDataFrame(units, "sku string, date date, units_sold double")
    effect = service.uplift(service.occurrences(series, feasts)).first()
    assert (effect.key, effect.multiplier, effect.years, effect.shut_on_day) == ("christmas", 3.0, 1, False)
    last = spark.createDataFrame([("s", date(2023, 12, 10)), ("t", date(2023, 12, 10)), ("u", date(2023, 6, 1))], "sku string, last date")
    plan = {r.sku: r for r in service.plan(last, feasts, spark.createDataFrame([("s", "christmas", 3.0)], "sku string, key string, multiplier double"), 14).collect()}
    assert plan["s"].factor == pytest.approx((4 + 10 * 3.0) / 14) and [plan[k].state for k in "stu"] == ["adjusted", "advisory", "none"]
    skus = spark.createDataFrame([("amul milk 1l",), ("Gift-Box oil lamp",), ("milkshake",)], "sku string")
    got = {(r.sku, r.festival_key): (r.keyword, r.multiplier) for r in service.keyword_matches(skus, rules.default_rules(spark)).collect()}
    assert got["amul milk 1l", "holi"] == ("milk", 1.6) and got["Gift-Box oil lamp", "diwali"] == ("oil lamp", 2.5) and not any(s == "milkshake" for s, _ in got)
    clash = spark.createDataFrame([(0, "f", "up", "c", 1.5, "red tea"), (1, "f", "down", "c", 0.5, "tea red")], "row int, festival_key string, direction string, category string, suggested_multiplier double, items string")
    assert service.keyword_matches(spark.createDataFrame([("red tea red",)], "sku string"), clash).isEmpty()


def test_choice_of_method(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.04), ("b", 1.0, 2.0), ("c", 2.0, 1.0), ("d", None, 1.0)], "sku string, model double, baseline double")
    assert {r.sku: r.method for r in service.choose_method(rows).collect()} == {"a": "baseline", "b": "model", "c": "baseline", "d": "baseline"}


def test_files(spark, tmp_path):
    (tmp_path / "sales.csv").write_text("item_id,store_id,d_1,d_2\ni,A,1,\nj,B,2,3\n")
    (tmp_path / "prices.csv").write_text("store_id,item_id,wm_yr_wk,sell_price\nA,i,1,2.5\nA,z,1,9\n")
    (tmp_path / "cal.csv").write_text("date,wday,event\n2000-01-01,1,\n2000-01-02,x,Y\n")
    with pytest.raises(FileNotFoundError, match="none.csv"):
        files.require_files(spark, str(tmp_path), ["sales.csv", "none.csv"])
    cal = files.read_text_columns(spark, str(tmp_path / "cal.csv"), {"date": "date", "wday": "tinyint", "event": "string"}).collect()
    assert cal[0].event is None and cal[1].wday is None and cal[1].event == "Y"
    wide = files.read_sales_wide(spark, str(tmp_path / "sales.csv"), store_id="A")
    assert [(r.d, r.units) for r in demand.unpivot_sales(wide, ["item_id", "store_id"]).collect()] == [("d_1", 1)]
    with pytest.raises(ValueError, match="no series"):
        files.read_sales_wide(spark, str(tmp_path / "sales.csv"), store_id="Z")
    assert files.read_prices(spark, str(tmp_path / "prices.csv"), wide).count() == 1
    out = str(tmp_path / "t")
    one = spark.createDataFrame([("m", 1, 1.0), ("n", 1, 2.0)], "model_name string, fold int, x double")
    files.replace_scope(one, out, ["model_name"])
    files.replace_scope(one.where("model_name = 'm'").withColumn("x", F.lit(5.0)), out, ["model_name"])
    assert sorted((r.model_name, r.x) for r in spark.read.parquet(out).collect()) == [("m", 5.0), ("n", 2.0)]
    files.append(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).first().x is None
    files.publish(one, str(tmp_path / "p"))
    reader = files.read_current(spark, str(tmp_path / "p"))
    files.publish(one.limit(1), str(tmp_path / "p"))
    assert reader.count() == 2 and files.read_current(spark, str(tmp_path / "p")).count() == 1
    with pytest.raises(ValueError, match="contradict"):
        (tmp_path / "r.csv").write_text("festival_key,festival,direction,category,items,suggested_multiplier,notes\nf,F,up,c,milk,0.5,\n")
        rules.read_rules(spark, str(tmp_path / "r.csv"))


def test_retention(spark):
    sets = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 6, 1))], "id int, created date").withColumn("created", F.col("created").cast("timestamp"))
    kept = service.purge(sets, F.to_timestamp(F.lit("2024-06-30 00:00:00")), 30)
    assert [r.id for r in kept.collect()] == [2]
    assert service.orphans(spark.createDataFrame([(1,), (2,)], "id int"), kept, "id").count() == 1
    with pytest.raises(ValueError):
        service.purge(sets, F.current_timestamp(), 0)


def test_smoothing_follows_a_season():
    y = np.array([float(i % 7) for i in range(140)])
    path, sigma, _ = models.smooth(y, [140], 14)[0]
    assert path[0] == pytest.approx([i % 7 for i in range(14)], abs=1e-6) and sigma[0] < 1e-6


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    query = stream.append_days(stream.daily_units(stream.read_events(spark, str(tmp_path / "in"), events.schema)), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = {(r.sku, r.date): round(r.units, 6) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.sku, r.date): round(r.u, 6) for r in events.groupBy(F.col("event_type").alias("sku"), F.col("ts").cast("date").alias("date")).agg(F.sum("value").alias("u")).collect()}
    # days that the watermark has not passed are still open; all others are there, and equal
    closed = max(d for _, d in batch) - timedelta(days=2)
    assert got and all(batch[k] == v for k, v in got.items()) and not [k for k in batch if k[1] < closed and k not in got]
