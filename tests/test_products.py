"""The learned model of a product against plain Python."""

from datetime import date, timedelta

import numpy as np
import pytest

from larder.operators import products


def test_leaves_and_leaks(spark):
    rnd = np.random.default_rng(1)
    start, horizon = date(2000, 1, 3), 14
    units = [float(x) for x in rnd.integers(0, 20, 150)]
    units[40] = None
    days = [("a", start + timedelta(i), v) for i, v in enumerate(units)]
    origin = start + timedelta(120)
    later = [(s, d, 1000.0 if d > origin and v is not None else v) for s, d, v in days]  # what follows the origin must not matter
    found = []
    for rows in (days, later):
        table = products.learning_rows(spark.createDataFrame(rows, "sku string, date date, units_sold double"), horizon)
        origins = spark.createDataFrame([("a", 0, origin)], "sku string, fold int, origin_date date")
        daily, totals = products.learned(table, origins, horizon, (0.25, 0.5))
        found.append(({r.date: r.quantiles for r in daily.collect()}, totals.collect()[0].quantiles))
    assert found[0] == found[1]
    seen = [(d, v) for _, d, v in days if v is not None]
    rising = [round(float(np.mean([v for _, v in seen[max(0, i - 6) : i + 1]])), 6) > round(float(np.mean([v for _, v in seen[max(0, i - 90) : i + 1]])), 6) for i in range(len(seen))]
    past = [i for i, (d, _) in enumerate(seen) if d <= origin]
    now = rising[past[-1]]
    for h in range(1, horizon + 1):
        day = origin + timedelta(h)
        leaf = [seen[i][1] for i in past if seen[i][0].weekday() == day.weekday() and (rising[i - horizon] if i >= horizon else False) == now]
        assert found[0][0][day] == pytest.approx(np.quantile(leaf or [seen[i][1] for i in past], [0.25, 0.5]).tolist())
    sums = [sum(v for _, v in seen[i + 1 : i + 1 + horizon]) for i in past if i + horizon in past and rising[i] == now]
    assert found[0][1] == pytest.approx(np.quantile(sums, [0.25, 0.5]).tolist())


def test_products_without_days_or_folds(spark):
    """A product without recorded days has no forecast; one too short for folds keeps the baseline."""
    empty = spark.createDataFrame([("a", date(2000, 1, 1), None)], "sku string, date date, units_sold double")
    assert products.learning_rows(empty, 14).collect() == [] and products.backtest(empty, 14, 0.4).collect() == []
    loss = spark.createDataFrame([], "sku string, fold int, mase double, pinball double")
    row = products.chosen(empty.selectExpr("sku", "0 as n_folds"), loss, loss).collect()[0]
    assert (row.method, row.reason) == ("baseline", "No fold had enough history for a model, so the repeated week is used. Nothing could be measured on its own history.")


def test_reasons_have_figures_and_folds(spark):
    folds = spark.createDataFrame([(s, 4) for s in "abcd"], "sku string, n_folds int")
    tests = lambda rows: spark.createDataFrame(rows, "sku string, fold int, mase double, pinball double")
    model = tests([("a", 2, 0.5, 1.0), ("a", 3, 0.7, 1.0005), ("b", 3, 2.0, 2.0), ("c", 1, 1.0, 1.01), ("c", 2, 1.0, 1.01), ("c", 3, 1.0, 1.01)])
    base = tests([*(("a", k, 0.4, 3.0) for k in range(4)), *(("b", k, None, 1.0) for k in range(4)), *(("c", k, 1.0, 1.0) for k in range(4)), ("d", 0, 1.0, 1.0)])
    got = {r.sku: (r.method, r.reason) for r in products.chosen(folds, model, base).collect()}
    assert got["a"] == ("model", "The model orders better: loss 1.000 against 3.000 by the repeated week over 2 fold(s) of 4, the others too early for a model. Daily error, scaled: model 0.600, repeated week 0.400. Day by day the repeated week was closer; the loss of the order decides. Two folds alone were measured, so the figures are rough.")
    assert got["b"] == ("baseline", "The repeated week orders better: loss 1.000 against 2.000 by the model over 1 fold(s) of 4, the others too early for a model. Daily error, scaled: model 2.000, repeated week unknown. One fold alone was measured, which may be luck.")
    assert got["c"][0] == "baseline" and got["c"][1].startswith("Too close to call, so the simpler repeated week is used: order loss 1.010 by the model and 1.000 by the repeated week over 3 fold(s) of 4")
    assert got["d"] == ("baseline", "No fold had enough history for a model, so the repeated week is used. One fold alone was measured, which may be luck.")


def test_no_model_without_enough_days(spark):
    start = date(2000, 1, 3)
    for n, horizon, fitted in ((59, 14, 0), (60, 14, 14), (60, 37, 0), (61, 37, 37)):  # 60 days, and 24 windows that have ended
        days = [("a", start + timedelta(i), float(i % 5)) for i in range(n)]
        table = products.learning_rows(spark.createDataFrame(days, "sku string, date date, units_sold double"), horizon)
        origins = spark.createDataFrame([("a", 0, days[-1][1])], "sku string, fold int, origin_date date")
        assert products.learned(table, origins, horizon, (0.5,))[0].count() == fitted


def test_boosted_products_do_not_look_ahead(spark):
    """Two grains and three folds of two products that end on different days; what follows an origin changes nothing that was learned by it."""
    rnd = np.random.default_rng(5)
    rows = [(s, date(2000, 1, 3) + timedelta(i + off), float(rnd.poisson(3 + 6 * (i % 7 == 5)))) for s, off in (("a", 0), ("b", 40)) for i in range(200)]
    rows += [("short", date(2000, 8, 1) + timedelta(i), 1.0) for i in range(30)]
    later = [(s, d, v + 500 if d > date(2000, 1, 3) + timedelta(199 - 14 + (40 if s == "b" else 0)) and s != "short" else v) for s, d, v in rows]
    settings = {"folds": 3, "rounds": 6, "depth": 3, "rate": 0.5}
    found = []
    for r in (rows, later):
        daily, totals = products.boosted(spark.createDataFrame(r, "sku string, date date, units_sold double"), 14, (0.1, 0.5, 0.9), **settings)
        found.append(({(x.sku, x.back, x.date): (x.y, x.quantiles) for x in daily.collect()}, {(x.sku, x.back): x.quantiles for x in totals.collect()}))
    (daily, totals), (changed, totals_changed) = found
    assert totals == totals_changed and {k: q for k, (_, q) in daily.items()} == {k: q for k, (_, q) in changed.items()}
    assert set(totals) == {(s, b) for s in "ab" for b in (1, 2, 3)} and len(daily) == 2 * 3 * 14  # the short one has too few days
    assert all(x == sorted(x) and len(x) == 3 and x[0] >= 0 for x in [q for _, q in daily.values()] + list(totals.values()))
    busy = [abs(y - q[1]) for (_, _, d), (y, q) in daily.items()]
    flat = np.median([v for _, _, v in rows])
    assert np.mean(busy) < np.mean([abs(y - flat) for y, _ in daily.values()])  # it has learned the busy day
    assert all(10 < q[1] < 140 for q in totals.values())
